"""State that many polls share: seen keys, parents and backlogs in buckets, late attempts, calls in waves, run metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from checks import expected as X
from checks.folders import work_folder
from checks.model_queries import _CALLS, MODELS, digest_completer, doc_items, sql_text
from checks.registry import query
from checks.run_queries import _CALLS_NOW, _HEALTH, _PLAIN, _land
from checks.text_queries import TRIM, sql_words
from checks.views import AS_OF, attempts, entries, table
from contentflow.operators import models as M
from contentflow.operators.buckets import BucketTable
from contentflow.operators.key_store import KeyStore
from contentflow.operators.known import open_rows, unseen
from contentflow.operators.metrics import run_metrics
from contentflow.operators.state import State
from contentflow.plans import pipelines
from contentflow.sources.text_files import text_items
from contentflow.streaming import polls


@query("seen_keys", "SELECT guid, CAST(min(pos % 7) AS BIGINT) AS poll FROM entries GROUP BY guid")
def seen_keys(spark, sf):
    """Seven polls of entries whose guids repeat: each guid is new once. Segments of three polls are merged."""
    root = work_folder(spark, "keys")
    found = []
    for poll in range(7):
        state = State(spark, root, f"run-{poll}")
        rows = entries(spark, sf).filter(F.col("pos") % 7 == poll).select("guid").distinct()
        store = KeyStore(state, "guids", buckets=8, fan=3)
        new = state.append("guids", unseen(rows, store.stored(rows, "guid"), "guid").withColumn("poll", F.lit(poll)), "guid string, poll bigint")
        store.add(new, "guid")
        found.append(new)
    return reduce(lambda a, b: a.unionByName(b), found)


@query("open_backlog", """WITH a AS (SELECT doc_id, source AS feed, doc_id % 3 AS poll FROM documents),
    done AS (SELECT doc_id, CASE WHEN poll = 0 AND doc_id % 5 = 0 THEN 1 WHEN poll < 2 AND doc_id % 7 = 0 THEN 2 ELSE 9 END AS gone FROM a)
    SELECT CAST(p AS BIGINT) AS poll, 'g' || CAST(doc_id AS VARCHAR) AS guid FROM a JOIN done USING (doc_id) CROSS JOIN range(3) AS r(p)
    WHERE poll <= p AND gone > p AND (p < 2 OR feed IN ('src1', 'src2', 'src3'))
        AND (p < 2 AND poll < 2 OR p = 2 AND (poll < 2 OR feed IN ('src1', 'src2', 'src3')))
        AND feed IN (SELECT feed FROM a b WHERE b.poll = p)""")
def open_backlog(spark, sf):
    """Three polls of new articles, some of which are processed after each; the last poll only brings articles of three feeds."""
    root = work_folder(spark, "backlog")
    docs = table(spark, sf, "documents").select(
        "doc_id", F.concat(F.lit("g"), F.col("doc_id")).alias("guid"), F.col("source").alias("feed"), F.lit(False).alias("processed")
    )
    emitted = []
    for poll in range(3):
        state = State(spark, root, f"run-{poll}")
        new = docs.filter(F.col("doc_id") % 3 == poll)
        if poll == 2:
            new = new.filter(F.col("feed").isin("src1", "src2", "src3"))
        articles = state.append("articles", new)
        emitted.append(state.keep("emitted", open_rows(state, "articles", articles, "feed").select(F.lit(poll).cast("long").alias("poll"), "guid")))
        done = docs.filter((F.col("doc_id") % 3 <= poll) & (F.col("doc_id") % (5 if poll == 0 else 7) == 0))
        state.mark_processed("articles", done.select("guid"), "guid")
    return reduce(lambda a, b: a.unionByName(b), emitted)


@query("parent_buckets", """SELECT CAST(c_custkey AS VARCHAR) AS thread_id, CASE WHEN c_nationkey = 3 THEN 'late ' WHEN c_nationkey < 9 THEN 'new ' ELSE '' END || c_name AS name FROM customer""")
def parent_buckets(spark, sf):
    """Customers as parents; later runs, the last one repeated, rename those of some nations."""
    root = work_folder(spark, "parents")
    customers = table(spark, sf, "customer")

    def named(rows, prefix):
        return rows.select(F.col("c_custkey").cast("string").alias("thread_id"), F.concat(F.lit(prefix), "c_name").alias("name"))

    for run_id, rows in (
        ("run-1", named(customers, "")), ("run-2", named(customers.filter("c_nationkey < 9"), "new ")),
        ("run-3", named(customers.filter("c_nationkey = 3"), "late ")), ("run-3", named(customers.filter("c_nationkey = 3"), "late ")),
    ):
        BucketTable(State(spark, root, run_id), "threads", "thread_id", "thread_id string, name string", buckets=16).upsert(rows)
    return BucketTable(State(spark, root, "reader"), "threads", "thread_id", "thread_id string, name string").read()


@query("late_attempts", f"""{_HEALTH} SELECT CAST(feed AS VARCHAR) AS url, CAST(arg_max(run, ts) AS BIGINT) AS error_count,
    max(muted_at) IS NOT NULL AS muted, max('Auto-muted after 5 consecutive errors. Last error: ' || muted_error) AS muted_reason,
    CASE WHEN arg_max(run, ts) > 0 THEN arg_max(error, ts) FILTER (outcome = 'error') END AS last_error,
    CAST(arg_max(n, ts) AS BIGINT) AS no_entries_count FROM t GROUP BY feed""")
def late_attempts(spark, sf):
    """The attempts land in four batches, whatever their time, with a poll after each: as if all had come at once."""
    root = work_folder(spark, "late")
    log = attempts(spark, sf)
    for turn in (2, 0, 3, 1):
        ddl = _land(spark, log.filter(F.pmod(F.xxhash64("attempt_id"), F.lit(4)) == turn), f"{root}/landing")
        polls.health_stream(polls.landed(spark, f"{root}/landing", ddl), f"{root}/state")
    known = State(spark, f"{root}/state", "reader").snapshot("feeds")
    return known.select("url", "error_count", "muted", "muted_reason", "last_error", "no_entries_count")


@query("model_waves", f"""SELECT doc_id, name, NOT busy AND NOT odd AS success, CASE WHEN busy OR odd THEN text
    ELSE CAST(length(prompt) AS VARCHAR) || ' ' || md5(prompt) END AS content FROM ({_CALLS})""")
def model_waves(spark, sf):
    """Documents through three models in waves of few calls, one model with a limit of its own; started twice."""
    root = work_folder(spark, "waves")
    items = doc_items(spark, sf)
    for _ in range(2):
        answered = pipelines.apply_models(
            State(spark, root, "run-1"), items, MODELS, digest_completer, concurrency=4, limits={"vendor_b/beta-1": 2},
            calls_per_task=max(50, items.count() // 8), **_CALLS_NOW,
        )
    return answered.select("doc_id", "name", "success", "content")


@query("run_metrics", f"""SELECT 'run-1' AS run_id, 'results' AS step, CAST(count(*) AS BIGINT) AS rows, CAST(0 AS BIGINT) AS failures,
    CAST(count(*) AS BIGINT) AS call_count, CAST(sum({sql_words('prompt')}) AS BIGINT) AS tokens_in, CAST(2 * count(*) AS BIGINT) AS tokens_out
    FROM (SELECT {sql_text(X.DEFAULT_PROMPT_HEAD)} || trim(text, {TRIM}) AS prompt FROM documents WHERE trim(text, {TRIM}) <> '')""")
def text_run_metrics(spark, sf):
    """What a run of texts through one model noted of itself while it wrote its results."""
    root = work_folder(spark, "metrics")
    state = State(spark, f"{root}/state", "run-1")
    pipelines.text_to_notes(
        state, text_items(table(spark, sf, "documents"), as_of=AS_OF, key="doc_id"), digest_completer, f"{root}/vault", as_of=AS_OF,
        model=M.Model("alpha", "vendor_a/alpha-1"), notes=_PLAIN, calls=_CALLS_NOW,
    )
    return run_metrics(state)
