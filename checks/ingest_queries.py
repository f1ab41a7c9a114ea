"""Sources, filters, joins against state, rankings and feed health."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import query
from checks.text_queries import sql_clean, sql_words
from checks.views import (
    AS_OF, LOOKBACK_HOURS, MESSAGES_AS_OF, attempts, entries, feeds, history, seen, table, wide,
)
from contentflow.functions.dates import utc
from contentflow.functions.text import needs_enrichment
from contentflow import schema
from contentflow.operators import filters, health, known, ranking
from contentflow.operators.stages import as_results, conform, pass_failed
from contentflow.plans import articles as article_plan
from contentflow.plans import conversations as chat_plan
from contentflow.sources import feeds as feed_source
from contentflow.sources import items as item_source
from contentflow.sources import messages as message_source
from contentflow.sources.text_files import text_items

CUTOFF = "TIMESTAMP '2024-01-24 00:00:00'"
LONG = "lower(content)"
_NEEDS = f"""(starts_with(url, 'http') AND (length(content) < 1000 OR contains({LONG}, '[...]')
    OR contains({LONG}, 'read more') OR contains({LONG}, 'continue reading')))"""

# --- sources -----------------------------------------------------------------------------------


@query("text_source", f"""SELECT sha256('cli' || chr(31) || CAST(doc_id AS VARCHAR)) AS id, content,
    CAST(length(content) AS VARCHAR) AS size, 'cli' AS source FROM (SELECT doc_id,
    trim(text, '{"".join(map(chr, (9, 10, 13, 32)))}') AS content FROM documents) WHERE content <> ''""")
def text_source(spark, sf):
    made = text_items(table(spark, sf, "documents"), as_of=AS_OF, key="doc_id")
    return made.select("id", "content", F.col("metadata")["size"].alias("size"), "source")


def _xml(column: str) -> F.Column:
    """XML text: what XML cannot hold is dropped, its special characters are escaped."""
    c = F.regexp_replace(column, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(char), F.lit(entity))
    return c


def landed_bodies(spark, sf):
    """Every document as a landed feed body with one entry: RSS, or Atom for two of the feeds."""
    base = entries(spark, sf, wide(spark, sf, "documents")).withColumns({"x_title": _xml("title"), "x_content": _xml("content")})
    audio = F.concat(F.lit('<enclosure type="audio/mpeg" url="http://media.example/'), F.col("pos"), F.lit('.mp3"/>'))
    rss = F.concat(
        F.lit("<rss><channel><title>Feed "), F.col("feed"), F.lit("</title><item><title>"), F.col("x_title"),
        F.lit("</title><guid>"), F.col("guid"), F.lit("</guid><link>"), F.col("url"), F.lit("</link>"),
        F.coalesce(F.concat(F.lit("<pubDate>"), F.date_format("published_at", "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT</pubDate>")), F.lit("")),
        audio, F.lit("<description>"), F.col("x_content"), F.lit("</description></item></channel></rss>"),
    )
    atom = F.concat(
        F.lit("<feed><title>Feed "), F.col("feed"), F.lit("</title><entry><id>"), F.col("guid"), F.lit("</id><title>"),
        F.col("x_title"), F.lit('</title><link href="'), F.col("url"), F.lit('"/><link rel="enclosure" type="audio/mpeg" href="'),
        F.concat(F.lit("http://media.example/"), F.col("pos"), F.lit('.mp3"/>')),
        F.coalesce(F.concat(F.lit("<published>"), F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("</published>")), F.lit("")),
        F.lit('<content type="html">'), F.col("x_content"), F.lit("</content></entry></feed>"),
    )
    body = F.when(F.col("feed").isin("src1", "src2"), atom).otherwise(rss)
    return base.select("feed", F.col("pos").alias("page"), body.alias("body"))


@query("feed_entries", r"""SELECT feed, pos, guid, url, title, published_at,
    trim(regexp_replace(content, '[\x00-\x08\x0b\x0c\x0e-\x1f]', '', 'g'), ' ' || chr(9) || chr(10) || chr(13)) AS content
    FROM entries""")
def feed_entries(spark, sf):
    parsed = feed_source.feed_entries(feed_source.raw_entries(landed_bodies(spark, sf)))
    return parsed.select(
        "feed", F.shiftright("pos", 32).alias("pos"), "guid", "url", "title",
        "published_at", "content",
    )


@query("podcast_entries", """SELECT feed, pos, guid, title, published_at, 'audio/mpeg' AS link_type,
    'http://media.example/' || CAST(pos AS VARCHAR) || '.mp3' AS link_href FROM entries""")
def podcast_entries(spark, sf):
    parsed = feed_source.podcast_entries(feed_source.raw_entries(landed_bodies(spark, sf)))
    last = F.try_element_at("links", F.lit(-1))
    return parsed.select(
        "feed", F.shiftright("pos", 32).alias("pos"), "guid", "title", "published_at",
        last["type"].alias("link_type"), last["href"].alias("link_href"),
    )


@query("feed_heads", """SELECT feed, 'Feed ' || feed AS title, '' AS description, '' AS author, '' AS website_url
    FROM feeds""")
def feed_heads(spark, sf):
    return feed_source.feed_heads(landed_bodies(spark, sf))


@query("make_item", f"""SELECT sha256('manual' || chr(31) || CAST(conv_id * 100 + turn AS VARCHAR)) AS id, text AS content,
    'text' AS content_type, role AS role, CASE WHEN role = 'user' THEN 'True' ELSE 'False' END AS from_user,
    CAST(1 AS BIGINT) AS call_count, TIMESTAMP '{AS_OF}' AS "timestamp" FROM conversations""")
def make_item(spark, sf):
    made = item_source.make_items(
        table(spark, sf, "conversations"), content=F.col("text"), source="manual",
        natural_key=F.col("conv_id") * 100 + F.col("turn"),
        metadata={"role": F.col("role"), "from_user": F.col("role") == "user"}, timestamp=utc(AS_OF),
    )
    meta = F.col("metadata")
    return made.select(
        "id", "content", "content_type", meta["role"].alias("role"), meta["from_user"].alias("from_user"),
        F.col("metrics.call_count").cast("bigint").alias("call_count"), "timestamp",
    )


def stored_articles(spark, sf):
    """Every entry with a guid of its own as a stored article."""
    stored = table(spark, sf, "documents").selectExpr("source AS feed", "'d' || CAST(doc_id AS STRING) AS guid",
        "'Title ' || CAST(doc_id AS STRING) AS title", "CAST(NULL AS STRING) AS author", "text AS content", "lang AS description",
        "CASE WHEN doc_id % 25 = 3 THEN NULL ELSE timestampadd(HOUR, doc_id, timestamp_ntz'2024-01-01 00:00:00') END AS published_at",
        "timestamp_ntz'2024-02-01 00:00:00' AS fetched_at", "'http://site.example/' || CAST(doc_id AS STRING) AS url",
        "n_chars AS word_count", "false AS processed")
    for name in ("summary", "quality_tier", "quality_score", "labels"):
        stored = stored.withColumn(name, F.lit(None).cast("string"))
    return stored


def titled_feeds(spark, sf):
    return feeds(spark, sf).selectExpr("feed AS url", "'Feed ' || feed AS title", "muted")


@query("article_items", """SELECT sha256('rss:Feed ' || source || chr(31) || 'd' || CAST(doc_id AS VARCHAR)) AS id, text AS content,
    'rss:Feed ' || source AS source, coalesce(CASE WHEN doc_id % 25 = 3 THEN NULL
        ELSE TIMESTAMP '2024-01-01 00:00:00' + doc_id * INTERVAL '1' HOUR END, TIMESTAMP '2024-02-01 00:00:00') AS "timestamp",
    'Title ' || CAST(doc_id AS VARCHAR) AS title, 'Feed ' || source AS feed_title, CAST(n_chars AS VARCHAR) AS word_count,
    'd' || CAST(doc_id AS VARCHAR) AS guid, CAST(13 AS BIGINT) AS keys FROM documents""")
def article_items(spark, sf):
    made = item_source.article_items(stored_articles(spark, sf), titled_feeds(spark, sf))
    meta = F.col("metadata")
    return made.select(
        "id", "content", "source", "timestamp", meta["title"].alias("title"), meta["feed_title"].alias("feed_title"),
        meta["word_count"].alias("word_count"), "guid", F.size("metadata").cast("bigint").alias("keys"),
    )


@query("episode_items", """SELECT 'd' || CAST(doc_id AS VARCHAR) AS guid, text AS content,
    CASE WHEN lang IN ('en', 'de') THEN 'text' ELSE 'audio' END AS content_type, 'podcast:Feed ' || source AS source,
    CASE WHEN lang IN ('en', 'de') THEN 'external' END AS transcript_source, 'by ' || source AS podcast_author,
    CAST(12 AS BIGINT) AS keys FROM documents""")
def episode_items(spark, sf):
    stored = stored_articles(spark, sf).withColumnsRenamed({"feed": "feed_url", "fetched_at": "created_at"})
    has_text = F.col("description").isin("en", "de")
    empty = F.when(F.col("description") == "fr", "").otherwise(None)
    episodes = stored.withColumns(
        {
            "transcript": F.when(has_text, F.col("content")).otherwise(empty),
            "transcript_source": F.when(has_text, "external"),
            "audio_url": F.col("url"),
            "description": F.when(~has_text, F.col("content")),
        }
    )
    podcasts = titled_feeds(spark, sf).selectExpr("url AS feed_url", "title", "'by ' || url AS author")
    made = item_source.episode_items(episodes, podcasts)
    meta = F.col("metadata")
    return made.select(
        "guid", "content", "content_type", "source", meta["transcript_source"].alias("transcript_source"),
        meta["podcast_author"].alias("podcast_author"), F.size("metadata").cast("bigint").alias("keys"),
    )


# --- messages ----------------------------------------------------------------------------------

_OPTIONS = {"as_of": MESSAGES_AS_OF, "lookback_hours": LOOKBACK_HOURS}


def scanned(spark, sf, **options):
    landed = history(spark, sf)
    tables = [landed[n] for n in ("message", "handle", "chat_message_join", "chat")]
    return message_source.scan_messages(*tables, **{**_OPTIONS, **options})


def records(spark, sf, **options):
    landed, rows = history(spark, sf), scanned(spark, sf, **options)
    names = message_source.contact_names(landed["person"], landed["person_handle"], rows)
    return message_source.message_records(rows, names)


_SCAN_COLUMNS = "message_id, text, date_ns, is_from_me, handle, chat_id, chat_name, style"


def _scan_frame(df):
    return df.select(
        "message_id", "text", F.col("date").alias("date_ns"), "is_from_me", "handle", "chat_id", "chat_name", "style"
    )


@query("message_scan", f"SELECT {_SCAN_COLUMNS} FROM scan")
def message_scan(spark, sf):
    return _scan_frame(scanned(spark, sf, max_messages=None))


@query("newest_messages", f"SELECT {_SCAN_COLUMNS} FROM scan ORDER BY date_ns DESC, message_id, chat_id NULLS LAST LIMIT 100")
def newest_messages(spark, sf):
    return _scan_frame(scanned(spark, sf))


@query("message_filters", f"""SELECT {_SCAN_COLUMNS} FROM scan WHERE text ILIKE '%the%' AND NOT is_from_me AND style <> 43
    AND handle IS NOT NULL AND handle NOT IN ('Customer#000000004', 'Customer#000000005')""")
def message_filters(spark, sf):
    return _scan_frame(scanned(
        spark, sf, max_messages=None, trigger_word="the", include_from_me=False, include_group_chats=False,
        include_unknown_senders=False, contacts_to_exclude=["Customer#000000004", "Customer#000000005"],
    ))


@query("contact_names", "SELECT handle, contact_name FROM contacts")
def contact_names(spark, sf):
    landed = history(spark, sf)
    return message_source.contact_names(landed["person"], landed["person_handle"])


_RECORD = "message_id, text, from_me, sender, thread_id, thread_name, is_group, date, chat_id"


@query("thread_names", f"SELECT {_RECORD} FROM records")
def thread_names(spark, sf):
    return records(spark, sf, max_messages=None)


# Stored before: the first message of every conversation.
_STORED = "SELECT CAST(conv_id * 100 + turn AS VARCHAR) AS message_id FROM conversations WHERE turn = 0"
_FRESH = f"""SELECT {_RECORD} FROM (SELECT *, row_number() OVER (PARTITION BY message_id ORDER BY chat_id NULLS LAST) AS k
    FROM records WHERE message_id NOT IN ({_STORED})) WHERE k = 1"""


def fresh_messages(spark, sf):
    stored = table(spark, sf, "conversations").filter("turn = 0").selectExpr("CAST(conv_id * 100 + turn AS STRING) AS message_id")
    return chat_plan.new_messages(records(spark, sf, max_messages=None), stored)


@query("unseen_items", _FRESH)
def unseen_items(spark, sf):
    return fresh_messages(spark, sf)


# Known threads: the unnamed chats.
@query("upsert_parents", f"""WITH fresh AS ({_FRESH}), known AS (SELECT CAST(rowid_ AS VARCHAR) AS thread_id, 'known' AS name
        FROM msg_chat WHERE display_name = '')
    SELECT thread_id, name FROM known UNION ALL SELECT thread_id, thread_name FROM (SELECT *, row_number() OVER
        (PARTITION BY thread_id ORDER BY date DESC, message_id, chat_id NULLS LAST) AS k FROM fresh) WHERE k = 1
        AND thread_id NOT IN (SELECT thread_id FROM known)""")
def upsert_parents(spark, sf):
    chats = history(spark, sf)["chat"].filter("display_name = ''")
    stored = chats.selectExpr("CAST(rowid AS STRING) AS thread_id", "'known' AS name")
    candidates = fresh_messages(spark, sf).withColumn("name", F.col("thread_name"))
    merged = known.get_or_create(
        candidates.select("thread_id", "name", "date", "message_id", "chat_id"), stored, "thread_id",
        message_source.newest_first(),
    )
    return merged.select("thread_id", "name")


@query("message_items", f"""WITH fresh AS ({_FRESH}), threads AS (SELECT thread_id, thread_name, is_group FROM (SELECT *,
        row_number() OVER (PARTITION BY thread_id ORDER BY date DESC, message_id, chat_id NULLS LAST) AS k FROM fresh) WHERE k = 1)
    SELECT f.message_id, f.text AS content, 'imessage:' || coalesce(nullif(t.thread_name, ''), t.thread_id) AS source,
    f.date AS "timestamp", CASE WHEN f.from_me THEN 'True' ELSE 'False' END AS from_me, f.sender,
    CASE WHEN t.is_group THEN 'True' ELSE 'False' END AS is_group, CAST(7 AS BIGINT) AS keys
    FROM fresh f JOIN threads t ON f.thread_id = t.thread_id""")
def message_items(spark, sf):
    fresh = fresh_messages(spark, sf)
    no_threads = fresh.select("thread_id").filter("false")
    made = item_source.message_items(fresh.drop("is_group", "thread_name"), chat_plan.new_threads(fresh, no_threads))
    meta = F.col("metadata")
    return made.select(
        "message_id", "content", "source", "timestamp", meta["from_me"].alias("from_me"), meta["sender"].alias("sender"),
        meta["is_group"].alias("is_group"), F.size("metadata").cast("bigint").alias("keys"),
    )


# --- filters -----------------------------------------------------------------------------------


@query("lookback_entries", f"SELECT pos, guid, published_at FROM entries WHERE published_at IS NULL OR published_at >= {CUTOFF}")
def lookback_entries(spark, sf):
    return filters.within_lookback(entries(spark, sf), "published_at", AS_OF).select("pos", "guid", "published_at")


@query("active_feeds", "SELECT e.pos, e.feed FROM entries e JOIN feeds f ON e.feed = f.feed WHERE NOT f.muted")
def active_feeds(spark, sf):
    kept = filters.of_active_parents(entries(spark, sf), feeds(spark, sf), "feed")
    return kept.select("pos", "feed")


@query("required_fields", "SELECT pos, guid FROM entries WHERE guid <> '' AND title <> ''")
def required_fields(spark, sf):
    return filters.with_required(entries(spark, sf), "guid", "title").select("pos", "guid")


@query("needs_enrichment", f"SELECT pos, {_NEEDS} AS needed FROM entries")
def needs(spark, sf):
    return entries(spark, sf).select("pos", needs_enrichment(F.col("content"), F.col("url")).alias("needed"))


_TYPED = "CASE lang WHEN 'en' THEN 'text' WHEN 'de' THEN 'markdown' WHEN 'fr' THEN 'audio' ELSE 'video' END"


def typed(spark, sf):
    return table(spark, sf, "documents").selectExpr("doc_id", f"{_TYPED} AS content_type")


@query("type_gate", f"""SELECT doc_id, t AS content_type, t IN ('text', 'markdown') AS success,
    CASE WHEN t NOT IN ('text', 'markdown') THEN 'Cannot handle data of type ' || t END AS error_message
    FROM (SELECT doc_id, {_TYPED} AS t FROM documents)""")
def type_gate(spark, sf):
    return filters.gate_types(typed(spark, sf), ["text", "markdown"])


@query("success_gate", f"""SELECT doc_id, t IN ('text', 'markdown') AS success, CASE WHEN t IN ('text', 'markdown')
    THEN 'done' ELSE 'passed through' END AS what FROM (SELECT doc_id, {_TYPED} AS t FROM documents)""")
def success_gate(spark, sf):
    """The gate as a stage has it: only good results reach the processor, failed ones come back untouched."""
    gated = filters.gate_types(typed(spark, sf), ["text", "markdown"])
    results = conform(gated.withColumns({"id": F.col("doc_id").cast("string"), "content": F.lit("passed through")}), schema.RESULT)
    done = pass_failed(results, lambda good: as_results(good.withColumn("content", F.lit("done"))))
    return done.select(F.col("id").cast("bigint").alias("doc_id"), "success", F.col("content").alias("what"))


@query("union_inputs", """SELECT 'texts' AS input_name, doc_id AS id, text AS content, lang, NULL AS role FROM documents
    UNION ALL SELECT 'chats', conv_id * 100 + turn, text, NULL, role FROM conversations""")
def union_inputs(spark, sf):
    texts = table(spark, sf, "documents").selectExpr("doc_id AS id", "text AS content", "lang")
    chats = table(spark, sf, "conversations").selectExpr("conv_id * 100 + turn AS id", "text AS content", "role")
    return filters.union_inputs({"texts": texts, "chats": chats})


# --- rankings ----------------------------------------------------------------------------------


@query("newest_per_feed", """SELECT feed, pos, guid, CAST(rank AS BIGINT) AS rank FROM (SELECT *, row_number() OVER
    (PARTITION BY feed ORDER BY published_at DESC NULLS LAST, pos) AS rank FROM entries) WHERE rank <= 25""")
def newest_per_feed(spark, sf):
    top = ranking.newest_per_feed(entries(spark, sf).select("feed", "pos", "guid", "published_at"), 25)
    return top.select("feed", "pos", "guid", F.col("rank").cast("bigint").alias("rank"))


@query("dedupe_first", """SELECT guid, feed, pos FROM (SELECT *, row_number() OVER (PARTITION BY guid ORDER BY feed, pos) AS k
    FROM entries WHERE guid <> '') WHERE k = 1""")
def dedupe_first(spark, sf):
    named = filters.with_required(entries(spark, sf).select("guid", "feed", "pos"), "guid")
    return ranking.first_per_key(named, ["guid"], [F.col("feed"), F.col("pos")])


# --- the first whole slice ---------------------------------------------------------------------

_SELECTED = f"""WITH a AS (SELECT e.* FROM entries e JOIN feeds f ON e.feed = f.feed
        WHERE NOT f.muted AND (published_at IS NULL OR published_at >= {CUTOFF})),
    b AS (SELECT *, row_number() OVER (PARTITION BY feed ORDER BY published_at DESC NULLS LAST, pos) AS rn FROM a),
    g AS (SELECT *, row_number() OVER (PARTITION BY guid ORDER BY feed, rn) AS k FROM b WHERE rn <= 5 AND guid <> ''),
    h AS (SELECT * FROM g WHERE k = 1 AND guid NOT IN (SELECT guid FROM seen))"""


def selected(spark, sf):
    return article_plan.select_entries(
        entries(spark, sf), feeds(spark, sf), seen(spark, sf), as_of=AS_OF, max_articles=5
    )


@query("article_ingest", f"""{_SELECTED}, c AS (SELECT feed, {_NEEDS} AS needed, {sql_clean('content')} AS cleaned FROM h)
    SELECT feed, CAST(count(*) AS BIGINT) AS new_items, CAST(count(*) FILTER (needed) AS BIGINT) AS to_enrich,
    CAST(sum({sql_words('cleaned')}) AS BIGINT) AS words FROM c GROUP BY feed""")
def article_ingest(spark, sf):
    chosen = selected(spark, sf).withColumn("needed", needs_enrichment(F.col("content"), F.col("url")))
    cleaned = article_plan.to_articles(chosen.withColumn("summary", F.lit("")), as_of=AS_OF)
    return cleaned.groupBy("feed").agg(
        F.count(F.lit(1)).alias("new_items"), F.count_if("needed").alias("to_enrich"), F.sum("word_count").alias("words")
    )


def landed_pages(spark, sf):
    return table(spark, sf, "pages").selectExpr(
        "'http://site.example/' || CAST(page_id AS STRING) AS url", "html AS external_text"
    )


_PAGES = "SELECT 'http://site.example/' || CAST(page_id AS VARCHAR) AS url, html AS external_text FROM pages"


@query("enrich_content", f"""SELECT pos, coalesce({_NEEDS} AND external_text <> '' AND length(external_text) > length(content), false)
    AS enriched, CASE WHEN {_NEEDS} AND length(external_text) > length(content) THEN external_text ELSE content END AS content
    FROM entries LEFT JOIN ({_PAGES}) USING (url)""")
def enrich_content(spark, sf):
    rows = entries(spark, sf).select("pos", "guid", "url", "content")
    keyed = rows.withColumn("key", F.col("pos").cast("string"))
    needed = needs_enrichment(F.col("content"), F.col("url"))
    return known.enrich(keyed, landed_pages(spark, sf), needed, key="key").select("pos", "enriched", "content")


@query("ingest_stats", f"""{_SELECTED} SELECT feed, CAST(count(*) AS BIGINT) AS new_items, CAST(count(*) FILTER ({_NEEDS}
    AND length(external_text) > length(content)) AS BIGINT) AS enriched_items FROM h LEFT JOIN ({_PAGES}) USING (url) GROUP BY feed""")
def ingest_stats(spark, sf):
    chosen = selected(spark, sf).withColumn("summary", F.lit(""))
    made = article_plan.to_articles(chosen, as_of=AS_OF, external=landed_pages(spark, sf))
    return health.ingest_stats(made, "enriched")


@query("backlog_emit", f"""{_SELECTED} SELECT d.source AS feed, 'd' || CAST(d.doc_id AS VARCHAR) AS guid FROM documents d
    WHERE d.source IN (SELECT feed FROM h) AND d.doc_id NOT IN (SELECT doc_id FROM labels)""")
def backlog_emit(spark, sf):
    done = table(spark, sf, "labels").selectExpr("'d' || CAST(doc_id AS STRING) AS guid")
    stored = stored_articles(spark, sf).select("feed", "guid", "processed")
    return known.backlog(stored, selected(spark, sf), "feed", processed=done).select("feed", "guid")


# --- feed health -------------------------------------------------------------------------------

_RUNS = """WITH r AS (SELECT *, sum(CASE WHEN outcome = 'ok' THEN 1 ELSE 0 END) OVER (PARTITION BY feed ORDER BY ts, attempt_id) AS isl
        FROM attempts),
    s AS (SELECT *, sum(CASE WHEN outcome = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY feed, isl ORDER BY ts, attempt_id) AS run FROM r),
    m AS (SELECT feed, min(ts) AS muted_at, arg_min(error, ts) AS muted_error FROM s WHERE run >= 5 AND outcome = 'error' GROUP BY feed),
    k AS (SELECT s.*, m.muted_at, m.muted_error FROM s LEFT JOIN m ON s.feed = m.feed WHERE m.muted_at IS NULL OR s.ts <= m.muted_at)"""


@query("feed_automute", f"""{_RUNS} SELECT feed, CAST(count(*) AS BIGINT) AS attempts_made, CAST(arg_max(run, ts) AS BIGINT) AS error_count,
    max(muted_at) IS NOT NULL AS muted, max(muted_at) AS muted_at,
    max('Auto-muted after 5 consecutive errors. Last error: ' || muted_error) AS muted_reason,
    CASE WHEN arg_max(run, ts) > 0 THEN arg_max(error, ts) FILTER (outcome = 'error') END AS last_error FROM k GROUP BY feed""")
def feed_automute(spark, sf):
    log = attempts(spark, sf)
    runs = health.error_runs(log)
    made = health.attempts_made(log, runs).groupBy("feed").agg(F.count(F.lit(1)).alias("attempts_made"))
    return runs.drop("muted_seq").join(made, "feed")


@query("feed_empty_runs", f"""{_RUNS}, e AS (SELECT feed, ts, attempt_id, outcome, sum(CASE WHEN outcome <> 'empty' THEN 1 ELSE 0 END)
        OVER (PARTITION BY feed ORDER BY ts, attempt_id) AS isl2 FROM k),
    t AS (SELECT *, sum(CASE WHEN outcome = 'empty' THEN 1 ELSE 0 END) OVER (PARTITION BY feed, isl2 ORDER BY ts, attempt_id) AS n FROM e)
    SELECT feed, CAST(arg_max(n, ts) AS BIGINT) AS no_entries_count, CAST(max(n) AS BIGINT) AS longest_empty_run,
    CAST(count(*) FILTER (n > 5) AS BIGINT) AS warnings FROM t GROUP BY feed""")
def feed_empty_runs(spark, sf):
    log = attempts(spark, sf)
    return health.empty_runs(health.attempts_made(log, health.error_runs(log)))


@query("feed_counters", f"""{_SELECTED}, n AS (SELECT feed, count(*) AS c FROM h GROUP BY feed),
    old AS (SELECT source AS feed, count(*) AS c FROM documents GROUP BY source)
    SELECT old.feed AS url, CAST(old.c + coalesce(n.c, 0) AS BIGINT) AS article_count,
    CASE WHEN n.c > 0 THEN TIMESTAMP '{AS_OF}' ELSE TIMESTAMP '2024-01-01 00:00:00' END AS last_updated,
    CASE WHEN old.feed NOT IN ('src3', 'src7') THEN TIMESTAMP '{AS_OF}' ELSE TIMESTAMP '2024-01-01 00:00:00' END AS last_checked
    FROM old LEFT JOIN n USING (feed)""")
def feed_counters(spark, sf):
    start = utc("2024-01-01 00:00:00")
    counted = table(spark, sf, "documents").groupBy(F.col("source").alias("url")).agg(
        F.count(F.lit(1)).alias("article_count")
    ).withColumns({"last_updated": start, "last_checked": start})
    stats = selected(spark, sf).groupBy("feed").agg(F.count(F.lit(1)).alias("new_items"))
    return health.update_counters(counted, stats, filters.active(feeds(spark, sf)), AS_OF)
