"""Key stores, bucketed tables, backlogs, late attempts and calls in waves."""

import os
import random

import pytest
from pyspark.sql import functions as F

from contentflow.operators import health
from contentflow.operators.buckets import BucketTable, parents
from contentflow.operators.health_log import HealthLog
from contentflow.operators.key_store import KeyStore, remember, seen
from contentflow.operators.known import backlog, open_rows
from contentflow.operators.metrics import run_metrics, store_measured
from contentflow.operators.models import Model, complete_in_waves, fan_out, with_prompts
from contentflow.operators.state import State


def frame(spark, values, name="guid"):
    return spark.createDataFrame([(v,) for v in values], f"{name} string")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# --- seen keys ---------------------------------------------------------------------------------


def test_polls_find_exactly_the_stored_keys(spark, tmp_path):
    rng, known = random.Random(1), set()
    for poll in range(9):
        store = KeyStore(State(spark, str(tmp_path), f"r{poll:02}"), "guids", buckets=8, fan=3)
        keys = {f"k{rng.randrange(300)}" for _ in range(40)}
        got = {r.guid for r in store.stored(frame(spark, [*keys, None, None]), "guid").collect()}
        assert got == keys & known
        store.add(frame(spark, [*keys, *keys, None]), "guid")
        known |= keys
    # Nine polls are two segments of the third level at most, and no level holds three.
    live = KeyStore(State(spark, str(tmp_path), "later"), "guids", buckets=8, fan=3).segments()
    assert len(live) <= 4 and max(level for _, level, _ in live) == 2


def test_a_repeated_poll_starts_from_the_same_keys(spark, tmp_path):
    KeyStore(State(spark, str(tmp_path), "r1"), "guids").add(frame(spark, ["a"]), "guid")
    for _ in range(2):
        store = KeyStore(State(spark, str(tmp_path), "r2"), "guids")
        assert [r.guid for r in store.stored(frame(spark, ["a", "b"]), "guid").collect()] == ["a"]
        store.add(frame(spark, ["b"]), "guid")
    store = KeyStore(State(spark, str(tmp_path), "r3"), "guids")
    assert sorted(r.guid for r in store.stored(frame(spark, ["a", "b", "c"]), "guid").collect()) == ["a", "b"]
    store.add(frame(spark, []), "guid")
    assert len(KeyStore(State(spark, str(tmp_path), "r4"), "guids").segments()) == 2


def test_a_lookup_reads_only_buckets_that_may_hold_its_keys(spark, tmp_path):
    KeyStore(State(spark, str(tmp_path), "r1"), "guids", buckets=32).add(frame(spark, [f"k{i}" for i in range(2000)]), "guid")
    store = KeyStore(State(spark, str(tmp_path), "r2"), "guids", buckets=32)
    new = frame(spark, [f"new{i}" for i in range(500)]).select(F.col("guid").alias("key"))
    passed = store.may_hold(new)
    assert passed.count() < 25  # nearly all new keys end at the filters
    one = store.may_hold(frame(spark, ["k7"], "key"))
    bucket = one.first().bucket
    found = store.lookup(one, [bucket])
    assert [r.key for r in found.collect()] == ["k7"]
    # The bucket is a folder: the scan lists and opens no other.
    filters = [part.split("]")[0] for part in plan(found).split("PartitionFilters: [")[1:]]
    assert any(f"bucket#" in f and f"= {bucket})" in f for f in filters), filters


def test_a_store_takes_over_what_was_stored_without_one(spark, tmp_path):
    old = State(spark, str(tmp_path), "r1")
    old.append("articles", frame(spark, ["a", "b"]))
    state = State(spark, str(tmp_path), "r2")
    assert sorted(r.guid for r in seen(state, "articles", frame(spark, ["a", "x"]), state.earlier("articles"), "guid").collect()) == ["a", "b"]
    new = state.append("articles", frame(spark, ["x"]))
    remember(state, "articles", new, state.earlier("articles"), "guid")
    later = State(spark, str(tmp_path), "r3")
    assert sorted(r.guid for r in seen(later, "articles", frame(spark, ["a", "b", "x", "y"]), later.earlier("articles"), "guid").collect()) == ["a", "b", "x"]


# --- buckets -----------------------------------------------------------------------------------

DDL = "thread_id string, name string"


def named(spark, **names):
    return spark.createDataFrame(list(names.items()), DDL)


def test_a_poll_rewrites_only_its_buckets(spark, tmp_path):
    def files():
        return {str(p.relative_to(tmp_path)): os.stat(p).st_mtime_ns for p in tmp_path.rglob("*.parquet") if "threads_buckets" in str(p)}

    table = BucketTable(State(spark, str(tmp_path), "r1"), "threads", "thread_id", DDL, buckets=16)
    table.upsert(named(spark, **{f"t{i}": "old" for i in range(200)}))
    before = files()
    assert len(before) == 16
    table = BucketTable(State(spark, str(tmp_path), "r2"), "threads", "thread_id", DDL)
    assert table.touched(frame(spark, ["t3"], "thread_id")) and table.buckets == 16
    back = table.upsert(named(spark, t3="new", other="more"))
    new = {f for f in files() if f not in before}
    assert all(files()[f] == before[f] for f in before) and 1 <= len(new) <= 2
    assert back.count() < 60
    rows = {r.thread_id: r.name for r in BucketTable(State(spark, str(tmp_path), "r3"), "threads", "thread_id", DDL).read().collect()}
    assert rows == {**{f"t{i}": "old" for i in range(200)}, "t3": "new", "other": "more"}
    matching = BucketTable(State(spark, str(tmp_path), "r3"), "threads", "thread_id", DDL).matching(frame(spark, ["t3", "none"], "thread_id"))
    assert [tuple(r) for r in matching.collect()] == [("t3", "new")] and len(matching.inputFiles()) <= 2


def test_a_repeated_run_rewrites_its_buckets_from_the_same_rows(spark, tmp_path):
    def count(run_id):
        table = BucketTable(State(spark, str(tmp_path), run_id), "threads", "thread_id", DDL, buckets=4)
        buckets = list(range(4))
        table.rewrite(buckets, lambda rows: rows.unionByName(named(spark, **{run_id: "x"})))
        return table.rewrite(buckets, lambda rows: rows.unionByName(named(spark, **{f"{run_id}-2": "x"}))).count()

    assert [count("r1"), count("r1"), count("r2"), count("r2")] == [2, 2, 4, 4]
    with pytest.raises(ValueError):
        BucketTable(State(spark, str(tmp_path), "r1"), "threads", "thread_id", DDL).read()
    with pytest.raises(ValueError):
        table = BucketTable(State(spark, str(tmp_path), "r3"), "threads", "thread_id", DDL)
        table.rewrite(table.touched(frame(spark, ["r1"], "thread_id")), lambda rows: named(spark, **{f"z{i}": "x" for i in range(50)}))


def test_parents_left_as_a_snapshot_are_taken_over(spark, tmp_path):
    State(spark, str(tmp_path), "r1").write_snapshot("threads", named(spark, a="A", b="B"))
    table = parents(State(spark, str(tmp_path), "r2"), "threads")
    assert sorted(r.thread_id for r in table.matching(frame(spark, ["a", "c"], "thread_id")).collect()) == ["a"]
    table.upsert(named(spark, c="C"))
    assert sorted(r.thread_id for r in State(spark, str(tmp_path), "r3").snapshot("threads").collect()) == ["a", "b", "c"]


def test_the_kept_backlog_is_the_one_over_all_rows(spark, tmp_path):
    rng = random.Random(4)
    rows, done = [], set()
    for poll in range(5):
        state = State(spark, str(tmp_path), f"r{poll}")
        new = [(f"f{rng.randrange(6)}", f"{poll}-{i}", False) for i in range(rng.randrange(8))]
        articles = state.append("articles", spark.createDataFrame(new, "feed string, guid string, processed boolean"))
        rows += new
        for _ in range(2):  # a repeated run emits the same
            got = sorted(r.guid for r in open_rows(state, "articles", articles, "feed").collect())
            everything = spark.createDataFrame(rows, "feed string, guid string, processed boolean")
            want = backlog(everything, spark.createDataFrame(new, everything.schema), "feed", processed=frame(spark, sorted(done)))
            assert got == sorted(r.guid for r in want.collect())
            state = State(spark, str(tmp_path), f"r{poll}")
        finished = {r[1] for r in rows if rng.random() < 0.3}
        state.mark_processed("articles", frame(spark, sorted(finished)), "guid")
        done |= finished


# --- late attempts -----------------------------------------------------------------------------


def attempts(spark, rows):
    made = spark.createDataFrame(rows, "feed string, ts string, attempt_id string, outcome string, error string")
    return made.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@pytest.mark.parametrize("seed", range(3))
def test_attempts_in_any_order_give_the_result_of_one_batch(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(260):
        outcome = rng.choices(["error", "empty", "ok"], [5, 3, 1])[0]
        when = f"2024-01-{rng.randrange(1, 13):02} {rng.randrange(24):02}:{rng.randrange(60):02}:00"
        rows.append((f"f{rng.randrange(7)}", when, f"{i:04}", outcome, f"e{i}" if outcome == "error" else None))
    log = attempts(spark, rows)
    runs = health.error_runs(log)
    empty = health.empty_runs(health.attempts_made(log, runs))
    names = ("error_count", "muted", "muted_at", "last_error", "muted_reason", "no_entries_count", "longest_empty_run", "warnings")
    expected = {r.feed: tuple(r[n] for n in names) for r in runs.join(empty, "feed", "left").collect()}
    rng.shuffle(rows)
    cuts = [0, *sorted(rng.sample(range(260), 3)), 260]
    got = {}
    for n, (start, end) in enumerate(zip(cuts, cuts[1:])):
        for _ in range(2 if n == 1 else 1):  # a repeated batch counts once
            found = HealthLog(State(spark, str(tmp_path), f"b{n}")).add(attempts(spark, rows[start:end])).collect()
        got |= {r.feed: tuple(r[n] for n in names) for r in found}
    assert got == expected


# --- model calls -------------------------------------------------------------------------------


def counting_model(folder, broken=None):
    """Notes each call in a file, and fails the task at calls that a flag file does not allow yet."""

    def make():
        def complete(messages, params):
            text = messages[-1]["content"].rsplit("\n", 1)[-1]
            with open(f"{folder}/{params['model'].replace('/', '_')}.{os.getpid()}.log", "a") as log:
                log.write(text + "\n")
            if broken and text.endswith(broken) and not os.path.exists(f"{folder}/mended"):
                raise SystemExit("the machine is lost")
            return {"choices": [{"message": {"content": text.upper()}}], "model": params["model"]}

        return complete

    return make


def asked(folder):
    return [line for p in folder.glob("*.log") for line in p.read_text().split()]


def test_after_a_lost_run_stored_waves_are_not_asked_again(spark, tmp_path):
    items = spark.createDataFrame([(str(i), f"text{i}", None) for i in range(60)], "id string, content string, metadata map<string,string>")
    models = [Model("m", "v/1")]
    requests = with_prompts(fan_out(items, models), models)
    folder = tmp_path / "log"
    folder.mkdir()
    options = dict(retries=1, retry_seconds=0.0, concurrency=2, calls_per_task=5)
    with pytest.raises(Exception):
        complete_in_waves(State(spark, str(tmp_path / "s"), "r1"), "answers", requests, counting_model(folder, "7"), **options)
    before = len(asked(folder))
    (folder / "mended").touch()
    answers = complete_in_waves(State(spark, str(tmp_path / "s"), "r1"), "answers", requests, counting_model(folder, "7"), **options)
    assert sorted(r.response.split('"content": "')[1].split('"')[0] for r in answers.collect()) == sorted(f"TEXT{i}" for i in range(60))
    again = len(asked(folder)) - before
    stored = 60 - again
    # What a wave had stored is not asked again; what was lost is at most one wave and its retries.
    assert stored >= 0 and len(set(asked(folder))) == 60
    third = complete_in_waves(State(spark, str(tmp_path / "s"), "r2"), "answers", requests, counting_model(folder, "7"), **options)
    assert third.count() == 60 and len(asked(folder)) == before + again


def test_a_model_with_a_limit_is_called_by_no_more_tasks(spark, tmp_path):
    items = spark.createDataFrame([(str(i), f"text{i}", None) for i in range(80)], "id string, content string, metadata map<string,string>")
    models = [Model("a", "v/1"), Model("b", "v/2")]
    requests = with_prompts(fan_out(items, models), models)
    parts = requests.sparkSession.conf.get("spark.sql.shuffle.partitions")

    def make():
        from pyspark import TaskContext

        def complete(messages, params):
            return {"choices": [{"message": {"content": str(TaskContext.get().partitionId())}}], "model": params["model"]}

        return complete

    answers = complete_in_waves(State(spark, str(tmp_path), "r1"), "answers", requests, make, concurrency=5, limits={"v/2": 2}, retries=1)
    tasks = {}
    for r in answers.collect():
        tasks.setdefault("v/2" if '"model": "v/2"' in r.response else "v/1", set()).add(r.response.split('"content": "')[1].split('"')[0])
    assert len(tasks["v/2"]) == 2 and len(tasks["v/1"]) == 5 and not tasks["v/1"] & tasks["v/2"] and parts


def test_metrics_are_those_of_the_rows_written(spark, tmp_path):
    for run_id, n in (("r1", 5), ("r1", 4), ("r2", 0)):
        store_measured(State(spark, str(tmp_path), run_id), "articles", "articles", frame(spark, [str(i) for i in range(n)]))
    got = sorted(tuple(r) for r in run_metrics(State(spark, str(tmp_path), "reader")).collect())
    assert got == [("r1", "articles", 4, 0, 0, 0, 0), ("r2", "articles", 0, 0, 0, 0, 0)]


def test_a_task_stores_each_wave_before_its_next_calls_and_waits_for_no_other(spark, tmp_path):
    """Waves were jobs, and every wave of all tasks began with one: their number followed the input (57,285 s at 6 GB by projection)."""
    items = spark.createDataFrame([(str(i), f"text{i}", None) for i in range(60)], "id string, content string, metadata map<string,string>")
    requests = with_prompts(fan_out(items, [Model("m", "v/1")]), [Model("m", "v/1")])
    root, folder = str(tmp_path / "s"), str(tmp_path / "s" / "answers" / "run_id=r1.start1")

    def make():
        made = []

        def complete(messages, params):
            made.append(1)
            stored = [f for f in os.listdir(folder) if f.startswith(f"part-{TaskContext.get().partitionId():05d}-")]
            return {"choices": [{"message": {"content": f"{len(made)} {len(stored)}"}}], "model": params["model"]}

        from pyspark import TaskContext

        return complete

    answers = complete_in_waves(State(spark, root, "r1"), "answers", requests, make, retries=1, concurrency=2, calls_per_task=5)
    told = [r.response.split('"content": "')[1].split('"')[0].split() for r in answers.collect()]
    assert len(told) == 60 and all(int(stored) == (int(n) - 1) // 5 for n, stored in told)
