"""Runs of errors and empty checks against a plain loop, with feeds that span many chunks."""

import random

from pyspark.sql import functions as F

from contentflow.operators import health


def model(attempts, errors=0, empties=0, mute_after=5):
    """(error count, muted at, last error, attempts made, empty count, longest, warnings) of one feed in order."""
    muted, last, made, longest, warned = None, None, 0, 0, 0
    for ts, _, outcome, error in attempts:
        made += 1
        if outcome == "empty":
            empties += 1
            longest, warned = max(longest, empties), warned + (empties > 5)
            continue
        empties = 0
        if outcome == "ok":
            errors, last = 0, None
        else:
            errors, last = errors + 1, error
            if errors >= mute_after:
                muted = ts
                break
    return errors, muted, last, made, empties, longest, warned


def make_log(seed, feeds=6, count=3000):
    rng = random.Random(seed)
    log = []
    for i in range(count):
        # One feed holds about half of the log.
        feed = "hot" if rng.random() < 0.5 else f"f{rng.randrange(feeds)}"
        weights = {"hot": (40, 45, 15), "f0": (1, 0, 20), "f1": (0, 1, 30)}.get(feed, (3, 1, 3))
        outcome = rng.choices(["ok", "error", "empty"], weights)[0]
        log.append((feed, i // 3, i, outcome, f"e{i}" if outcome == "error" else None))
    return log


def by_hundred():
    return F.floor(F.col("ts") / 100)


DDL = "feed string, ts long, attempt_id long, outcome string, error string"


def test_runs_equal_the_loop(spark):
    for seed in (1, 2, 3):
        log = make_log(seed)
        df = spark.createDataFrame(log, DDL).repartition(5)
        runs = health.error_runs(df, chunk=by_hundred())
        got = {r.feed: r for r in runs.collect()}
        made = {r.feed: r["count"] for r in health.attempts_made(df, runs).groupBy("feed").count().collect()}
        empty = {r.feed: r for r in health.empty_runs(health.attempts_made(df, runs), chunk=by_hundred()).collect()}
        for feed in {r[0] for r in log}:
            own = sorted((r[1], r[2], r[3], r[4]) for r in log if r[0] == feed)
            errors, muted, last, n, empties, longest, warned = model(own)
            r, e = got[feed], empty[feed]
            assert (r.error_count, r.muted_at, r.last_error, made[feed]) == (errors, muted, last, n), (seed, feed)
            assert (e.no_entries_count, e.longest_empty_run, e.warnings) == (empties, longest, warned), (seed, feed)
            assert r.muted == (muted is not None)


def test_a_long_run_without_reset_spans_chunks(spark):
    log = [("hot", i, i, "empty", None) for i in range(2000)] + [("hot", 2000 + i, 2000 + i, "error", f"e{i}") for i in range(2000)]
    df = spark.createDataFrame(log, DDL)
    run = health.error_runs(df, mute_after=1500, chunk=by_hundred()).first()
    assert (run.error_count, run.muted_at, run.last_error) == (1500, 3499, "e1499")
    empty = health.empty_runs(df.filter("outcome = 'empty'"), chunk=by_hundred()).first()
    assert (empty.no_entries_count, empty.longest_empty_run, empty.warnings) == (2000, 2000, 1995)


def test_the_hot_feed_is_split(spark):
    df = spark.createDataFrame([("hot", i, i, "ok", None) for i in range(8000)], DDL)
    sizes = [r["count"] for r in health._chunked(df, "ts", F.floor(F.col("ts") / 1000)).groupBy("chunk").count().collect()]
    assert sizes == [1000] * 8


def test_the_log_is_shuffled_once(spark):
    df = spark.createDataFrame([("f", "2024-01-01 00:00:00", i, "ok", None) for i in range(9)], "feed string, ts string, attempt_id long, outcome string, error string")
    for chunk in ("day", "hour"):
        runs = health.error_runs(df.withColumn("ts", F.col("ts").cast("timestamp_ntz")), chunk=chunk)
        plan = runs._jdf.queryExecution().executedPlan().toString()
        # The log by (feed, chunk), and the chunk summaries by feed.
        assert plan.count("Exchange hashpartitioning") == 2 and "rangepartitioning" not in plan
        assert runs.count() == 1


def test_counts_go_on_from_stored_ones(spark):
    log = make_log(9)
    whole = {r.feed: r for r in health.error_runs(spark.createDataFrame(log, DDL), chunk=by_hundred()).collect()}
    feeds = spark.createDataFrame(
        [(f, False, 0, 0, None, None) for f in {r[0] for r in log}],
        "url string, muted boolean, error_count long, no_entries_count long, muted_reason string, last_error string",
    )
    for start in range(0, len(log), 700):
        after = health.with_health(feeds, spark.createDataFrame(log[start : start + 700], DDL), lambda runs: runs, by_hundred())
        feeds = spark.createDataFrame(after.select(*feeds.columns).collect(), feeds.schema)
    for r in feeds.collect():
        own = sorted((x[1], x[2], x[3], x[4]) for x in log if x[0] == r.url)
        errors, muted, last, _, empties, _, _ = model(own)
        assert (r.error_count, r.muted, r.last_error, r.no_entries_count) == (errors, muted is not None, last, empties)
        assert r.muted_reason == whole[r.url].muted_reason
