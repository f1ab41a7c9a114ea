"""Feed health: runs of errors and of empty checks, automatic muting, ingest counters.

Runs depend on the order of a feed's attempts. One feed may hold a large part of the log, so no task
ever needs a whole feed: its attempts are cut into chunks of one day (or hour), one shuffle by (feed, chunk)
brings each chunk together, and a feed's result follows from its few chunk summaries.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contentflow import values as V
from contentflow.functions.dates import utc


def _chunked(df: DataFrame, ts: str, chunk: str | Column) -> DataFrame:
    """The day or hour of each attempt, or a given expression that never falls as time rises.

    These are contiguous stretches of a feed's log, the same on every run.
    """
    if isinstance(chunk, Column):
        return df.withColumn("chunk", chunk)
    if chunk not in ("day", "hour"):
        raise ValueError(f"unknown chunk {chunk!r}")
    day = F.to_date(ts)
    return df.withColumn("chunk", day if chunk == "day" else F.struct(day.alias("day"), F.hour(ts).alias("hour")))


def _runs(df: DataFrame, feed: str, order: list[str], counts: Column, resets: Column) -> DataFrame:
    """Per row of a chunk: `run` counted from the last reset in the chunk, and whether there was one."""
    so_far = Window.partitionBy(feed, "chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    flagged = df.withColumns({"counts": counts.cast("bigint"), "resets": resets})
    totals = flagged.withColumn("total", F.sum("counts").over(so_far))
    at_reset = F.max(F.when(F.col("resets"), F.col("total"))).over(so_far)
    return totals.withColumn("at_reset", at_reset).withColumn(
        "run", F.col("total") - F.coalesce("at_reset", F.lit(0))
    )


def _carried(chunks: DataFrame, feed: str, before_log: DataFrame | None, count: str) -> DataFrame:
    """Chunk summaries with the run that the feed's earlier chunks, and its stored count, hand over."""
    if before_log is None:
        stored = F.lit(0).cast("bigint")
    else:
        counts = before_log.select(feed, F.col(count).cast("bigint").alias("stored"))
        chunks = chunks.join(counts, feed, "left")
        stored = F.coalesce("stored", F.lit(0))
    by_chunk = Window.partitionBy(feed).orderBy("chunk")
    before = by_chunk.rowsBetween(Window.unboundedPreceding, -1)
    up_to = by_chunk.rowsBetween(Window.unboundedPreceding, 0)
    sums = chunks.withColumn("tails", F.sum("tail").over(up_to))
    base = F.when(F.col("has_reset"), F.col("tails") - F.col("tail"))
    carry = F.coalesce(F.sum("tail").over(before), F.lit(0)) - F.coalesce(F.max(base).over(before), F.lit(0))
    reset_before = F.coalesce(F.max("has_reset").over(before), F.lit(False))
    return sums.withColumn("carry", carry + F.when(reset_before, 0).otherwise(stored))


def error_summaries(
    attempts: DataFrame, *, feed: str = "feed", ts: str = "ts", seq: str = "attempt_id",
    mute_after: int = V.MUTE_AFTER_ERRORS, chunk: str | Column = "day",
) -> DataFrame:
    """What a feed's chunk says about its errors, whatever comes before it.

    Summaries of a feed's chunks are all that its result needs: chunks may be summed up at any time and in any order, as long
    as a chunk is summed up as a whole.
    """
    error, ok = F.col("outcome") == "error", F.col("outcome") == "ok"
    text = F.col("error") if "error" in attempts.columns else F.lit(None).cast("string")
    log = attempts.select(feed, ts, seq, "outcome", text.alias("error"))
    rows = _runs(_chunked(log, ts, chunk), feed, [ts, seq], error, ok)
    place = F.struct(F.col(ts).alias("ts"), F.col(seq).alias("seq"), F.col("error").alias("error"))
    before_reset = F.col("at_reset").isNull()
    # The first `mute_after` errors before any reset: where the limit falls depends on what is carried in.
    # No more than that many are collected per chunk.
    leading = F.collect_list(
        F.when(error & before_reset & (F.col("run") <= mute_after), F.struct(F.col("run").alias("nth"), place.alias("at")))
    )
    return rows.groupBy(feed, "chunk").agg(
        F.max("resets").alias("has_reset"),
        F.max_by("run", F.struct(ts, seq)).alias("tail"),
        F.array_sort(leading).alias("leading"),
        F.min(F.when(error & ~before_reset & (F.col("run") >= mute_after), place)).alias("inside"),
        F.max(F.when(error, place)).alias("last_error"),
    )


def error_results(
    summaries: DataFrame, *, feed: str = "feed", mute_after: int = V.MUTE_AFTER_ERRORS, before: DataFrame | None = None
) -> DataFrame:
    """The result of `error_runs` from the summaries of a feed's chunks."""
    carried = _carried(summaries, feed, before, "error_count")
    needed = (F.lit(mute_after) - F.col("carry")).cast("int")
    reached = F.when(F.col("carry") < mute_after, F.get("leading", needed - 1)["at"])
    ends = carried.withColumns(
        {
            "muted_here": F.coalesce(reached, F.col("inside")),
            "run_end": F.when(F.col("has_reset"), F.col("tail")).otherwise(F.col("carry") + F.col("tail")),
        }
    )
    feeds = ends.groupBy(feed).agg(
        F.min("muted_here").alias("mute"),
        F.max_by("run_end", "chunk").alias("run_end"),
        F.max("last_error").alias("last"),
    )
    muted = F.col("mute").isNotNull()
    count = F.when(muted, F.lit(mute_after)).otherwise(F.col("run_end")).cast("bigint")
    last_error = F.when(muted, F.col("mute.error")).otherwise(F.when(count > 0, F.col("last.error")))
    reason = F.concat(
        F.lit(f"Auto-muted after {mute_after} consecutive errors. Last error: "),
        F.coalesce("mute.error", F.lit("None")),
    )
    return feeds.select(
        feed,
        count.alias("error_count"),
        muted.alias("muted"),
        F.col("mute.ts").alias("muted_at"),
        F.col("mute.seq").alias("muted_seq"),
        last_error.alias("last_error"),
        F.when(muted, reason).alias("muted_reason"),
    )


def error_runs(
    attempts: DataFrame, *, feed: str = "feed", ts: str = "ts", seq: str = "attempt_id",
    mute_after: int = V.MUTE_AFTER_ERRORS, before: DataFrame | None = None, chunk: str | Column = "day",
) -> DataFrame:
    """Per feed: consecutive errors at the end, and where the run reached the mute limit.

    An `error` adds one, an `ok` starts over, an `empty` check changes nothing. A muted feed keeps the
    count it was muted with. `before` (feed, error_count) holds the counts from which the log goes on.
    """
    summaries = error_summaries(attempts, feed=feed, ts=ts, seq=seq, mute_after=mute_after, chunk=chunk)
    return error_results(summaries, feed=feed, mute_after=mute_after, before=before)


def attempts_made(
    attempts: DataFrame, runs: DataFrame, *, feed: str = "feed", ts: str = "ts", seq: str = "attempt_id"
) -> DataFrame:
    """The attempts up to the one that muted their feed: later ones do not happen."""
    stops = runs.filter("muted").select(feed, "muted_at", "muted_seq")
    joined = attempts.join(stops, feed, "left")
    in_time = F.struct(F.col(ts).alias("t"), F.col(seq).alias("s")) <= F.struct(
        F.col("muted_at").alias("t"), F.col("muted_seq").alias("s")
    )
    return joined.filter(F.col("muted_at").isNull() | in_time).drop("muted_at", "muted_seq")


def empty_summaries(
    attempts: DataFrame, *, feed: str = "feed", ts: str = "ts", seq: str = "attempt_id",
    warn_after: int = V.WARN_AFTER_EMPTY, chunk: str | Column = "day",
) -> DataFrame:
    """What a feed's chunk says about its empty checks, whatever comes before it."""
    empty = F.col("outcome") == "empty"
    log = attempts.select(feed, ts, seq, "outcome")
    rows = _runs(_chunked(log, ts, chunk), feed, [ts, seq], empty, ~empty)
    before_reset = F.col("at_reset").isNull()
    return rows.groupBy(feed, "chunk").agg(
        F.max("resets").alias("has_reset"),
        F.max_by("run", F.struct(ts, seq)).alias("tail"),
        F.coalesce(F.max(F.when(before_reset, F.col("run"))), F.lit(0)).alias("leading"),
        F.max("run").alias("longest"),
        F.count_if(empty & ~before_reset & (F.col("run") > warn_after)).alias("warned_inside"),
    )


def empty_results(
    summaries: DataFrame, *, feed: str = "feed", warn_after: int = V.WARN_AFTER_EMPTY, before: DataFrame | None = None
) -> DataFrame:
    """The result of `empty_runs` from the summaries of a feed's chunks."""
    carry, leading = F.col("carry"), F.col("leading")
    over = F.greatest(carry + leading - warn_after, F.lit(0)) - F.greatest(carry - warn_after, F.lit(0))
    ends = _carried(summaries, feed, before, "no_entries_count").withColumns(
        {
            "warned": F.col("warned_inside") + over,
            "run_end": F.when(F.col("has_reset"), F.col("tail")).otherwise(carry + F.col("tail")),
            "longest_here": F.greatest("longest", F.when(leading > 0, carry + leading).otherwise(0)),
        }
    )
    return ends.groupBy(feed).agg(
        F.max_by("run_end", "chunk").cast("bigint").alias("no_entries_count"),
        F.max("longest_here").cast("bigint").alias("longest_empty_run"),
        F.sum("warned").cast("bigint").alias("warnings"),
    )


def empty_runs(
    attempts: DataFrame, *, feed: str = "feed", ts: str = "ts", seq: str = "attempt_id",
    warn_after: int = V.WARN_AFTER_EMPTY, before: DataFrame | None = None, chunk: str | Column = "day",
) -> DataFrame:
    """Per feed: consecutive empty checks at the end, the longest run, and checks over the warning limit.

    `before` (feed, no_entries_count) holds the counts from which the log goes on.
    """
    summaries = empty_summaries(attempts, feed=feed, ts=ts, seq=seq, warn_after=warn_after, chunk=chunk)
    return empty_results(summaries, feed=feed, warn_after=warn_after, before=before)


def ingest_stats(new_rows: DataFrame, flag: str, *, parent: str = "feed", flag_as: str = "enriched_items") -> DataFrame:
    """Per parent: new rows, and how many of them were enriched (articles) or transcribed (episodes)."""
    return new_rows.groupBy(parent).agg(
        F.count(F.lit(1)).alias("new_items"), F.count_if(F.col(flag)).alias(flag_as)
    )


def update_counters(feeds: DataFrame, stats: DataFrame, checked: DataFrame, as_of: datetime | str) -> DataFrame:
    """Feeds with raised article counts and check times. Feeds that were not checked stay as they are."""
    now = utc(as_of)
    counts = stats.select(F.col("feed").alias("url"), "new_items")
    tried = checked.select(F.col("feed").alias("url")).distinct().withColumn("tried", F.lit(True))
    joined = feeds.join(counts, "url", "left").join(tried, "url", "left")
    new = F.coalesce("new_items", F.lit(0))
    return joined.withColumns(
        {
            "article_count": F.coalesce("article_count", F.lit(0)) + new,
            "last_updated": F.when(new > 0, now).otherwise(F.col("last_updated")),
            "last_checked": F.when(F.col("tried"), now).otherwise(F.col("last_checked")),
        }
    ).drop("new_items", "tried")


def with_health(
    feeds: DataFrame, attempts: DataFrame, store: Callable[[DataFrame], DataFrame], chunk: str | Column = "day"
) -> DataFrame:
    """Feeds with error count, empty count and muting after the new attempts.

    The counts go on from the stored ones, so a poll only reads its own attempts. Attempts of feeds that
    are muted already do not happen. `store` keeps the runs, one row per feed, because they are used three times.
    """
    muted = feeds.filter("muted").select(F.col("url").alias("feed"))
    stored = feeds.select(F.col("url").alias("feed"), "error_count", "no_entries_count")
    tried = attempts.join(muted, "feed", "left_anti")
    runs = store(error_runs(tried, before=stored, chunk=chunk))
    empty = empty_runs(attempts_made(tried, runs), before=stored, chunk=chunk)
    told = runs.join(empty.select("feed", F.col("no_entries_count").alias("empty_now")), "feed", "left").select(
        F.col("feed").alias("url"), F.col("error_count").alias("errors_now"), F.col("muted").alias("muted_now"),
        F.col("muted_reason").alias("reason_now"), F.col("last_error").alias("error_now"), "empty_now",
    )
    now = F.col("errors_now")
    return feeds.join(told, "url", "left").withColumns(
        {
            "error_count": F.coalesce(now, "error_count"),
            "no_entries_count": F.coalesce("empty_now", "no_entries_count"),
            "muted": F.coalesce("muted", F.lit(False)) | F.coalesce("muted_now", F.lit(False)),
            "muted_reason": F.coalesce("muted_reason", "reason_now"),
            "last_error": F.when(now == 0, None).otherwise(F.coalesce("error_now", "last_error")),
        }
    ).drop("errors_now", "muted_now", "reason_now", "error_now", "empty_now")
