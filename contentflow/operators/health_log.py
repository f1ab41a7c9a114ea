"""Feed health from attempts that land in any order and in any batches.

A run of errors or of empty checks depends on the order of all attempts, so counts cannot be carried on past an attempt that comes late.
Kept are the attempts themselves and, for each feed and day, a summary of that day. A batch sums up anew the days that it touches, from
these days' attempts alone; a feed's health is what its summaries say together. The result is that of one batch of all attempts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contentflow.operators.buckets import BucketTable
from contentflow.operators.health import empty_results, empty_summaries, error_results, error_summaries
from contentflow.operators.state import State


def _attempt(seq: str) -> str:
    return f"feed string, ts timestamp_ntz, attempt_id {seq}, outcome string, error string"


def _day(seq: str) -> str:
    place = f"struct<ts:timestamp_ntz,seq:{seq},error:string>"
    return f"""feed string, chunk date,
        errors struct<has_reset:boolean,tail:bigint,leading:array<struct<nth:bigint,at:{place}>>,inside:{place},last_error:{place}>,
        empties struct<has_reset:boolean,tail:bigint,leading:bigint,longest:bigint,warned_inside:bigint>"""


class HealthLog:
    """The attempts of a state root by run and day, and the summaries of each feed's days in buckets of the feeds.

    Attempts at one time are ordered by `attempt_id`, whose type is `seq`.
    """

    def __init__(self, state: State, seq: str = "string") -> None:
        self.state, self.seq = state, seq
        self.days = BucketTable(state, "health_days", "feed", _day(seq))
        self.path = f"{state.root}/attempt_log"

    def _attempts(self, days: list) -> DataFrame:
        """All attempts of some days, of every run. Days are folders: others are not read."""
        rows = self.state.spark.read.schema(f"{_attempt(self.seq)}, run_id string, day date").parquet(self.path)
        return rows.filter(F.col("day").isin(days)).select("feed", "ts", "attempt_id", "outcome", "error", "day")

    def add(self, attempts: DataFrame) -> DataFrame:
        """Store attempts and return the health of their feeds: (feed, error_count, muted, ..., no_entries_count, warnings)."""
        state = self.state
        batch = attempts.select(F.col("feed").cast("string").alias("feed"), "ts", F.col("attempt_id").cast(self.seq).alias("attempt_id"), "outcome", "error")
        path = f"{self.path}/run_id={state.run_id}"
        batch.withColumn("day", F.to_date("ts")).write.partitionBy("day").mode("overwrite").parquet(path)
        mine = state.spark.read.schema(f"{_attempt(self.seq)}, day date").parquet(path)
        # One row per day of the batch.
        days = sorted(r["day"] for r in mine.select("day").distinct().collect())
        touched = state.keep("health_touched", mine.select("feed", "day").distinct())
        log = self._attempts(days).join(touched, ["feed", "day"], "left_semi")
        new = state.keep("health_new_days", self._summaries(log))
        buckets = self.days.touched(touched)
        feeds = touched.select("feed").distinct()

        def change(stored: DataFrame) -> DataFrame:
            return stored.join(new.select("feed", "chunk"), ["feed", "chunk"], "left_anti").select(*new.columns).unionByName(new)

        return self.health(self.days.rewrite(buckets, change).join(feeds, "feed", "left_semi"))

    @staticmethod
    def _summaries(log: DataFrame) -> DataFrame:
        errors, empties = error_summaries(log), empty_summaries(log)
        errors = errors.select("feed", "chunk", F.struct("has_reset", "tail", "leading", "inside", "last_error").alias("errors"))
        empties = empties.select("feed", "chunk", F.struct("has_reset", "tail", "leading", "longest", "warned_inside").alias("empties"))
        return errors.join(empties, ["feed", "chunk"])

    def health(self, summaries: DataFrame) -> DataFrame:
        """What the summaries of whole feeds say. Attempts behind the one that muted their feed do not count."""
        state = self.state
        runs = state.keep("health_runs", error_results(summaries.select("feed", "chunk", "errors.*")))
        stops = runs.filter("muted").select("feed", "muted_at", "muted_seq", F.to_date("muted_at").alias("muted_day"))
        days = summaries.select("feed", "chunk", "empties.*").join(stops, "feed", "left")
        before = days.filter("muted_day is null or chunk < muted_day").drop("muted_at", "muted_seq", "muted_day")
        # The day of the muting counts up to it, so it is summed up again from its attempts.
        last = sorted(r["muted_day"] for r in stops.select("muted_day").distinct().collect())
        if last:
            cut = self._attempts(last).join(stops, "feed").filter(
                "day = muted_day and struct(ts AS t, attempt_id AS s) <= struct(muted_at AS t, muted_seq AS s)"
            )
            before = before.unionByName(empty_summaries(cut))
        return runs.join(empty_results(before), "feed", "left")
