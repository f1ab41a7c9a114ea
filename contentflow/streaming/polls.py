"""Incremental polls: landed folders as streams, state tables as memory between batches.

Each poll takes what has landed since the last one (`availableNow`) and stops; when polls run is the
matter of whatever starts them. A batch writes under its own run id, so a batch that is repeated after a
failure replaces its own rows.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contentflow.operators.buckets import parents
from contentflow.operators.health_log import HealthLog
from contentflow.operators.key_store import remember, seen
from contentflow.operators.known import unseen
from contentflow.operators.ranking import first_per_key
from contentflow.operators.state import State
from contentflow.plans.articles import ingest_articles
from contentflow.plans.conversations import check_messages
from contentflow.plans.pipelines import poll_podcasts


def landed(spark: SparkSession, path: str, ddl: str, *, files_per_batch: int | None = None) -> DataFrame:
    """A folder of landed Parquet files as a stream."""
    reader = spark.readStream.schema(ddl)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def poll(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, str], None]) -> None:
    """Process everything that is new, batch by batch, and return; `each` gets the batch and its run id."""

    def run(batch: DataFrame, batch_id: int) -> None:
        # Streams plan without adaptive execution; the joins inside a batch are ordinary batch joins.
        batch.sparkSession.conf.set("spark.sql.adaptive.enabled", "true")
        each(batch, f"batch-{batch_id:012d}")

    stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(
        availableNow=True
    ).start().awaitTermination()


def ingest_stream(stream: DataFrame, feeds: DataFrame, root: str, *, as_of: datetime | str, **options) -> None:
    """Store the new articles of landed entries. Undated entries pass the look-back, so it is no watermark."""

    def each(batch: DataFrame, run_id: str) -> None:
        state = State(batch.sparkSession, root, run_id)
        earlier = state.earlier("articles")
        known = seen(state, "articles", batch, earlier, "guid")
        articles = state.append("articles", ingest_articles(batch, feeds, known, as_of=as_of, **options))
        remember(state, "articles", articles, earlier, "guid")

    poll(stream, f"{root}/_checkpoints/articles", each)


def message_stream(stream: DataFrame, landed: dict[str, DataFrame], root: str, *, as_of: datetime | str, **options) -> None:
    """Store the new messages and threads of landed messages; `landed` holds the other tables of the history."""

    def each(batch: DataFrame, run_id: str) -> None:
        check_messages(State(batch.sparkSession, root, run_id), {**landed, "message": batch}, as_of=as_of, **options)

    poll(stream, f"{root}/_checkpoints/messages", each)


def podcast_stream(
    stream: DataFrame, heads: DataFrame, transcripts: DataFrame, root: str, *, as_of: datetime | str, **options
) -> None:
    """Store the new podcasts and episodes of landed entries, with the transcripts that are there."""

    def each(batch: DataFrame, run_id: str) -> None:
        poll_podcasts(State(batch.sparkSession, root, run_id), batch, heads, transcripts, as_of=as_of, **options)

    poll(stream, f"{root}/_checkpoints/episodes", each)


def remember_keys(stream: DataFrame, key: str, order: list[str], root: str, table: str, ddl: str) -> None:
    """Exact dedupe without a time limit: store the first row of every key that no earlier batch stored."""

    def each(batch: DataFrame, run_id: str) -> None:
        state = State(batch.sparkSession, root, run_id)
        first = first_per_key(batch, [key], [F.col(c) for c in order])
        earlier = state.earlier(table, ddl)
        kept = state.append(table, unseen(first, seen(state, table, first, earlier, key), key), ddl)
        remember(state, table, kept, earlier, key)

    poll(stream, f"{root}/_checkpoints/{table}", each)


def dedupe_within(stream: DataFrame, key: list[str], time: str, delay: str) -> DataFrame:
    """Dedupe with bounded memory: copies that come within the delay are dropped."""
    timed = stream.withColumn(time, F.col(time).cast("timestamp"))
    return timed.withWatermark(time, delay).dropDuplicatesWithinWatermark(key)


def health_stream(stream: DataFrame, root: str) -> None:
    """Keep feed health from attempts (feed, ts, attempt_id, outcome, error), whatever their order and batches."""

    def each(batch: DataFrame, run_id: str) -> None:
        state = State(batch.sparkSession, root, run_id)
        found = HealthLog(state, batch.schema["attempt_id"].dataType.simpleString()).add(batch).withColumnRenamed("feed", "url")
        table = parents(state, "feeds")
        known = table.matching(found).drop("muted", "muted_reason", "error_count", "no_entries_count", "last_error")
        now = found.select("url", "muted", "muted_reason", "error_count", "no_entries_count", "last_error")
        table.upsert(state.keep("feeds_now", now.join(known, "url", "left")))

    poll(stream, f"{root}/_checkpoints/feeds", each)
