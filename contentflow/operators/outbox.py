"""Outbox: sized message parts per recipient, as rows to append. Delivery is not part of it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contentflow import values as V
from contentflow.functions.messages import numbered_part, split_message, truncate, wrap


def message_parts(
    items: DataFrame, *, max_length: int = V.MESSAGE_MAX_CHARS, split: bool = False, truncate_long: bool = True,
    prefix: str | None = None, suffix: str | None = None,
) -> DataFrame:
    """(id, part_no, part_count, text). Splitting takes precedence over truncation, so no text is lost."""
    text = wrap(F.col("content"), prefix, suffix)
    if split:
        parts = split_message(text, max_length)
    else:
        parts = F.array(truncate(text, max_length) if truncate_long else text)
    split_rows = items.select("id", parts.alias("parts")).select(
        "id", F.size("parts").alias("part_count"), F.posexplode("parts").alias("at", "part")
    )
    number = F.col("at") + 1
    return split_rows.select(
        "id", number.alias("part_no"), "part_count",
        numbered_part(number, F.col("part_count"), F.col("part")).alias("text"),
    )


def to_recipients(parts: DataFrame, recipients: Sequence[str]) -> DataFrame:
    """Every part for every recipient. Recipients are configuration: they travel inside the plan."""
    if not recipients:
        raise ValueError("no recipients")
    listed = F.array(*[F.lit(r) for r in recipients])
    return parts.withColumn("recipient", F.explode(listed))


def outbox(items: DataFrame, recipients: Sequence[str], **options) -> DataFrame:
    return to_recipients(message_parts(items, **options), recipients)


def write_outbox(messages: DataFrame, root: str, run_id: str) -> None:
    """Append the messages of a run. Writing the same run again replaces it instead of doubling it."""
    messages.write.mode("overwrite").parquet(f"{root.rstrip('/')}/run_id={run_id}")
