"""Extension points: ingestors, processors and outputs as plain functions on frames."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from contentflow import schema
from contentflow.operators.filters import gate_types, only_types, split_success, union_inputs
from contentflow.sources.items import no_metrics

Ingestor = Callable[[SparkSession, Mapping[str, Any]], DataFrame]  # -> items
Processor = Callable[[DataFrame], DataFrame]  # items -> results
Output = Callable[[DataFrame], DataFrame]  # results -> (id, ok, error)


def conform(df: DataFrame, ddl: str) -> DataFrame:
    """The columns of a schema, in its order and with its types; missing ones as NULL."""
    wanted = StructType.fromDDL(ddl)
    present = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in present else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in wanted.fields
        ]
    )


def ingest(spark: SparkSession, ingestor: Ingestor, **options: Any) -> DataFrame:
    return conform(ingestor(spark, options), schema.ITEM)


def as_results(items: DataFrame) -> DataFrame:
    """Items as successful results."""
    return conform(
        items.withColumns({"success": F.lit(True), "result_metrics": no_metrics()}), schema.RESULT
    )


def process(
    inputs: Mapping[str, DataFrame] | DataFrame,
    processor: Processor,
    *,
    accepts: str | Sequence[str],
    output_type: str = "text",
    others: str = "drop",
) -> DataFrame:
    """Run a processor over one or several inputs.

    Items of other types are left out (`drop`) or come back as failed rows (`fail`). Results take the
    output type, whatever the processor set; failures stay rows with their message.
    """
    items = union_inputs(dict(inputs)) if isinstance(inputs, Mapping) else inputs
    if others == "drop":
        accepted = only_types(items, accepts)
    elif others == "fail":
        accepted, refused = split_success(gate_types(items, accepts))
        accepted = accepted.drop("success", "error_message")
    else:
        raise ValueError(f"unknown handling of other types {others!r}")
    results = conform(processor(accepted), schema.RESULT)
    if others == "fail":
        results = results.unionByName(conform(refused, schema.RESULT))
    return results.withColumn("content_type", F.lit(output_type))


def pass_failed(results: DataFrame, processor: Processor) -> DataFrame:
    """Process the good results; failed ones pass through untouched."""
    good, bad = split_success(results)
    again = processor(good.select(*schema.ITEM_COLUMNS))
    return conform(again, schema.RESULT).unionByName(conform(bad, schema.RESULT))


def deliver(
    results: DataFrame, output: Output, *, accepts: Sequence[str] = ("text", "markdown"), failed: str = "skip"
) -> DataFrame:
    """(id, ok, error) per accepted result.

    Failed results are not handed to the output and come back as not delivered (`skip`), or are put out
    like the others with the content they kept (`deliver`).
    """
    accepted = only_types(results, accepts)
    if failed == "deliver":
        return output(accepted).select("id", "ok", "error")
    if failed != "skip":
        raise ValueError(f"unknown handling of failed results {failed!r}")
    good, bad = split_success(accepted)
    undelivered = bad.select("id", F.lit(False).alias("ok"), F.col("error_message").alias("error"))
    return output(good).select("id", "ok", "error").unionByName(undelivered)
