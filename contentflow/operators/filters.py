"""Row filters: look-back, muted parents, content types, required fields, success."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contentflow import values as V
from contentflow.functions.dates import minus_days, utc
from contentflow.functions.text import non_empty


def within_lookback(
    df: DataFrame, date: str, as_of: datetime | str, lookback_days: float = V.LOOKBACK_DAYS
) -> DataFrame:
    """Rows since the cutoff; undated rows stay."""
    return df.filter(F.col(date).isNull() | (F.col(date) >= utc(minus_days(as_of, lookback_days))))


def active(parents: DataFrame) -> DataFrame:
    return parents.filter(~F.coalesce("muted", F.lit(False)))


def of_active_parents(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Children whose parent is not muted. Children of unknown parents stay."""
    muted = parents.filter(F.col("muted")).select(key)
    return children.join(muted, key, "left_anti")


def accepts(types: str | Sequence[str]) -> Column:
    return F.col("content_type").isin(*([types] if isinstance(types, str) else types))


def only_types(items: DataFrame, types: str | Sequence[str]) -> DataFrame:
    """The items a stage can handle; the others are left out."""
    return items.filter(accepts(types))


def gate_types(items: DataFrame, types: str | Sequence[str]) -> DataFrame:
    """All items, those of other types as failed rows."""
    ok = F.coalesce(accepts(types), F.lit(False))
    reason = F.concat(F.lit("Cannot handle data of type "), F.coalesce("content_type", F.lit("None")))
    return items.withColumns({"success": ok, "error_message": F.when(~ok, reason)})


def with_required(df: DataFrame, *columns: str) -> DataFrame:
    """Rows where none of the columns is NULL or empty."""
    for column in columns:
        df = df.filter(non_empty(F.col(column)).isNotNull())
    return df


def split_success(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(successful, failed) rows."""
    ok = F.coalesce("success", F.lit(False))
    return results.filter(ok), results.filter(~ok)


def union_inputs(inputs: dict[str, DataFrame]) -> DataFrame:
    """All inputs of a stage in one frame, with the name of the input each row came from."""
    named = [df.withColumn("input_name", F.lit(name)) for name, df in inputs.items()]
    if not named:
        raise ValueError("no inputs")
    whole = named[0]
    for df in named[1:]:
        whole = whole.unionByName(df, allowMissingColumns=True)
    return whole
