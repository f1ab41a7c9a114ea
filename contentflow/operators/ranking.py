"""Newest rows per group and first row per key, safe for groups that hold much of the data.

Spark keeps only the first n rows of each group in every task before it shuffles (`row_number() <= n`
becomes a group limit), so a hot group costs n rows per task. With many tasks even that is a lot for
one reducer; `top_per_group` therefore merges the tasks' leaders in two rounds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_RANK, _SALT = "__rank", "__salt"


def _limit(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn(_RANK, rank).filter(F.col(_RANK) <= n)


def top_per_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, *, rank: str | None = None, spread: int = 64
) -> DataFrame:
    """The first n rows of each group. `order` must be total for a reproducible choice.

    The first round ranks within (group, task number modulo `spread`), which keeps one salt per task and
    so the early cut; any row of the final n survives it. Above the planner's group-limit threshold
    (`spark.sql.optimizer.windowGroupLimitThreshold`) the salt still splits a hot group.
    """
    salted = df.withColumn(_SALT, F.spark_partition_id() % spread)
    leaders = _limit(salted, [*keys, _SALT], order, n).drop(_RANK, _SALT)
    top = _limit(leaders, keys, order, n)
    return top.withColumnRenamed(_RANK, rank) if rank else top.drop(_RANK)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key. One row per key and task reaches the shuffle."""
    return _limit(df, keys, order, 1).drop(_RANK)


def newest_per_feed(
    entries: DataFrame, n: int, *, feed: str = "feed", date: str = "published_at", pos: str = "pos"
) -> DataFrame:
    """The newest n entries of each feed: undated last, ties in feed order."""
    order = [F.col(date).desc_nulls_last(), F.col(pos)]
    return top_per_group(entries, [feed], order, n, rank="rank")
