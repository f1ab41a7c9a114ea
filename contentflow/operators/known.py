"""Joins against stored state: unseen rows, new parents, backlog, enrichment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contentflow.operators.buckets import BucketTable
from contentflow.operators.key_store import seen
from contentflow.operators.ranking import first_per_key
from contentflow.operators.stages import conform
from contentflow.operators.state import State


def unseen(df: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not stored yet. The stored side is reduced to distinct keys before its shuffle."""
    return df.join(seen.select(key).distinct(), key, "left_anti")


def new_parents(candidates: DataFrame, stored: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """First candidate of each key that is not stored."""
    return unseen(first_per_key(candidates, [key], order), stored, key)


def get_or_create(candidates: DataFrame, stored: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """Stored parents, plus the first candidate of every new key."""
    return stored.unionByName(new_parents(candidates, stored, key, order), allowMissingColumns=True)


def backlog(children: DataFrame, new_rows: DataFrame, parent_key: str, *, processed: DataFrame | None = None,
            key: str = "guid") -> DataFrame:
    """Unprocessed children of the parents that got at least one new row in this run."""
    touched = new_rows.select(parent_key).distinct()
    open_rows = children.filter(~F.coalesce("processed", F.lit(False)))
    if processed is not None:
        open_rows = unseen(open_rows, processed, key)
    return open_rows.join(touched, parent_key, "left_semi")


def open_rows(
    state: State, table: str, new_rows: DataFrame, parent_key: str, *, key: str = "guid"
) -> DataFrame:
    """The backlog from stored state: unprocessed children of the parents that got at least one new row in this run.

    Children that are not processed yet lie in buckets of their parents. A run reads and rewrites the buckets of the parents it touches:
    it adds the new rows and takes out those that have been processed since. What a run costs follows these parents'
    open rows, not all children and all processed keys there ever were.
    """
    ddl = state._ddl(table, None)
    waiting = BucketTable(state, f"{table}_open", parent_key, ddl)
    done = f"{table}_processed"
    if waiting.folders():
        buckets, begin = waiting.touched(new_rows), None
    else:
        # The first time, what earlier runs have left open; later only the touched buckets.
        begin = backlog(state.earlier(table), state.earlier(table), parent_key, processed=state.processed(table, key), key=key)
        buckets = sorted({*waiting.touched(new_rows), *waiting.touched(begin)})

    def change(stored: DataFrame) -> DataFrame:
        rows = stored if begin is None else stored.unionByName(conform(begin, ddl))
        finished = seen(state, done, rows, state.processed(table, key), key)
        still = unseen(rows, finished, key).select(*rows.columns)
        fresh = conform(new_rows, ddl).filter(~F.coalesce("processed", F.lit(False)))
        return still.unionByName(fresh)

    rows = waiting.rewrite(buckets, change)
    return rows.join(new_rows.select(parent_key).distinct(), parent_key, "left_semi")


def enrich(entries: DataFrame, external: DataFrame, needed: Column, *, key: str = "guid") -> DataFrame:
    """Replace content by the landed page text (`url`, `external_text`) when that is longer.

    The longest text wins when an address was landed more than once. Entries that need no text get a join
    key of their own that matches nothing, so they spread over the tasks instead of piling up on NULL.
    """
    length = F.coalesce(F.length("external_text"), F.lit(0))
    # Only the pages that some entry needs are compared by length.
    wanted = entries.filter(needed).select("url").distinct()
    best = external.join(wanted, "url", "left_semi").groupBy("url").agg(F.max(F.struct(length.alias("n"), "external_text")).alias("best"))
    texts = best.select(F.col("url").alias("lookup_url"), F.col("best.external_text").alias("external_text"))
    lookup = F.when(needed, F.col("url")).otherwise(F.concat(F.lit("\0"), F.col(key)))
    joined = entries.withColumn("lookup_url", lookup).join(texts, "lookup_url", "left")
    text, content = F.col("external_text"), F.coalesce("content", F.lit(""))
    better = F.coalesce((text != "") & ((content == "") | (F.length(text) > F.length(content))), F.lit(False))
    return joined.withColumns(
        {"content": F.when(better, text).otherwise(F.col("content")), "enriched": better}
    ).drop("external_text", "lookup_url")
