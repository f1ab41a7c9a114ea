"""State tables in hash buckets: a poll reads and rewrites the buckets that it touches, whatever else is stored.

A table's current state is a list that names, for each bucket, the folder that holds it. A change writes the touched buckets into folders of
its run and then a new list, as a snapshot of `State`. Readers see the old list or the new one, and repeating a run starts
from the list before it. The list has a row per bucket, so it is bounded by the number of buckets, and so is what the driver
learns about a poll: the numbers of the buckets that it touches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contentflow import schema
from contentflow.operators.stages import conform
from contentflow.operators.state import State

BUCKETS = 64
_LIST = "bucket int, folder string"


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key.cast("string")), F.lit(buckets)).cast("int")


class BucketTable:
    """Rows of one table of a state root, in buckets by the hash of `key`. The number of buckets stays as it was first written."""

    def __init__(self, state: State, table: str, key: str, ddl: str, buckets: int = BUCKETS) -> None:
        self.state, self.table, self.key, self.ddl, self.buckets = state, table, key, ddl, buckets
        self.root = f"{state.root}/{table}_buckets"
        self._folders: dict[int, str] | None = None
        self._step = 0

    def folders(self) -> dict[int, str]:
        """Folder of each bucket that has rows, as this run finds it or has left it. Bucket -1 tells how many there are."""
        if self._folders is None:
            rows = self.state.snapshot(f"{self.table}_folders", _LIST).collect()
            self._folders = {r["bucket"]: r["folder"] for r in rows}
            if -1 in self._folders:
                self.buckets = int(self._folders[-1])
        return {b: f for b, f in self._folders.items() if b >= 0}

    def touched(self, keys: DataFrame) -> list[int]:
        """The buckets in which the keys (a column named like the table's key) may be."""
        self.folders()
        rows = keys.select(bucket_of(F.col(self.key), self.buckets).alias("bucket")).distinct().collect()
        return sorted(r["bucket"] for r in rows)

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """The rows of the buckets, of all unless told."""
        known = self.folders()
        paths = [f"{self.root}/{known[b]}/bucket={b}" for b in sorted(known) if buckets is None or b in set(buckets)]
        spark = self.state.spark
        return spark.read.schema(self.ddl).parquet(*paths) if paths else spark.createDataFrame([], self.ddl)

    def rewrite(self, buckets: list[int], change: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """Replace the rows of the buckets by what `change` makes of them, and return these. Other buckets are neither read nor written."""
        known = self.folders()
        if not buckets:
            return self.read([])
        self._step += 1
        folder = f"run_id={self.state.run_id}/step={self._step}"
        rows = conform(change(self.read(buckets)), self.ddl)
        placed = rows.withColumn("bucket", bucket_of(F.col(self.key), self.buckets))
        # One task writes a bucket, so a bucket is a file.
        path = f"{self.root}/{folder}"
        placed.repartition(len(buckets), "bucket").write.partitionBy("bucket").mode("overwrite").parquet(path)
        spark = self.state.spark
        written = spark.read.schema(f"{self.ddl}, bucket int").parquet(path)
        full = {r["bucket"] for r in written.select("bucket").distinct().collect()}
        if not full <= set(buckets):
            raise ValueError(f"{self.table}: rows of buckets that were not to be changed")
        kept = {b: f for b, f in known.items() if b not in set(buckets)}
        self._folders = {**kept, **{b: folder for b in full}, -1: str(self.buckets)}
        listed = spark.createDataFrame(sorted(self._folders.items()), _LIST)
        self.state.write_snapshot(f"{self.table}_folders", listed.coalesce(1), _LIST)
        return self.read(buckets)

    def upsert(self, rows: DataFrame) -> DataFrame:
        """Replace or add rows, one per key, and return the touched buckets. The rows are read twice."""

        def change(stored: DataFrame) -> DataFrame:
            new = conform(rows, self.ddl)
            return stored.join(new.select(self.key), self.key, "left_anti").select(*new.columns).unionByName(new)

        return self.rewrite(self.touched(rows), change)

    def matching(self, keys: DataFrame) -> DataFrame:
        """The stored rows whose key is among the keys. Only their buckets are read."""
        wanted = keys.select(self.key).distinct()
        return self.read(self.touched(wanted)).join(wanted, self.key, "left_semi")


def parents(state: State, table: str) -> BucketTable:
    """A parent table. One that an earlier version of this engine left as a whole snapshot is taken over by the first poll."""
    made = BucketTable(state, table, schema.PARENT_KEYS[table], schema.STATE[table])
    if not made.folders() and state.has(table):
        whole = state.snapshot(table)
        made.rewrite(list(range(made.buckets)), lambda none: none.unionByName(conform(whole, made.ddl)))
    return made
