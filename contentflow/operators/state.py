"""State tables in plain Parquet: children are appended per run, small tables are rewritten as snapshots.

Writing a run twice replaces what it wrote before. Parquet has no MERGE, so a snapshot table is a chain
of whole snapshots, and an append-only log names the current one; readers never see a half-written one. A root
has one writer at a time: reading the newest version and appending the next is not one step.
Parents lie in hash buckets (`buckets`), whose current folders are such a snapshot. Children are only ever added, and what
changes about them (being processed) is a log of keys, with a key store for lookups (`key_store`).
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from contentflow import schema
from contentflow.operators.stages import conform

_VERSIONS = "table string, run_id string, version bigint"


class State:
    def __init__(self, spark: SparkSession, root: str, run_id: str) -> None:
        self.spark, self.root, self.run_id = spark, root.rstrip("/"), run_id

    def of_run(self, run_id: str) -> State:
        """The same tables, written by another run."""
        return State(self.spark, self.root, run_id)

    def has(self, table: str) -> bool:
        """Whether an earlier run left a snapshot of the table."""
        return self._standing(table)["other_run"] is not None

    def _read(self, path: str, ddl: str) -> DataFrame:
        try:
            return self.spark.read.schema(ddl).parquet(path)
        except AnalysisException as problem:
            if problem.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], ddl)

    def _ddl(self, table: str, ddl: str | None) -> str:
        return ddl or schema.STATE[table]

    # children ----------------------------------------------------------------------------------
    def append(self, table: str, rows: DataFrame, ddl: str | None = None) -> DataFrame:
        """Add the rows of this run, and return them as written."""
        path = f"{self.root}/{table}/run_id={self.run_id}"
        conform(rows, self._ddl(table, ddl)).write.mode("overwrite").parquet(path)
        return self._read(path, self._ddl(table, ddl))

    def keep(self, table: str, rows: DataFrame) -> DataFrame:
        """The rows as a table of this run with the columns they have, to be read several times in it."""
        path = f"{self.root}/_runs/{table}/run_id={self.run_id}"
        rows.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def earlier(self, table: str, ddl: str | None = None) -> DataFrame:
        """The rows of all other runs: what was stored before this run."""
        whole = self._read(f"{self.root}/{table}", f"{self._ddl(table, ddl)}, run_id string")
        return whole.filter(F.col("run_id") != self.run_id).drop("run_id")

    def rows(self, table: str, ddl: str | None = None) -> DataFrame:
        return self._read(f"{self.root}/{table}", f"{self._ddl(table, ddl)}, run_id string").drop("run_id")

    def mark_processed(self, table: str, keys: DataFrame, key: str) -> None:
        """Log the keys, and add them to the store in which polls look them up."""
        from contentflow.operators.key_store import remember

        done = self.append(f"{table}_processed", keys.select(F.col(key).alias("key")).distinct(), "key string")
        remember(self, f"{table}_processed", done, self.earlier(f"{table}_processed", "key string"), "key")

    def processed(self, table: str, key: str) -> DataFrame:
        return self.earlier(f"{table}_processed", "key string").withColumnRenamed("key", key)

    # parents -----------------------------------------------------------------------------------
    def _versions(self, table: str) -> DataFrame:
        return self._read(f"{self.root}/_versions", _VERSIONS).filter(F.col("table") == table)

    def _standing(self, table: str) -> Row:
        """(own version of this run, newest version, newest run besides this one)."""
        own = F.col("run_id") == self.run_id
        return self._versions(table).agg(
            F.min(F.when(own, F.col("version"))).alias("own"),
            F.max("version").alias("newest"),
            F.max_by(F.when(~own, F.col("run_id")), F.when(~own, F.col("version"))).alias("other_run"),
        ).first()

    def snapshot(self, table: str, ddl: str | None = None) -> DataFrame:
        """The rows that this run starts from: the newest snapshot before its own, or the buckets that replaced it."""
        standing = self._standing(table)
        last = standing["other_run"]
        if standing["own"] is not None and standing["newest"] > standing["own"]:
            raise ValueError(f"run {self.run_id} of {table} is older than the current snapshot")
        if ddl is None and table in schema.PARENT_KEYS and self.has(f"{table}_folders"):
            from contentflow.operators.buckets import parents

            return parents(self, table).read()
        if last is None:
            return self.spark.createDataFrame([], self._ddl(table, ddl))
        return self._read(f"{self.root}/{table}/snapshot={last}", self._ddl(table, ddl))

    def write_snapshot(self, table: str, rows: DataFrame, ddl: str | None = None) -> DataFrame:
        path = f"{self.root}/{table}/snapshot={self.run_id}"
        conform(rows, self._ddl(table, ddl)).write.mode("overwrite").parquet(path)
        standing = self._standing(table)
        if standing["own"] is None:
            entry = self.spark.createDataFrame([(table, self.run_id, (standing["newest"] or 0) + 1)], _VERSIONS)
            entry.coalesce(1).write.mode("append").parquet(f"{self.root}/_versions")
        return self._read(path, self._ddl(table, ddl))
