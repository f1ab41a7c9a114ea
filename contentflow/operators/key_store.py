"""Keys that were seen before, in segments of hash buckets with a Bloom filter each.

A poll adds one small segment. A lookup asks the filters first, and reads only the buckets in which one of its keys may be; whether a
key is stored is then read from the bucket itself, so the answer is exact. Segments of one level are merged into one of the
next as soon as there are `FAN` of them, so a store of n polls has about log n segments, and a key is rewritten as often.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contentflow.operators.buckets import bucket_of
from contentflow.operators.state import State

BUCKETS, FAN = 64, 8
#: Bits of a slot: the bitmaps of Spark's `bitmap_construct_agg`. A key's bits all lie in one slot.
SLOT_BITS = 32_768
#: Keys that a slot is made for: one in a thousand other keys passes a filter with so many.
SLOT_KEYS = 1_600
PROBES = 4

_SEGMENTS = "segment string, level int, slots int"
_KEYS = "key string, bucket int"
_FILTERS = "slot int, bits binary, bucket int"


def _places(key: Column) -> list[Column]:
    """The bits of a key, from two hashes."""
    one, two = F.xxhash64(F.lit(1), key), F.xxhash64(F.lit(2), key)
    first, step = F.pmod(one, F.lit(SLOT_BITS)), F.pmod(two, F.lit(SLOT_BITS // 2)) * 2 + 1
    return [F.pmod(first + step * i, F.lit(SLOT_BITS)).cast("long") for i in range(PROBES)]


def _slot(key: Column, slots: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(3), key), F.lit(slots)).cast("int")


def _has(bits: Column, place: Column) -> Column:
    octet = F.conv(F.hex(F.substring(bits, (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.bit_get(octet, F.pmod(place, F.lit(8)).cast("int")) == 1


class KeyStore:
    """The keys of one table of a state root. A store is used with the number of buckets that it was begun with."""

    def __init__(self, state: State, table: str, buckets: int = BUCKETS, fan: int = FAN) -> None:
        self.state, self.table, self.buckets, self.fan = state, table, buckets, fan
        self.root = f"{state.root}/{table}_keys"

    def segments(self) -> list[tuple[str, int, int]]:
        """(segment, level, slots) that this run starts from: less than `fan` of each level."""
        rows = self.state.snapshot(f"{self.table}_segments", _SEGMENTS).collect()
        return sorted(tuple(r) for r in rows)

    def _read(self, kind: str, segments: list[str], ddl: str, buckets: list[int] | None = None) -> DataFrame:
        spark = self.state.spark
        if not segments:
            return spark.createDataFrame([], f"{ddl}, segment string")
        # Buckets are folders of a segment: those that are not asked for are never opened.
        rows = spark.read.schema(f"{ddl}, segment string").option("basePath", f"{self.root}/{kind}").parquet(
            *(f"{self.root}/{kind}/segment={s}" for s in segments)
        )
        return rows if buckets is None else rows.filter(F.col("bucket").isin(buckets))

    def may_hold(self, keys: DataFrame) -> DataFrame:
        """(key, bucket) of the distinct keys that pass a filter: all stored ones, and about one in a thousand others."""
        segments = self.segments()
        places = [F.struct(F.lit(s).alias("segment"), _slot(F.col("key"), slots).alias("slot")) for s, _, slots in segments]
        if not places:
            return self.state.spark.createDataFrame([], _KEYS)
        wanted = keys.select("key").distinct().select(
            "key", bucket_of(F.col("key"), self.buckets).alias("bucket"), F.explode(F.array(*places)).alias("at")
        ).select("key", "bucket", "at.*")
        filters = self._read("filters", [s for s, _, _ in segments], _FILTERS)
        passed = wanted.join(filters, ["segment", "bucket", "slot"])
        for place in _places(F.col("key")):
            passed = passed.filter(_has(F.col("bits"), place))
        return passed.select("key", "bucket").distinct()

    def stored(self, rows: DataFrame, key: str) -> DataFrame:
        """(key) of the stored keys among those of the rows, exactly. Null keys are never stored."""
        keys = rows.select(F.col(key).cast("string").alias("key")).filter("key is not null")
        may = self.state.keep(f"{self.table}_lookup", self.may_hold(keys))
        # Bounded by the number of buckets.
        buckets = sorted(r["bucket"] for r in may.select("bucket").distinct().collect())
        found = self.lookup(may, buckets)
        return found.select(F.col("key").alias(key))

    def lookup(self, may: DataFrame, buckets: list[int]) -> DataFrame:
        held = self._read("keys", [s for s, _, _ in self.segments()] if buckets else [], _KEYS, buckets)
        return may.join(held, ["bucket", "key"], "left_semi")

    def _write(self, segment: str, level: int, keys: DataFrame) -> list[tuple[str, int, int]]:
        path = f"{self.root}/keys/segment={segment}"
        keys.select("key", bucket_of(F.col("key"), self.buckets).alias("bucket")).distinct().repartition("bucket").write.partitionBy(
            "bucket"
        ).mode("overwrite").parquet(path)
        rows = self.state.spark.read.schema(_KEYS).parquet(path)
        count = rows.count()
        slots = -(-count // (self.buckets * SLOT_KEYS))
        if not count:
            return []
        bits = rows.select("bucket", _slot(F.col("key"), slots).alias("slot"), F.explode(F.array(*_places(F.col("key")))).alias("place"))
        filters = bits.groupBy("bucket", "slot").agg(F.bitmap_construct_agg("place").alias("bits"))
        filters.repartition("bucket").write.partitionBy("bucket").mode("overwrite").parquet(f"{self.root}/filters/segment={segment}")
        return [(segment, level, slots)]

    def add(self, rows: DataFrame, key: str) -> None:
        """Store the keys of this run. A repeated run stores its segment again."""
        run = self.state.run_id
        live = [*self.segments(), *self._write(f"{run}.0", 0, rows.select(F.col(key).cast("string").alias("key")).filter("key is not null"))]
        level = 0
        while len(full := [s for s, its, _ in live if its == level]) >= self.fan:
            merged = self._write(f"{run}.{level + 1}", level + 1, self._read("keys", full, _KEYS).select("key"))
            live = [s for s in live if s[1] != level] + merged
            level += 1
        listed = self.state.spark.createDataFrame(sorted(live), _SEGMENTS)
        self.state.write_snapshot(f"{self.table}_segments", listed.coalesce(1), _SEGMENTS)


def seen(state: State, table: str, rows: DataFrame, earlier: DataFrame, key: str) -> DataFrame:
    """(key) of the rows' keys that earlier runs have stored.

    `earlier` are the stored rows themselves. They are read only as long as no poll has begun a key store.
    """
    store = KeyStore(state, table)
    return store.stored(rows, key) if store.segments() else earlier.select(key)


def remember(state: State, table: str, rows: DataFrame, earlier: DataFrame, key: str) -> None:
    """Store the keys of this run; the first time, those of the earlier rows too."""
    store = KeyStore(state, table)
    store.add(rows.select(key) if store.segments() else rows.select(key).union(earlier.select(key)), key)
