"""Sharding by sampled splitters: equal bytes in each shard, in the order of a key. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F, Window

from contentflow.llm.folders import stored, unused

#: Splitters aim at ranges of so many bytes of text, whose rows one task can order.
RANGE_BYTES = 4 << 30
#: No fewer ranges than these, so that small inputs are spread as well; no more, so that the splitters stay small.
MIN_RANGES, MAX_RANGES = 256, 4096
#: Small tables have fewer ranges, of so many rows.
RANGE_ROWS = 64
#: Rounds in which overfull ranges get more splitters.
TURNS = 4
#: Expected sample rows per range.
OVERSAMPLE = 16
#: A range above so many times the aim is subdivided.
OVERFULL = 2.0


def _longs(values: Iterable[int]) -> str:
    return "array(" + ", ".join(f"bigint('{v}')" for v in values) + ")"


def _range_of(key: Column, bounds: list) -> Column:
    """How many splitters are at most the key, found over two levels of about the root of their number; -1 for null."""
    width = max(1, int(len(bounds) ** 0.5))
    groups = [bounds[i : i + width] for i in range(0, len(bounds), width)]
    if not groups:
        return F.when(key.isNull(), F.lit(-1)).otherwise(F.lit(0))
    heads = F.expr(_longs(g[0] for g in groups))
    parts = F.expr(f"array({', '.join(map(_longs, groups))})")
    coarse = F.size(F.filter(heads, lambda x: x <= key))
    fine = F.size(F.filter(F.element_at(parts, F.greatest(coarse, F.lit(1))), lambda x: x <= key))
    return (
        F.when(key.isNull(), F.lit(-1))
        .when(coarse == 0, F.lit(0))
        .otherwise((coarse - 1) * F.lit(width) + fine)
        .cast("int")
    )


def _splitters(narrow: DataFrame, aim: float, bounds: list[int], full: list[int], seed: int) -> list[int]:
    """Splitters that cut the ranges `full` into parts of about `aim` bytes: quantiles of the key, weighted by size.

    They come from a sample in which a row is as likely as it is large, about OVERSAMPLE rows for each new range at
    any size of the input. It alone comes to the driver.
    """
    step = aim / OVERSAMPLE
    chance = F.xxhash64(F.lit(seed), "k", "size").bitwiseAND(F.lit((1 << 52) - 1)) / F.lit(float(1 << 52))
    sample = (
        narrow.withColumn("r", _range_of(F.col("k"), bounds))
        .filter(F.col("r").isin(full) & (chance * F.lit(step) < F.col("size")))
        .groupBy("r", "k").agg(F.sum(F.greatest(F.col("size"), F.lit(step))).alias("w"))
        .orderBy("k").collect()
    )
    found, filled, range_ = [], 0.0, None
    for row in sample:
        if row.r != range_:
            filled, range_ = 0.0, row.r
        elif filled >= aim:
            found.append(row.k)
            filled = 0.0
        filled += row.w
    return found


def shard(
    frame: DataFrame, shards: int, size: Column, key: str = "doc_id", text: str = "text", seed: int = 7,
    range_bytes: int = RANGE_BYTES,
) -> DataFrame:
    """Adds size (long), shard (int) and slot (long): shards of nearly equal size, in the order of the key.

    Splitters are quantiles of a size-weighted sample. The rows' sizes per range are then exact sums: a range far
    above its share is subdivided, by further splitters if it holds several keys, or by a hash of the row if it is one
    key (repeated or null keys). Rows are ordered inside a range only; ranges follow each other by summed sizes, and
    a shard ends where the running sum passes its share, so shards differ by less than one row's size.
    slot counts from 0 without gaps inside a shard.

    The key is a whole number. Nulls in it are first; in `text` they count as empty. Ties of the key are ordered by hash and size of the row;
    equal rows are interchangeable. Extra columns stay, also those named like helpers; columns named size, shard or
    slot are replaced. An empty table gives an empty result. shards must be 1 or more.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    frame = frame.drop("size", "shard", "slot")
    columns = frame.columns
    rest, span, sub, before, rows = (unused(frame, n) for n in ("rest", "span", "sub", "before", "rows"))
    frame = frame.withColumn("size", size.cast("long")).withColumn(rest, F.xxhash64(text))

    narrow = stored(frame.select(F.col(key).alias("k"), "size", F.col(rest).alias("rest")), "shard-sizes")
    total, n = narrow.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    ranges = int(max(1, min(MAX_RANGES, max(min(MIN_RANGES, n // RANGE_ROWS), total // range_bytes + 1))))
    aim = max(1.0, total / ranges)
    bounds = _splitters(narrow, aim, [], [0], seed)

    def overfull() -> list:
        sizes = narrow.groupBy(_range_of(F.col("k"), bounds).alias("r")).agg(
            F.sum("size").alias("bytes"), F.min("k").alias("low"), F.max("k").alias("high")
        )
        return sizes.filter(F.col("bytes") > OVERFULL * aim).collect()

    full = overfull()
    for turn in range(TURNS):
        several = [r for r in full if r.r >= 0 and r.low != r.high]
        if not several:
            break
        more = _splitters(narrow, aim, bounds, [r.r for r in several], seed + 1 + turn)
        # The highest key of a range begins a range of its own, so each turn gets further even if the sample has one key.
        bounds = sorted({*bounds, *more, *(r.high for r in several)})
        full = overfull()
    # What is still overfull is one key (or a few, after all turns): its rows are dealt by a hash, with the row's number in the input for equal rows.
    cuts = {r.r: int(r.bytes // aim) + 1 for r in full}
    ways = F.lit(1)
    for r, n in sorted(cuts.items()):
        ways = F.when(F.col(span) == r, F.lit(n)).otherwise(ways)
    spread = F.when(ways == 1, F.lit(0)).otherwise(
        F.pmod(F.xxhash64(F.col(rest), F.monotonically_increasing_id()), ways)
    )
    placed = frame.withColumn(span, _range_of(F.col(key), bounds)).withColumn(sub, spread.cast("int"))

    inside = Window.partitionBy(span, sub).orderBy(key, rest, "size")
    so_far = F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = placed.withColumn(before, so_far - F.col("size"))
    placed = placed.withColumn(rows, (F.row_number().over(inside) - 1).cast("long"))
    placed = stored(placed, "shard-rows")
    # One row per range: at most a few thousand, and 8 at most per shard, whatever the input.
    sums = placed.groupBy(span, sub).agg(F.sum("size").alias("b"), F.count("*").alias("n"))
    behind = Window.orderBy(span, sub).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(
        span, sub, F.coalesce(F.sum("b").over(behind), F.lit(0)).alias("b0"), F.coalesce(F.sum("n").over(behind), F.lit(0)).alias("n0"),
    )
    b0, n0 = unused(placed, "b0"), unused(placed, "n0")
    sums = sums.withColumnsRenamed({"b0": b0, "n0": n0})
    placed = placed.join(F.broadcast(sums), [span, sub])
    # A row belongs to the shard that holds its middle.
    middle = f"(2 * (`{b0}` + `{before}`) + size)"
    share = F.expr(f"cast(least({shards - 1}, {middle} * {shards} div {max(2 * total, 1)}) as int)")
    placed = placed.withColumn("shard", share)
    heads = placed.groupBy("shard").agg(F.min(F.col(n0) + F.col(rows)).alias("head"))
    head = unused(placed, "head")
    placed = placed.join(F.broadcast(heads.withColumnRenamed("head", head)), "shard")
    return placed.withColumn("slot", F.col(n0) + F.col(rows) - F.col(head)).select(*columns, "size", "shard", "slot")
