"""Mixing sources to target weights by pivotal dependent rounding."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T, Window

from contentflow.llm.folders import stored, unused

#: Rows that one task rounds together. Each such group leaves one undecided row at most for the level above.
GROUP_ROWS = 500
#: The part of a group's open words from which a row is large: it is decided as long as the others can make up for it.
LARGE = 0.03


def source_targets(
    frame: DataFrame, weights: Column, size: str = "size", source: str = "source", most: float = 3.0,
    budget: float | None = None,
) -> DataFrame:
    """(source, source_size, n_rows, target) for each source: the budget shared by weight, no target above `most` times the size.

    `weights` is an expression over `position` (0, 1, ... in the order of the sources by code point, null last). What
    is above a source's limit is shared again among the others by weight. With limits in the order of limit / weight, the
    sources below the water line are those whose limit per weight is less than what remains per weight, so
    one running sum over the sources says all targets. The budget is the sum of all sizes unless given.
    """
    sums = frame.groupBy(F.col(source).alias("source")).agg(
        F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("source_size"), F.count("*").alias("n_rows")
    )
    # One row per source from here on.
    order = Window.orderBy(F.col("source").asc_nulls_last())
    sums = sums.withColumn("position", F.row_number().over(order) - 1).withColumn("weight", weights.cast("double"))
    sums = sums.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    line = Window.orderBy(F.col("cap") / F.col("weight"), "position")
    every = Window.partitionBy()
    below = line.rowsBetween(Window.unboundedPreceding, -1)
    whole = F.sum("source_size").over(every).cast("double") if budget is None else F.lit(float(budget))
    sums = (
        sums.withColumn("left_over", whole - F.coalesce(F.sum("cap").over(below), F.lit(0.0)))
        .withColumn("weight_left", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(below), F.lit(0.0)))
        .withColumn("level", F.col("left_over") / F.col("weight_left"))
        .withColumn("over", F.col("cap") <= F.col("level") * F.col("weight"))
    )
    # The water level is that of the first source not over its limit.
    first = F.min(F.when(~F.col("over"), F.struct((F.col("cap") / F.col("weight")).alias("per"), "position", "level"))).over(every)
    return sums.withColumn("target", F.when(F.col("over"), F.col("cap")).otherwise(F.col("weight") * first["level"])).select(
        "source", "source_size", "n_rows", "target"
    )


def _settled(part: np.ndarray) -> np.ndarray:
    """Fractions that rounding errors left beside 0 or 1 are 0 or 1."""
    return np.where(part < 1e-12, 0.0, np.where(part > 1.0 - 1e-12, 1.0, part))


def _round_group(size: np.ndarray, part: np.ndarray, luck: np.ndarray) -> np.ndarray:
    """Pivotal steps through a group, rows in the order of falling sizes; one fraction at most is left between 0 and 1.

    A row meets the smaller rows behind it, as many as hold enough mass, counted in words, to make it whole. It goes to 1
    with the probability of its fraction, and they give what it takes; or it goes to 0, and they take what it gives.
    Shares are such that every row's expected fraction stays, and the sum of size * fraction never changes. Rows
    for which the smaller ones do not suffice then meet in pairs: mass moves until one of the two is whole.

    A large row for which the others can make up one way only goes that way: else the sum would be off by a part of it.
    """
    part = _settled(part.copy())
    large = LARGE * float((size * part)[(part > 0.0) & (part < 1.0)].sum())
    for j in range(len(part)):
        p = part[j]
        if not 0.0 < p < 1.0:
            continue
        others = j + 1 + np.flatnonzero((part[j + 1 :] > 0.0) & (part[j + 1 :] < 1.0))
        q, words = part[others], size[others]
        can = words * np.minimum(q / (1.0 - p), (1.0 - q) / p)
        total = np.cumsum(can)
        if not len(total) or total[-1] < size[j]:
            give, take = words * q, words * (1.0 - q)
            up, down = give.sum() >= (1.0 - p) * size[j], take.sum() >= p * size[j]
            if up != down and size[j] > large:
                share = -give / give.sum() * (1.0 - p) if up else take / take.sum() * p
                part[others] = _settled(np.clip(part[others] + share * size[j] / words, 0.0, 1.0))
                part[j] = 1.0 if up else 0.0
            continue
        last = int(np.searchsorted(total, size[j]))
        can = can[: last + 1]
        can[last] -= total[last] - size[j]
        others, words = others[: last + 1], words[: last + 1]
        up = luck[j] < p
        part[j] = 1.0 if up else 0.0
        part[others] = _settled(part[others] + (-(1.0 - p) if up else p) * can / words)
    waiting = -1
    for i in np.flatnonzero((part > 0.0) & (part < 1.0)):
        if waiting < 0:
            waiting = i
            continue
        j = waiting
        up = min((1.0 - part[j]) * size[j], part[i] * size[i])  # words that can move to j
        down = min(part[j] * size[j], (1.0 - part[i]) * size[i])  # words that can move to i
        move = up if luck[i] * (up + down) < down else -down
        pair = np.array([part[j] + move / size[j], part[i] - move / size[i]])
        nearest = int(np.argmin(np.minimum(abs(pair), abs(1.0 - pair))))
        pair[nearest] = round(pair[nearest])
        part[[j, i]] = _settled(np.clip(pair, 0.0, 1.0))
        waiting = next((r for r in (j, i) if 0.0 < part[r] < 1.0), -1)
    return part


def _spread(frame: DataFrame, name: str, identity: tuple[str, ...], group_rows: int) -> DataFrame:
    """The frame with a column that is the row's place if its identity crowds one group, else null."""
    keys = {unused(frame, f"identity_{i}"): c for i, c in enumerate(identity)}
    crowds = frame.groupBy(*(F.col(c).alias(k) for k, c in keys.items())).count().filter(F.col("count") > group_rows).drop("count")
    crowds = stored(crowds, "mix-crowds")
    if crowds.isEmpty():
        return frame.withColumn(name, F.lit(None).cast("long"))
    crowded = unused(frame, "crowded")
    same = [F.col(c).eqNullSafe(F.col(k)) for k, c in keys.items()]
    numbered = frame.withColumn(name, F.monotonically_increasing_id())
    flagged = numbered.join(crowds.withColumn(crowded, F.lit(True)), same, "left").drop(*keys)
    return flagged.withColumn(name, F.when(F.col(crowded), F.col(name))).drop(crowded)


def mix(
    frame: DataFrame, targets: DataFrame, size: str = "size", source: str = "source", identity: tuple[str, ...] = ("doc_id",),
    seed: int = 11, group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """Adds source_size (long), target (double) and copies (int): how often the mix takes each row.

    A row's expected copies are target / source_size. The whole part is certain; the fraction goes through pivotal
    rounding. Rows of a source are dealt by hash to groups of about `group_rows`, so a source of any size is spread over
    the cluster; a group leaves at most one fractional row, most often a small one, and those form the groups of the next
    level, until a source has one left, which its own draw decides. What a source takes differs from its target by less
    than that row's size. All draws are hashes of `identity`, the size and the seed: repeated runs agree.

    Null sources are a source. Null or zero sizes never change the sum, their fraction is drawn alone. Rows that repeat identity and
    size are interchangeable. Rows of an identity that more than `group_rows` rows share, as null may be, are dealt by their place in the
    table too, so a group never holds many more rows than `group_rows`. Other columns stay; the three added ones are replaced. An empty table gives an empty result.
    """
    frame = frame.drop("source_size", "target", "copies")
    columns = frame.columns
    spread = unused(frame, "spread")
    frame = _spread(frame, spread, identity, group_rows)
    part, group, luck, n_rows = (unused(frame, n) for n in ("part", "group", "luck", "n_rows"))
    key = unused(frame, "source_key")
    facts = targets.select(
        F.col("source").alias(key), "source_size", F.col("n_rows").alias(n_rows), F.col("target").cast("double").alias("target")
    )
    known = frame.join(facts, F.col(source).eqNullSafe(F.col(key)), "left").drop(key)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    draw = F.xxhash64(F.lit(seed), *identity, size).bitwiseAND(F.lit((1 << 52) - 1)) / F.lit(float(1 << 52))
    known = (
        known.withColumn("copies", F.floor(rate).cast("int"))
        .withColumn(part, rate - F.floor(rate))
        .withColumn(luck, draw)
        .withColumn(part, F.when(F.coalesce(F.col(size), F.lit(0)) > 0, F.col(part)).otherwise((F.col(luck) < F.col(part)).cast("double")))
    )
    schema = T.StructType([*known.schema.fields])

    def rounded(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([(size, "descending"), *((name, "ascending") for name in dict.fromkeys([luck, *identity]))])
        # The draw that orders the rows must not decide them as well.
        again = np.modf(rows[luck].to_numpy() * 65521.0)[0]
        sizes = pc.fill_null(rows[size], 0).to_numpy().astype(float)
        parts = _round_group(sizes, rows[part].to_numpy().astype(float), again)
        return rows.set_column(rows.schema.get_field_index(part), part, pa.array(parts)).select(schema.names)

    done = []
    level, largest = known, targets.agg(F.max("n_rows")).first()[0] or 0
    depth = 0
    while True:
        depth += 1
        groups = -(-largest // group_rows)
        ways = F.greatest(F.lit(1), F.ceil(F.col(n_rows) / F.lit(float(group_rows) ** depth))).cast("long")
        dealt = level.withColumn(group, F.pmod(F.xxhash64(F.lit(seed + depth), *identity, luck, spread), ways))
        after = dealt.groupBy(source, group).applyInArrow(rounded, schema)
        after = stored(after, "mix-level")
        whole = (F.col(part) <= 0.0) | (F.col(part) >= 1.0)
        done.append(after.filter(whole).withColumn("copies", F.col("copies") + F.col(part).cast("int")))
        level, largest = after.filter(~whole), groups
        if groups <= 1:
            break
    done.append(level.withColumn("copies", F.col("copies") + (F.col(luck) < F.col(part)).cast("int")))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select(*columns, "source_size", "target", "copies")
