"""Near duplicates by one-permutation MinHash with optimal densification."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from contentflow.llm import grams
from contentflow.llm.components import components
from contentflow.llm.folders import stored

#: Bins of the one permutation, and bins per band. Sets of similarity 0.8 share no band once in 200,000 pairs.
BINS, ROWS = 240, 6
SHINGLE = 5
#: In percent; links have at least this similarity.
SIMILARITY = 80
#: Counters of shingles that make the rarest come first where stars leave pairs untested.
COUNTERS = 1 << 18

_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_sets(texts: grams.Texts, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the distinct shingles, sorted. A text of fewer words than `size` is one shingle, if it has any."""
    found = grams.words(texts, grams.SPACED)
    hashes, first = grams.shingles(found, size)
    parts, of = [hashes], [found.text[first]]
    for count in range(1, size):
        short = np.flatnonzero(found.counts == count)
        begin = found.ends[short] - count
        parts.append(grams.chain([found.hashes[begin + j] for j in range(count)]))
        of.append(short)
    hashes, of = np.concatenate(parts), np.concatenate(of)
    order = np.argsort(of, kind="stable")
    of, hashes, _ = grams.distinct_by_text(of[order], hashes[order])
    return of, hashes


def signatures(of: np.ndarray, hashes: np.ndarray, n: int, bins: int = BINS) -> np.ndarray:
    """(n, bins) smallest hash in each bin of one permutation.

    An empty bin asks other bins, in an order that its own number fixes, until one is not empty, and takes
    its value: two sets then agree in a bin with the probability of their similarity (optimal densification).
    """
    drawn = grams.mix(hashes ^ np.uint64(0x5851F42D4C957F2D))
    place = ((drawn >> np.uint64(32)) % np.uint64(bins)).astype(np.int64)
    out = np.full(n * bins, _EMPTY, dtype=np.uint64)
    np.minimum.at(out, of * bins + place, grams.mix(drawn) >> np.uint64(1))
    out = out.reshape(n, bins)
    own = out.copy()
    row, bin_ = np.nonzero((own == _EMPTY) & (own != _EMPTY).any(axis=1)[:, None])
    attempt = 0
    while len(row):
        attempt += 1
        donor = (grams.mix(np.arange(bins, dtype=np.uint64) * np.uint64(1_000_003) + np.uint64(attempt)) % np.uint64(bins)).astype(np.int64)
        value = own[row, donor[bin_]]
        got = value != _EMPTY
        out[row[got], bin_[got]] = value[got]
        row, bin_ = row[~got], bin_[~got]
    return out


def bands(signature: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """(n, bands) bucket numbers: one hash of each band's bins and the band's place."""
    n, bins = signature.shape
    parts = signature.reshape(n, bins // rows, rows)
    keys = np.tile(np.arange(bins // rows, dtype=np.uint64), (n, 1))
    for j in range(rows):
        keys = grams.mix(keys * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, j])
    return keys.view(np.int64)


def locator(text: str, key: str) -> list[Column]:
    """128 bits that find a row again by its key and text, null or not."""
    return [F.xxhash64(F.lit(17), key, text).alias("row1"), F.xxhash64(F.lit(23), text, key).alias("row2")]


def _described(frame: DataFrame, text: str, key: str, size: int) -> DataFrame:
    """Per row its key and locator, the size of its set, 128 bits of the set (null: empty) and its buckets."""

    def work(texts: grams.Texts, _: pa.RecordBatch) -> tuple:
        n = len(texts)
        of, hashes = shingle_sets(texts, size)
        count = np.bincount(of, minlength=n)
        full = np.flatnonzero(count)
        at = np.cumsum(count)[full] - count[full]
        sums = np.zeros((n, 2), dtype=np.uint64)
        if len(full):
            sums[full, 0] = np.add.reduceat(grams.mix(hashes + np.uint64(1)), at)
            sums[full, 1] = np.add.reduceat(grams.mix(hashes ^ np.uint64(0xD6E8FEB86659FD93)), at)
        keys = bands(signatures(of, hashes, n))
        sets = [s.tobytes() if c else None for s, c in zip(sums, count)]
        lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * keys.shape[1]), pa.array(keys.ravel()))
        return count, pa.array(sets, pa.binary()), lists

    rows = frame.select(F.col(key).alias("key"), F.col(text).alias("text"), *locator(text, key))
    return grams.mapped(rows, "text", ["key", "row1", "row2"], {"n_shingles": "long", "set": "binary", "buckets": "array<long>"}, work)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough. Sizes alone rule most others out before sets are compared."""

    def compare(batches):
        for batch in batches:
            left, right = batch.column(2), batch.column(3)
            good = []
            for i in range(batch.num_rows):
                one, two = np.frombuffer(left[i].as_buffer(), np.uint64), np.frombuffer(right[i].as_buffer(), np.uint64)
                place = np.searchsorted(one, two).clip(max=len(one) - 1)
                both = int((one[place] == two).sum())
                good.append(100 * both >= percent * (len(one) + len(two) - both))
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    sizes = sets.select("node", "n")
    near = (
        pairs.join(sizes.select(F.col("node").alias("a"), F.col("n").alias("na")), "a")
        .join(sizes.select(F.col("node").alias("b"), F.col("n").alias("nb")), "b")
        .filter(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent).select("a", "b")
    )
    whole = near.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a")
    whole = whole.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")
    return whole.select("a", "b", "sa", "sb").mapInArrow(compare, "a long, b long")


def _remaining_pairs(nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that may be similar enough, from (node, component, n, shingles).

    Each set is ordered from its rarest shingle. Two similar sets share one among the first of both, and the place of the first
    one that they share bounds what they can share in all; pairs below the threshold by that bound are not made. Sets
    that are all a little alike, as texts around one template, differ in their rarest shingles and do not meet.
    Rarity is counted in a table of fixed size, where shingles may fall together: any order is right, a better one is faster.
    In a shingle's group the nodes of its largest component only meet the others.
    """

    def unpacked(batch: pa.RecordBatch, at: int):
        return [np.frombuffer(v.as_buffer(), np.uint64) for v in batch.column(at)]

    def count(batches):
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for shingles in unpacked(batch, 0):
                np.add.at(total, (shingles % np.uint64(COUNTERS)).astype(np.int64), 1)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["slot", "times"])

    counts = nodes.select("shingles").mapInArrow(count, "slot int, times long").groupBy("slot").agg(
        F.least(F.sum("times"), F.lit(2**31 - 1)).cast("int").alias("times")
    ).toPandas()
    table = np.zeros(COUNTERS, np.int32)
    table[counts["slot"].to_numpy()] = counts["times"].to_numpy()
    shared = nodes.sparkSession.sparkContext.broadcast(table)

    def prefix(batches):
        for batch in batches:
            parts, places, owner = [], [], []
            for i, shingles in enumerate(unpacked(batch, 3)):
                rarity = shared.value[(shingles % np.uint64(COUNTERS)).astype(np.int64)]
                first = np.lexsort((shingles, rarity))[: len(shingles) - -(-len(shingles) * percent // 100) + 1]
                parts.append(shingles[first])
                places.append(np.arange(len(first)))
                owner.append(np.full(len(first), i))
            if not parts:
                continue
            at = pa.array(np.concatenate(owner))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(at) for c in range(3)), pa.array(np.concatenate(parts).view(np.int64)), pa.array(np.concatenate(places))],
                names=["node", "component", "n", "token", "place"],
            )

    tokens = stored(
        nodes.select("node", "component", "n", "shingles").mapInArrow(prefix, "node long, component long, n long, token long, place long"), "minhash-prefixes"
    )
    sums = tokens.groupBy("token", "component").agg(F.count("*").alias("size"))
    sums = sums.groupBy("token").agg(F.count("*").alias("components"), F.max_by("component", "size").alias("largest")).filter("components > 1")
    several = stored(tokens.join(sums.select("token", "largest"), "token"), "minhash-shared")
    others = several.filter("component <> largest").select(
        "token", F.col("node").alias("other"), F.col("component").alias("theirs"), F.col("n").alias("m"), F.col("place").alias("at")
    )
    bound = f"least(n - place, m - at) * {100 + percent} >= {percent} * (n + m)"
    size = f"least(n, m) * 100 >= greatest(n, m) * {percent}"
    # Between two nodes outside the largest component either may be the left one: keep one order.
    once = "(component = largest or node < other)"
    pairs = several.join(others, "token").filter(f"component <> theirs and {once} and {size} and {bound}")
    return pairs.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()


def near_duplicates(frame: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = SHINGLE, percent: int = SIMILARITY) -> DataFrame:
    """(key, row1, row2, n_shingles, component_id, kept, first) for each row of the frame, see `locator` for row1 and row2.

    A text is the set of its distinct shingles. Rows with equal sets are one node, so copies never meet in pairs. Nodes
    that share a bucket form a star around the one that shares buckets with the most others; its pairs are confirmed on the whole
    sets, and confirmed pairs are links. A group of near copies so costs as many pairs as it has members. Where a bucket then still holds nodes
    of several components, links between two nodes that are not its centre may be missing: a prefix join of these
    nodes' sets finds every such link between components, see `_remaining_pairs`.

    component_id is the smallest key reachable over links, kept says whether it is the row's own. Null and empty texts
    have no shingles and no links. Null keys are never the smallest unless all are null. Rows of one component that repeat its
    smallest key are each kept; first names one row of the component, that with the smallest key and locator, and every row without
    shingles. Very long texts are sets like others. An empty table gives an empty result. The frame may have any other columns.
    """
    rows = stored(_described(frame, text, key, shingle), "minhash-rows")
    grouped = rows.filter("set is not null").groupBy("set").agg(
        F.min(F.struct(F.col("key").isNull().alias("none"), "key", "row1", "row2")).alias("first"),
        F.first("n_shingles").alias("n"), F.first("buckets").alias("buckets"),
    )
    # Written once, so that a node's number is the same in all that follows.
    nodes = stored(
        grouped.select(F.monotonically_increasing_id().alias("node"), "set", "n", "buckets", F.col("first.key").alias("key"), F.col("first.row1").alias("row1"), F.col("first.row2").alias("row2")),
        "minhash-nodes",
    )
    buckets = nodes.select("node", F.explode("buckets").alias("bucket"))
    sizes = buckets.groupBy("bucket").agg(F.count("*").alias("members")).filter("members > 1")
    shared = stored(buckets.join(sizes, "bucket"), "minhash-shared")
    # The node that meets the most others: the text that a group's near copies were made from, if it is there.
    popular = shared.join(shared.groupBy("node").agg(F.sum("members").alias("met")), "node")
    centres = popular.groupBy("bucket").agg(F.min_by("node", F.struct(-F.col("met"), "node")).alias("centre"))
    members = stored(shared.select("bucket", "node").join(centres, "bucket"), "minhash-members")

    wanted = members.select("node").distinct().join(nodes.select("node", "set", "row1", "row2"), "node")
    sets = stored(_sets(frame, wanted, text, key, shingle), "minhash-sets")

    tested = members.filter("node <> centre").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct()
    tested = stored(tested, "minhash-pairs")
    links = stored(_confirmed(tested, sets, percent), "minhash-links")
    found = components(links)
    # Buckets whose nodes are not all in one component leave pairs that no star has tested.
    placed = members.join(found, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("component"))
    mixed = placed.groupBy("bucket").agg(F.min("component").alias("least"), F.max("component").alias("most")).filter("least < most")
    open_ = stored(placed.join(mixed.select("bucket"), "bucket", "left_semi").select("node", "component").distinct(), "minhash-open")
    rest = stored(_remaining_pairs(open_.join(sets, "node"), percent), "minhash-pairs")
    more = stored(_confirmed(rest, sets, percent), "minhash-links")
    if not more.isEmpty():
        found = components(links.union(more))

    own = F.struct(F.col("key").isNull().alias("none"), "key", "row1", "row2")
    labelled = nodes.select("node", "set", own.alias("own")).join(found, "node", "left")
    smallest = labelled.filter("component is not null").groupBy("component").agg(F.min("own").alias("smallest"))
    labelled = labelled.join(smallest, "component", "left").select("set", F.coalesce("smallest", "own").alias("least"))
    done = rows.select("key", "row1", "row2", "n_shingles", "set").join(labelled, "set", "left")
    identity = F.when(F.col("set").isNull(), F.col("key")).otherwise(F.col("least.key"))
    done = done.withColumn("component_id", identity).withColumn("kept", F.col("key").eqNullSafe(F.col("component_id")))
    first = F.col("set").isNull() | ((F.col("row1") == F.col("least.row1")) & (F.col("row2") == F.col("least.row2")))
    return done.select(F.col("key").alias(key), "row1", "row2", "n_shingles", "component_id", "kept", first.alias("first"))


def _sets(frame: DataFrame, wanted: DataFrame, text: str, key: str, size: int) -> DataFrame:
    """(node, n, shingles: sorted hashes) of the wanted nodes, from one text of each."""

    def work(texts: grams.Texts, _: pa.RecordBatch) -> tuple:
        of, hashes = shingle_sets(texts, size)
        cuts = np.searchsorted(of, np.arange(len(texts) + 1))
        return np.diff(cuts), pa.array([hashes[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary())

    rows = frame.select(F.col(text).alias("text"), *locator(text, key))
    rows = rows.join(wanted.select("node", "row1", "row2"), ["row1", "row2"])
    # Rows that repeat key and text have the same set.
    return grams.mapped(rows, "text", ["node"], {"n": "long", "shingles": "binary"}, work).dropDuplicates(["node"])


def keep_one(frame: DataFrame, found: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row of each component, and the rows without shingles; of those that repeat key and text one."""
    rows = frame.withColumns(dict(zip(("_row1", "_row2"), locator(text, key))))
    kept = found.filter("first").select(F.col("row1").alias("_row1"), F.col("row2").alias("_row2"))
    return rows.join(kept, ["_row1", "_row2"], "left_semi").dropDuplicates(["_row1", "_row2"]).select(*frame.columns)
