"""Alignment of two tokenizers' tokens of the same texts, in Arrow tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from contentflow.llm import grams
from contentflow.llm.folders import stored
from contentflow.llm.tokens import byte_bpe, piece_bpe

#: Pairs of ids that one Acero join makes at once.
JOIN_ROWS = 2_000_000
#: Pairs of ids in a row of the table of links; a document with more has several rows.
ROW_PAIRS = 1 << 16
#: Pairs whose counts are sent to every task. All others are held by so few documents each that a join deals them evenly.
FREQUENT = 200_000

_SHIFT = 40


class Tokens:
    """One tokenizer's tokens of some texts: ids, the texts they are of (parent indices), and where they end in these."""

    def __init__(self, encoded: list[np.ndarray], size: np.ndarray):
        counts = np.array([len(ids) for ids in encoded], np.int64)
        flat = np.concatenate([np.zeros(0, np.int32), *encoded])
        lists = pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)])), pa.array(flat, pa.int32()))
        self.ids = pc.list_flatten(lists)
        self.text = pc.list_parent_indices(lists).cast(pa.int64())
        total = pc.cumulative_sum(pa.array(size[flat], pa.int64())).to_numpy()
        # Segmented: what the texts before take is subtracted.
        before = np.concatenate([[0], total])[np.cumsum(counts) - counts]
        self.end = pa.array(total - before[self.text.to_numpy()], pa.int64())
        self.counts = counts

    @property
    def key(self) -> pa.Array:
        """Text and end as one number."""
        return pc.add(pc.shift_left(self.text, pa.scalar(_SHIFT, pa.int64())), self.end)


def common_ends(a: Tokens, b: Tokens) -> np.ndarray:
    """Sorted keys where tokens of both end: the ends of groups."""
    ends = pa.table({"key": a.key}).join(pa.table({"key": b.key}), keys="key", join_type="inner", use_threads=False)
    return np.sort(ends["key"].to_numpy())


def linked(group_a: np.ndarray, a: Tokens, group_b: np.ndarray, b: Tokens, text: np.ndarray, ids_b: int) -> pa.Table:
    """(text, pair, times): how often each pair of ids shares a group of the text, by text. A pair is A's id times `ids_b` and B's id.

    Most groups are one token of each. In the others the ids of a group are counted first, so a group costs the product of its
    distinct ids; long groups are joined in slices.
    """
    single_a = np.bincount(group_a, minlength=len(text))
    single = (single_a == 1) & (np.bincount(group_b, minlength=len(text)) == 1)
    of_a, of_b = single[group_a], single[group_b]
    number_a, number_b = a.ids.to_numpy().astype(np.int64), b.ids.to_numpy().astype(np.int64)
    every = max(1, ids_b * (int(number_a.max(initial=0)) + 1))
    parts = [_summed(text[group_a[of_a]] * every + number_a[of_a] * ids_b + number_b[of_b], None)]
    counted = []
    for group, ids, name in ((group_a[~of_a], number_a[~of_a], "a"), (group_b[~of_b], number_b[~of_b], "b")):
        table = pa.table({"group": group, name: ids}).group_by(["group", name], use_threads=False).aggregate([([], "count_all")])
        counted.append(table.rename_columns(["group", name, f"n{name}"]).sort_by("group"))
    left, right = counted
    partners = np.bincount(right["group"].to_numpy(), minlength=len(text))[left["group"].to_numpy()]
    made = np.cumsum(partners)
    first = 0
    while first < len(left):
        last = max(first + 1, int(np.searchsorted(made, (made[first - 1] if first else 0) + JOIN_ROWS, side="right")))
        some = left.slice(first, last - first)
        low, high = np.searchsorted(right["group"].to_numpy(), [some["group"][0].as_py(), some["group"][-1].as_py() + 1])
        both = some.join(right.slice(low, high - low), keys="group", join_type="inner", use_threads=False)
        key = text[both["group"].to_numpy()] * every + both["a"].to_numpy() * ids_b + both["b"].to_numpy()
        parts.append(_summed(key, pc.multiply(both["na"], both["nb"])))
        first = last
    whole = pa.concat_tables(parts)
    if len(parts) > 1:
        whole = _summed(whole["key"], whole["times"])
    whole = whole.sort_by("key")
    of, pair = np.divmod(whole["key"].to_numpy(), every)
    return pa.table({"text": of, "pair": pair, "times": whole["times"]})


def _summed(key, times) -> pa.Table:
    if times is None:
        out = pa.table({"key": key}).group_by("key", use_threads=False).aggregate([([], "count_all")])
    else:
        out = pa.table({"key": key, "times": times}).group_by("key", use_threads=False).aggregate([("times", "sum")])
    return out.rename_columns(["key", "times"])


@lru_cache(maxsize=2)
def _words(ids: int) -> pa.Array:
    """Every id, written before a comma, a bar, a semicolon and alone."""
    return pa.array([f"{i}{mark}" for i in range(ids) for mark in (",", "|", ";", "")], pa.large_string())


def group_strings(group_a: np.ndarray, a: Tokens, group_b: np.ndarray, b: Tokens, text: np.ndarray, n: int, ids: int) -> pa.Array:
    """`a1,a2|b1;a3|b2,b3` for each text: the ids of its groups in order."""
    group = np.concatenate([group_a, group_b])
    side = np.concatenate([np.zeros(len(group_a), np.int8), np.ones(len(group_b), np.int8)])
    number = np.concatenate([a.ids.to_numpy(), b.ids.to_numpy()]).astype(np.int64)
    order = np.argsort(2 * group + side, kind="stable")
    group, side, number = group[order], side[order], number[order]
    if not len(number):
        return pa.array([""] * n, pa.large_string())
    # What follows each id: the next id of its side, the other side, the next group, or the end of its text.
    same = group[1:] == group[:-1]
    sign = np.full(len(number), 2)
    sign[:-1] = np.where(same & (side[1:] == side[:-1]), 0, np.where(same, 1, 2))
    sign[:-1][text[group[1:]] != text[group[:-1]]] = 3
    sign[-1] = 3
    words = _words(ids).take(pa.array(number * 4 + sign))
    # The words of a text follow each other in memory: its string is a piece of it.
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    ends = offsets[np.concatenate([[0], np.cumsum(np.bincount(text[group], minlength=n))])]
    return pa.LargeStringArray.from_buffers(n, pa.py_buffer(ends.astype(np.int64).tobytes()), words.buffers()[2])


def spelled(vocabulary: pa.Array, encoded: list[np.ndarray], wholes: list[bytes]) -> np.ndarray:
    """Whether the bytes of each text's tokens are the text's."""
    flat = np.concatenate([np.zeros(0, np.int32), *encoded])
    joined = vocabulary.take(pa.array(flat))
    offsets = np.frombuffer(joined.buffers()[1], np.int64)[joined.offset : joined.offset + len(flat) + 1]
    ends = offsets[np.concatenate([[0], np.cumsum([len(ids) for ids in encoded])]).astype(np.int64)]
    data = joined.buffers()[2].to_pybytes() if len(flat) else b""
    return np.array([data[low:high] == whole for low, high, whole in zip(ends, ends[1:], wholes)], bool)


def aligned(frame: DataFrame, file_a: str, file_b: str, text: str = "text", key: str = "doc_id", row_pairs: int = ROW_PAIRS) -> DataFrame:
    """(key, document, part, n_a, n_b, n_groups, n_links, groups, pairs, times): each document's alignment, lazily.

    Rows of one document have its number and the parts 0, 1, ...: part 0 has the counts and the groups, each part some of the
    distinct linked pairs of ids and how often they are linked.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = byte_bpe(file_a), piece_bpe(file_b)
        size_a, size_b = (np.array([len(t) for t in model.bytes], np.int64) for model in (first, second))
        bytes_a, bytes_b = (pa.array(model.bytes, pa.large_binary()) for model in (first, second))
        none = np.zeros(0, np.int32)
        for batch in batches:
            for piece in grams.pieces(batch.column(2)):
                n = len(piece)
                values = [value or "" for value in batch.column(2).slice(piece.first, n).to_pylist()]
                wholes = [(" " + value).encode() if value else b"" for value in values]
                encoded_a = [first.encode(" " + value) if value else none for value in values]
                encoded_b = [second.encode(value) if value else none for value in values]
                right = spelled(bytes_a, encoded_a, wholes) & spelled(bytes_b, encoded_b, wholes)
                encoded_a, encoded_b = ([ids if yes else none for ids, yes in zip(e, right)] for e in (encoded_a, encoded_b))
                a, b = Tokens(encoded_a, size_a), Tokens(encoded_b, size_b)
                ends = common_ends(a, b)
                of = ends >> _SHIFT
                group_a, group_b = np.searchsorted(ends, a.key.to_numpy()), np.searchsorted(ends, b.key.to_numpy())
                pairs = linked(group_a, a, group_b, b, of, len(second.bytes))
                product = np.bincount(group_a, minlength=len(ends)) * np.bincount(group_b, minlength=len(ends))
                links = np.zeros(n, np.int64)
                np.add.at(links, of, product)
                strings = group_strings(group_a, a, group_b, b, of, n, max(len(first.bytes), len(second.bytes)))
                at = np.searchsorted(pairs["text"].to_numpy(), np.arange(n + 1))
                rows = [(i, p, lo) for i in range(n) for p, lo in enumerate(range(at[i], max(at[i + 1], at[i] + 1), row_pairs))]
                owner, part, low = (np.array(x, np.int64) for x in zip(*rows))
                edge = pa.array(np.append(low, at[n]), pa.int32())
                head = pa.array(part != 0)

                def fact(values) -> pa.Array:
                    taken = (values if isinstance(values, pa.Array) else pa.array(values, pa.int64())).take(pa.array(owner))
                    return pc.if_else(head, pa.scalar(None, taken.type), taken)

                groups = np.bincount(of, minlength=n)
                source = pa.array(owner + piece.first)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(source), batch.column(1).take(source), pa.array(part, pa.int32()),
                        fact(a.counts), fact(b.counts), fact(groups), fact(links), fact(strings).cast(pa.string()),
                        pa.ListArray.from_arrays(edge, pairs["pair"].combine_chunks()), pa.ListArray.from_arrays(edge, pairs["times"].combine_chunks()),
                    ],
                    names=["key", "document", "part", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times"],
                )

    rows = frame.select(F.col(key).alias("key"), F.monotonically_increasing_id().alias("document"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    made = rows.mapInArrow(
        run,
        f"key {kind}, document long, part int, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, times array<long>",
    )
    return made.withColumnRenamed("key", key)


def pair_counts(links: DataFrame, ids_b: int) -> DataFrame:
    """(pair, n_docs, best): how many documents hold each linked pair of ids, and whether no pair of its A id has more.

    `ids_b` is the number of ids that pairs were numbered with.
    """

    def run(batches):
        for batch in batches:
            table = pa.table({"pair": pc.list_flatten(batch.column(0))})
            out = table.group_by("pair", use_threads=False).aggregate([([], "count_all")]).rename_columns(["pair", "n_docs"])
            yield from out.combine_chunks().to_batches()

    counts = links.select("pairs").mapInArrow(run, "pair long, n_docs long").groupBy("pair").agg(F.sum("n_docs").alias("n_docs"))
    counts = stored(counts, "alignment-counts")
    # One row per id of vocabulary A.
    counts = counts.withColumn("a", F.floor(F.col("pair") / ids_b))
    most = counts.groupBy("a").agg(F.max("n_docs").alias("most"))
    joined = counts.join(most, "a")
    return stored(joined.select("pair", "n_docs", (F.col("n_docs") == F.col("most")).alias("best")), "alignment-counts")


def align(
    frame: DataFrame, file_a: str, file_b: str, text: str = "text", key: str = "doc_id",
    keep: Callable[[Column], Column] = lambda groups: groups, frequent: int = FREQUENT, row_pairs: int = ROW_PAIRS,
) -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) for each document.

    A is a byte-level BPE file and encodes a space and the text, B a sentencepiece model and encodes the text. Where tokens of both end, a
    group ends; the tokens of a group are linked, each of A with each of B. A pair's count is the number of documents that hold it
    linked. n_best are the links whose count is the highest of their A id, ties included, count_sum sums the counts of all
    links. groups is what `keep` makes of the ids of the groups, `a1,a2|b1;a3|b2`.

    Counts of the frequent pairs are sent to the tasks: a pair above the `frequent`-th part of all (document, pair) is
    frequent, so there are at most so many. The others meet their documents in a join, in which no key is frequent.

    Null and empty texts, and those whose tokens do not spell them, have no tokens: all counts are 0 and groups is ''. Rows that
    repeat a key or a text are documents of their own, null keys are kept. A long text is aligned at once, its pairs are stored in
    several rows. An empty table gives an empty result. Other columns are not read.
    """
    spark = frame.sparkSession
    made = aligned(frame, file_a, file_b, text, key, row_pairs).withColumnRenamed(key, "key")
    links = stored(made.withColumn("groups", F.when(F.col("groups") == "", F.lit("")).otherwise(keep(F.col("groups")))), "alignment-links")
    counts = pair_counts(links, len(piece_bpe(file_b).bytes))
    total = counts.agg(F.sum("n_docs")).first()[0] or 0
    above = F.col("n_docs") * F.lit(frequent) > F.lit(total)
    hot = counts.filter(above).orderBy("pair").toPandas()
    known = spark.sparkContext.broadcast((hot["pair"].to_numpy(np.int64), hot["n_docs"].to_numpy(np.int64), hot["best"].to_numpy(bool)))

    def run(batches):
        pair, n_docs, best = known.value
        for batch in batches:
            lists, of = batch.column(1), pc.list_parent_indices(batch.column(1)).to_numpy()
            codes, times = pc.list_flatten(lists).to_numpy(), pc.list_flatten(batch.column(2)).to_numpy()
            found = np.zeros(len(codes), bool)
            place = np.zeros(len(codes), np.int64)
            if len(pair):
                place = np.searchsorted(pair, codes).clip(max=len(pair) - 1)
                found = pair[place] == codes
            n_best, count_sum = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            np.add.at(count_sum, of[found], (times * n_docs[place] if len(pair) else times)[found])
            won = found & (best[place] if len(pair) else found)
            np.add.at(n_best, of[won], times[won])
            rest = np.concatenate([[0], np.cumsum(np.bincount(of[~found], minlength=batch.num_rows))])
            edge = pa.array(rest, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(n_best), pa.array(count_sum),
                    pa.ListArray.from_arrays(edge, pa.array(codes[~found])), pa.ListArray.from_arrays(edge, pa.array(times[~found])),
                ],
                names=["document", "n_best", "count_sum", "pairs", "times"],
            )

    schema = "document long, n_best long, count_sum long, pairs array<long>, times array<long>"
    counted = stored(links.select("document", "pairs", "times").mapInArrow(run, schema), "alignment-sums")
    rare = counted.select("document", F.explode(F.arrays_zip("pairs", "times")).alias("link")).select("document", "link.pairs", "link.times")
    rare = rare.withColumnRenamed("pairs", "pair").join(counts.filter(~above), "pair").select(
        "document", F.when(F.col("best"), F.col("times")).otherwise(F.lit(0).cast("long")).alias("n_best"), (F.col("times") * F.col("n_docs")).alias("count_sum")
    )
    sums = counted.select("document", "n_best", "count_sum").union(rare).groupBy("document").agg(
        F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum")
    )
    facts = links.filter("part = 0").select("document", F.col("key").alias(key), "n_a", "n_b", "n_groups", "n_links", "groups")
    return facts.join(sums, "document").select(key, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")
