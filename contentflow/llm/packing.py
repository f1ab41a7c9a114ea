"""Documents packed into sequences of a fixed length by Karmarkar-Karp differencing."""

from __future__ import annotations

import heapq
from bisect import insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from contentflow.llm import grams
from contentflow.llm.folders import stored
from contentflow.llm.tokens import byte_bpe

#: Ids of a sequence.
CAPACITY = 1024
#: The id after each document.
END = 0
#: Pieces, in expectation, that one task divides into sequences together.
GROUP_PIECES = 4000


def cuts(n: int, capacity: int) -> list[int]:
    """Lengths of the pieces of n ids: whole sequences, then half a one, then the rest.

    Rests of all lengths below half a sequence are what balances the others.
    """
    half = max(1, capacity // 2)
    whole, left = divmod(n, capacity)
    return [capacity] * whole + [half] * (left // half) + ([left % half] if left % half else [])


def differencing(lengths: list[int], ways: int) -> list[list[int]]:
    """Numbers of the lengths in `ways` bags of near-equal sums; empty bags are left out.

    A partial partition is a list of bags by their sums above its smallest. The two partitions with the greatest
    imbalance are merged, the fullest bags of one with the emptiest of the other, until one is left. A partition is sparse as long as it
    has empty bags, so that most merges touch few of them.
    """
    bags = [[i] for i in range(len(lengths))]
    # (-imbalance, age, what to take off the sums, [(sum, bag)] by rising sums)
    heap = [(-length, i, 0, [(length, i)]) for i, length in enumerate(lengths)]
    heapq.heapify(heap)
    age = len(heap)
    while len(heap) > 1:
        one, two = heapq.heappop(heap), heapq.heappop(heap)
        (_, _, low, many), (_, _, least, few) = (one, two) if len(one[3]) >= len(two[3]) else (two, one)
        meet = max(0, len(many) + len(few) - ways)
        alone = len(few) - meet
        added = [(s - least + low, bag) for s, bag in few[:alone]]
        for (s, bag), (t, other) in zip(many[:meet], reversed(few[alone:])):
            bags[bag] += bags[other]
            added.append((s + t - least, bag))
        del many[:meet]
        if len(added) > 8:
            many = sorted(many + added)
        else:
            for entry in added:
                insort(many, entry)
        if len(many) == ways:
            low = many[0][0]
        age += 1
        heapq.heappush(heap, (low - many[-1][0], age, low, many))
    return [bags[bag] for _, bag in heap[0][3]] if heap else []


def windows(lengths: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Bags whose sums do not exceed the capacity. Lengths are at most the capacity.

    It begins with the fewest bags that could hold the total; their number rises by a thousandth, and by one at least, until all fit.
    """
    ways = max(1, -(-sum(lengths) // capacity))
    while True:
        found = differencing(lengths, ways)
        if all(sum(lengths[i] for i in bag) <= capacity for bag in found):
            return found
        ways += max(1, ways // 1000)


def pieces(frame: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id", capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """(key, start, length, doc_tokens, ids): the ids of each document, and the end id, cut as `cuts` says.

    ids are little-endian unsigned 32-bit numbers. Every row is a document of at least the end id, whatever its key.
    """

    def run(batches):
        model = byte_bpe(tokenizer)
        for batch in batches:
            for part in grams.pieces(batch.column(1)):
                owner, start, length, total, data = [], [], [], [], []
                for i in range(part.first, part.last):
                    ids = np.append(model.encode(batch.column(1)[i].as_py() or ""), end).astype("<u4")
                    sizes = cuts(len(ids), capacity)
                    at = np.cumsum([0, *sizes])
                    owner += [i] * len(sizes)
                    start += at[:-1].tolist()
                    length += sizes
                    total += [len(ids)] * len(sizes)
                    data += [ids[a:b].tobytes() for a, b in zip(at, at[1:])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(owner, pa.int64())), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(total, pa.int64()), pa.array(data, pa.binary())],
                    names=["key", "start", "length", "doc_tokens", "ids"],
                )

    rows = frame.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, start long, length long, doc_tokens long, ids binary")


def pack(
    frame: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id", capacity: int = CAPACITY, end: int = END,
    group_pieces: int = GROUP_PIECES,
) -> DataFrame:
    """(key, start, length, doc_tokens, ids, sequence_id, offset): where each piece of each document lies.

    Whole sequences of long documents are sequences of their own. All other pieces are dealt by a hash of their number to groups of about
    `group_pieces`, whatever their documents, and differencing divides each group into sequences of near-equal length. A
    sequence has the number of its first piece; pieces lie in the order of their numbers, without gaps.

    Null and empty texts are documents of the end id alone. Rows that repeat a key or a text are documents of their own,
    null keys are kept. A long text is cut into more pieces; one text is in memory at a time. An empty table gives an empty
    result. Other columns of the frame are not read.
    """
    numbered = pieces(frame, tokenizer, text, key, capacity, end).withColumn("piece", F.monotonically_increasing_id())
    cut = stored(numbered, "packing-pieces")
    whole = cut.filter(F.col("length") == capacity).withColumn("sequence_id", F.col("piece")).withColumn("offset", F.lit(0).cast("long"))
    parts = cut.filter(F.col("length") < capacity)
    groups = max(1, -(-parts.count() // group_pieces))

    def placed(rows: pa.Table) -> pa.Table:
        rows = rows.drop_columns(["group"]).sort_by("piece")
        lengths, number = rows["length"].to_pylist(), rows["piece"].to_numpy()
        sequence, offset = np.zeros(len(number), np.int64), np.zeros(len(number), np.int64)
        for bag in windows(lengths, capacity):
            bag.sort()
            sequence[bag] = number[bag[0]]
            offset[bag] = np.cumsum([0, *(lengths[i] for i in bag[:-1])])
        return rows.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    dealt = parts.withColumn("group", F.pmod(F.xxhash64("piece"), F.lit(groups)))
    packed = dealt.groupBy("group").applyInArrow(placed, whole.schema)
    return whole.unionByName(packed).withColumnRenamed("key", key).drop("piece")


def sequences(packed: DataFrame, capacity: int = CAPACITY, pad: int = END) -> DataFrame:
    """(sequence_id, length, ids): the packed ids of each sequence, padded to the capacity unless the length is a power of two."""
    inside = F.transform(F.sort_array(F.collect_list(F.struct("offset", "ids"))), lambda piece: piece["ids"])
    joined = packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), inside.alias("inside")).withColumn(
        "ids", F.aggregate("inside", F.lit(b""), lambda ids, more: F.concat(ids, more))
    )
    padding = F.lit(np.array([pad], "<u4").tobytes())
    padded = F.when(F.expr("length & (length - 1)") == 0, F.col("ids")).otherwise(F.rpad("ids", F.lit(4 * capacity), padding))
    return joined.select("sequence_id", "length", padded.alias("ids"))
