"""The prefix trie of conversations, by union-find over the common prefixes of sorted neighbours.

Conversations are cut into blocks of `BLOCK` turns, so that one of any length is many small rows. A block's context is the hash of all
turns before it; blocks of one context form a trie of their own, whose root is the node where the context's last turn ends. Sorted blocks
are cut into segments. In each, the edges between neighbours are taken by falling common prefix and their components united:
each union makes a branching node, or joins one of that depth. What a segment cannot finish is the path of its first and of its
last block, because these may go on in the neighbouring segments: these paths' nodes, and those where contexts meet, are what is
left of a segment's forest. They are merged by their prefix across all segments.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from contentflow.llm.folders import stored

#: Turns of a block.
BLOCK = 32
#: Blocks whose forest one task builds at once.
SEGMENT = 20_000
#: Blocks of one conversation over which hashes are accumulated in one window.
STRIDE = 1024

_NOTHING = hashlib.sha256(b"").hexdigest()


def numbered(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The rows with `place`: 1, 2, ... within each key in the given order.

    Rows are sorted over the whole cluster and numbered where they lie; a key of any size is spread over as many tasks as it needs.
    """
    rows = stored(rows, "trie-turns").withColumn("_tie", F.monotonically_increasing_id())
    by = [F.col(key), *order, F.col("_tie")]
    ranged = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_task", F.spark_partition_id())
    at = ranged.columns.index(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, count = None, 0
        for batch in batches:
            keys = batch.column(at).to_numpy(zero_copy_only=False)
            if not len(keys):
                continue
            new = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            begin = np.repeat(new, np.diff(np.append(new, len(keys))))
            place = np.arange(len(keys)) - begin + 1
            if keys[0] == last:
                place[begin == 0] += count
            last, count = keys[-1], int(place[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place)], names=[*batch.schema.names, "place"])

    local = stored(ranged.mapInArrow(run, T.StructType([*ranged.schema.fields, T.StructField("place", T.LongType())])), "trie-numbered")
    ends = local.groupBy(key, "_task").agg(F.max("place").alias("rows"))
    earlier = Window.partitionBy(key).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ends.withColumn("before", F.sum("rows").over(earlier)).filter("before is not null").select(key, "_task", "before")
    done = local.join(offsets, [key, "_task"], "left").withColumn("place", F.col("place") + F.coalesce("before", F.lit(0)))
    return done.drop("_task", "_tie", "before")


def turn_hashes(conversations: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, place, one, two, size): the turns in order, each as 128 bits of role and text, and its code points.

    Turns are ordered by `turn`, null first, equal ones by their hashes. A null role or text is empty. Rows without a key are no conversation's.
    """
    empty = F.lit("")
    said, by = F.coalesce(F.col(text).cast("string"), empty), F.coalesce(F.col(role).cast("string"), empty)
    rows = conversations.filter(F.col(key).isNotNull()).select(
        F.col(key).cast("long").alias("conv"), F.col(turn).alias("turn"), F.xxhash64(F.lit(29), by, said).alias("one"),
        F.xxhash64(F.lit(31), said, by).alias("two"), F.char_length(said).cast("long").alias("size"),
    )
    return numbered(rows, "conv", [F.col("turn").asc_nulls_first(), F.col("one"), F.col("two")]).drop("turn")


def with_heads(turns: DataFrame, base: Column, head: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """(turns, members): each conversation's first `head` turns are those of its base conversation, as far as that has them.

    `base` and `head` are expressions over `conv`; a head has `most` turns at most. turns are (conv, depth, total, one, two, size),
    members (conv, total) also has the conversations that are left without a turn.
    """
    lengths = turns.groupBy("conv").agg(F.max("place").alias("length"))
    lengths = stored(lengths.select("conv", "length", base.alias("base"), head.cast("long").alias("head")), "trie-lengths")
    bases = lengths.select(F.col("conv").alias("base"), F.col("length").alias("has"))
    taken = F.least("head", F.coalesce("has", F.lit(0).cast("long")))
    members = lengths.join(bases, "base", "left").withColumn("taken", taken).withColumn(
        "total", F.col("taken") + F.greatest(F.col("length") - F.col("head"), F.lit(0))
    )
    members = stored(members.select("conv", "base", "head", "taken", "total"), "trie-members")
    own = turns.join(members.select("conv", "head", "taken", "total"), "conv").filter("place > head")
    own = own.select("conv", (F.col("place") - F.col("head") + F.col("taken")).alias("depth"), "total", "one", "two", "size")
    firsts = turns.filter(F.col("place") <= most).select(F.col("conv").alias("base"), F.col("place").alias("depth"), "one", "two", "size")
    borrowed = members.select("conv", "base", "taken", "total").join(firsts, "base").filter("depth <= taken")
    return own.unionByName(borrowed.select(*own.columns)), members.select("conv", "total")


def _blocks(turns: DataFrame, members: DataFrame, block: int) -> DataFrame:
    """(key, conv, total, begin, before, next, sizes): the blocks of all conversations.

    key is the context and the hashes of the block's turns, 16 bytes each; next is the context behind the block, begin the turns before it and
    before their code points. A context is the exclusive or of its turns' hashes with their depths, so running values say it.
    """
    at = F.floor((F.col("depth") - 1) / block).cast("long")
    marks = [F.bit_xor(F.xxhash64(F.lit(seed), "depth", "one", "two")).alias(name) for seed, name in ((37, "x"), (41, "y"))]
    inside = F.sort_array(F.collect_list(F.struct("depth", "one", "two", "size")))
    rows = turns.groupBy("conv", at.alias("block")).agg(F.first("total").alias("total"), inside.alias("inside"), *marks, F.sum("size").alias("length"))
    rows = stored(rows, "trie-blocks")
    long = rows.filter(F.col("total") > block).select("conv", "block", F.floor(F.col("block") / STRIDE).alias("stride"), "x", "y", "length")

    def running(frame: DataFrame, window, names: dict[str, str]) -> DataFrame:
        for name, source in names.items():
            total = F.sum(source) if source.endswith("length") else F.bit_xor(source)
            frame = frame.withColumn(name, F.coalesce(total.over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long")))
        return frame

    strides = long.groupBy("conv", "stride").agg(F.bit_xor("x").alias("sx"), F.bit_xor("y").alias("sy"), F.sum("length").alias("slength"))
    strides = running(strides, Window.partitionBy("conv").orderBy("stride"), {"bx": "sx", "by": "sy", "blength": "slength"})
    near = running(long, Window.partitionBy("conv", "stride").orderBy("block"), {"nx": "x", "ny": "y", "nlength": "length"})
    context = near.join(strides.select("conv", "stride", "bx", "by", "blength"), ["conv", "stride"]).select(
        "conv", "block", F.col("nx").bitwiseXOR(F.col("bx")).alias("cx"), F.col("ny").bitwiseXOR(F.col("by")).alias("cy"), (F.col("nlength") + F.col("blength")).alias("before")
    )
    zero = F.lit(0).cast("long")
    short = rows.filter(F.col("total") <= block).withColumns({"cx": zero, "cy": zero, "before": zero})
    rows = short.unionByName(rows.filter(F.col("total") > block).join(context, ["conv", "block"]))
    parts = rows.select(
        "conv", "total", (F.col("block") * block).alias("begin"), "before", "cx", "cy",
        F.col("cx").bitwiseXOR(F.col("x")).alias("dx"), F.col("cy").bitwiseXOR(F.col("y")).alias("dy"),
        *(F.col(f"inside.{name}").alias(f"{name}s") for name in ("one", "two", "size")),
    )
    none = F.array().cast("array<long>")
    without = members.filter("total = 0").select(
        "conv", "total", *(zero.alias(n) for n in ("begin", "before", "cx", "cy", "dx", "dy")), *(none.alias(f"{n}s") for n in ("one", "two", "size"))
    )

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = dict(zip(batch.schema.names, batch.columns))
            n = batch.num_rows
            counts = np.diff(column["ones"].offsets.to_numpy())
            row = np.cumsum(counts + 1) - counts - 1
            units = np.zeros((int((counts + 1).sum()), 2), ">u8")
            inner = np.ones(len(units), bool)
            inner[row] = False
            for side, (first, name) in enumerate((("cx", "ones"), ("cy", "twos"))):
                units[row, side] = column[first].to_numpy().view(np.uint64)
                units[inner, side] = column[name].flatten().to_numpy().view(np.uint64)
            behind = np.column_stack([column["dx"].to_numpy().view(np.uint64), column["dy"].to_numpy().view(np.uint64)]).astype(">u8")
            key = pa.Array.from_buffers(
                pa.binary(), n, [None, pa.py_buffer(np.append(row, len(units)).astype(np.int32) * np.int32(16)), pa.py_buffer(units.tobytes())]
            )
            following = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1, dtype=np.int32) * 16)), pa.py_buffer(behind.tobytes())])
            kept = [column[c] for c in ("conv", "total", "begin", "before", "sizes")]
            yield pa.RecordBatch.from_arrays([key, following, *kept], names=["key", "next", "conv", "total", "begin", "before", "sizes"])

    schema = "key binary, next binary, conv long, total long, begin long, before long, sizes array<long>"
    return stored(parts.unionByName(without).mapInArrow(keyed, schema), "trie-keys")


class Forest(NamedTuple):
    """The nodes of a segment's forest, one entry for each branching or ending node.

    Node v covers the rows low[v] to high[v] and, with the same members, the depths above[v] + 1 to depth[v] of their block;
    least[v] is the row of its smallest conversation, parent[v] the node above or -1. end[i] is the node where row i ends.
    """

    low: np.ndarray
    high: np.ndarray
    depth: np.ndarray
    above: np.ndarray
    least: np.ndarray
    parent: np.ndarray
    end: np.ndarray


def forest(lengths: np.ndarray, common: np.ndarray, conv: np.ndarray) -> Forest:
    """The forest of sorted rows: `common[i]` is the prefix that row i + 1 shares with row i, -1 if not even the context.

    Edges are taken by falling prefix. An edge unites the components of its two rows in a node of its depth: a new one, or the one of
    that depth that either component already is.
    """
    n = len(lengths)
    low, high, least = list(range(n)), list(range(n)), list(range(n))
    depth, conv = lengths.tolist(), conv.tolist()
    parent, same = [-1] * n, list(range(n))
    up, top = list(range(n)), list(range(n))

    def find(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    edges = np.flatnonzero(common >= 0)
    for i in edges[np.argsort(-common[edges], kind="stable")].tolist():
        prefix, a, b = int(common[i]), find(i), find(i + 1)
        one, two = top[a], top[b]
        if depth[one] == prefix:
            node = one
            if depth[two] == prefix:
                same[two] = one
            else:
                parent[two] = one
        elif depth[two] == prefix:
            node = two
            parent[one] = two
        else:
            node = len(depth)
            depth.append(prefix)
            low.append(low[one]), high.append(high[two]), least.append(least[one]), parent.append(-1), same.append(node)
            parent[one] = parent[two] = node
        smaller = one if conv[least[one]] <= conv[least[two]] else two
        low[node], high[node], least[node] = low[one], high[two], least[smaller]
        up[b] = a
        top[a] = node
    same = np.array(same, np.int64)
    while (same != same[same]).any():
        same = same[same]
    real = np.flatnonzero(same == np.arange(len(same)))
    number = np.full(len(same) + 1, -1)
    number[real] = np.arange(len(real))
    parent = np.array(parent, np.int64)[real]
    parent = np.where(parent < 0, -1, number[same[parent]])
    depth = np.array(depth, np.int64)[real]
    above = np.where(parent < 0, -1, depth[parent])
    return Forest(np.array(low)[real], np.array(high)[real], depth, above, np.array(least)[real], parent, number[same[:n]])


class Segment:
    """Sorted blocks, their forest, and for every node of it at every depth what is known of it here."""

    def __init__(self, rows: pa.Table, block: int):
        self.keys, self.next = rows["key"].to_pylist(), rows["next"]
        self.conv, total, self.begin = (rows[c].to_numpy() for c in ("conv", "total", "begin"))
        n = len(self.keys)
        sizes = rows["sizes"].combine_chunks()
        lengths = np.diff(sizes.offsets.to_numpy()).astype(np.int64)
        inside = np.arange(block) < lengths[:, None]
        self.passed = np.zeros((n, block + 1), np.int64)
        self.passed[:, 1:][inside] = sizes.flatten().to_numpy()
        self.passed[:, 0] = rows["before"].to_numpy()
        np.cumsum(self.passed, axis=1, out=self.passed)
        bits = np.zeros((n, block + 1, 2), np.uint64)
        bits[np.arange(block + 1) <= lengths[:, None]] = np.frombuffer(b"".join(self.keys), np.uint64).reshape(-1, 2)
        equal = (bits[1:] == bits[:-1]).all(axis=2) & (np.arange(block + 1) <= np.minimum(lengths[1:], lengths[:-1])[:, None])
        common = np.where(equal.all(axis=1), block + 1, equal.argmin(axis=1)) - 1
        self.found = f = forest(lengths, common, self.conv)
        goes_on = total > self.begin + lengths
        self.ends = ~goes_on
        ahead = np.concatenate([[0], np.cumsum(goes_on)])
        edge = (f.low == 0) | (f.high == n - 1)
        passes = ahead[f.high + 1] > ahead[f.low]
        # A node at each of its depths.
        span = f.depth - f.above
        self.node = node = np.repeat(np.arange(len(span)), span)
        self.depth = depth = np.arange(len(node)) - np.repeat(np.cumsum(span) - span, span) + f.above[node] + 1
        self.last = last = depth == f.depth[node]
        glue = (depth == 0) & (self.begin[f.low[node]] > 0)
        self.glue = glue
        self.open = open_ = edge[node] | (passes[node] & last & (f.depth[node] == block)) | glue
        first = np.cumsum(span) - span
        above = np.where(depth > f.above[node] + 1, np.arange(len(node)) - 1, np.where(f.parent[node] >= 0, (first + span - 1)[f.parent[node]], -1))
        self.above = above
        children = np.bincount(above[above >= 0], minlength=len(node))
        closed = np.bincount(above[(above >= 0) & ~open_], minlength=len(node))
        # An open node's open children are counted after the merge, when each is there once.
        self.children = np.where(open_, closed, children)
        self.row = f.low[node]

    def prefix(self, entry: int) -> bytes:
        """What an open node is merged by: the context and turns up to it, or the context behind a full block."""
        row, depth = self.row[entry], self.depth[entry]
        if depth and depth == self.passed.shape[1] - 1:
            return self.next[int(row)].as_py()
        return self.keys[row][: 16 * (depth + 1)]


def _segments(rows: DataFrame, schema: str, block: int, segment: int, work) -> DataFrame:
    """What `work` makes of each segment of the rows sorted by key and conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, count = [], 0
        for batch in batches:
            while batch.num_rows:
                some = batch.slice(0, segment - count)
                waiting.append(some)
                count += some.num_rows
                batch = batch.slice(some.num_rows)
                if count == segment:
                    yield from work(pa.Table.from_batches(waiting).combine_chunks())
                    waiting, count = [], 0
        if waiting:
            yield from work(pa.Table.from_batches(waiting).combine_chunks())

    return rows.repartitionByRange("key", "conv").sortWithinPartitions("key", "conv").mapInArrow(run, schema)


def _rows(schema: pa.Schema, **columns) -> pa.RecordBatch:
    n = max(len(c) for c in columns.values())
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema
    )


def _merged(parts: DataFrame) -> DataFrame:
    """Open nodes, each once: their smallest conversation, and the children that are open nodes themselves added."""
    merged = parts.groupBy("id").agg(
        F.max("above").alias("above"), F.min(F.when(F.col("n_convs") > 0, F.col("conv"))).alias("conv"), F.max("depth").alias("depth"), F.min("parent").alias("parent"),
        F.sum("n_convs").alias("n_convs"), F.sum("children").alias("children"), F.sum("leaves").alias("leaves"),
        F.sum("shared").alias("shared"), F.max("before").alias("before"),
    )
    merged = stored(merged, "trie-merged")
    more = merged.filter("above is not null").groupBy(F.col("above").alias("id")).agg(F.count("*").alias("more"))
    return merged.join(more, "id", "left").withColumn("children", F.col("children") + F.coalesce("more", F.lit(0))).drop("more")


def trie(turns: DataFrame, members: DataFrame, block: int = BLOCK, segment: int = SEGMENT) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) for each node of the trie.

    turns are (conv, depth from 1 without gaps, total, one, two, size), members (conv, total): all conversations, also those without a turn.
    A node is a distinct sequence of first turns; conv_id is its smallest member. Equal conversations are members of the same nodes.
    Without members there is no node.

    Two passes over the sorted blocks. A conversation that is not the smallest of a node shares its way down to the deepest such
    node: the first pass finds the code points of that way, and the conversations that stand for a leaf. What a node's subtree
    saves is the sum over its other members of these code points, less those above the node; the second pass sums both.
    """
    blocks = _blocks(turns, members, block)
    flat = "id binary, above binary, conv long, depth long, parent long, n_convs long, children long, leaves long, shared long, before long, kind int"
    fields = {
        "id": pa.binary(), "above": pa.binary(), "conv": pa.int64(), "depth": pa.int64(), "parent": pa.int64(), "n_convs": pa.int64(),
        "children": pa.int64(), "leaves": pa.int64(), "shared": pa.int64(), "before": pa.int64(), "kind": pa.int32(),
    }
    first_schema, second_schema = pa.schema(fields), pa.schema(fields | {"saved": pa.int64(), "ends": pa.string(), "order": pa.int64()})

    def open_nodes(s: Segment, at: np.ndarray) -> dict:
        f, node = s.found, s.node[at]
        named = s.above[at] >= 0
        parent_open = np.where(named, s.open[s.above[at]], False)
        parent = [None if p < 0 or o else int(s.conv[f.least[s.node[p]]]) for p, o in zip(s.above[at], parent_open)]
        glue = s.glue[at]
        return {
            "id": [s.prefix(e) for e in at], "above": [s.prefix(p) if o else None for p, o in zip(s.above[at], parent_open)],
            "conv": s.conv[f.least[node]], "depth": s.begin[s.row[at]] + s.depth[at], "parent": parent,
            "n_convs": np.where(glue, 0, f.high[node] - f.low[node] + 1), "children": s.children[at],
            "before": np.where(s.depth[at] > 0, s.passed[s.row[at], np.maximum(s.depth[at] - 1, 0)], 0),
        }

    def losses(table: pa.Table) -> Iterator[pa.RecordBatch]:
        s = Segment(table, block)
        f = s.found
        at = np.flatnonzero(s.open)
        # Here `shared` is the code points down to the node, which a conversation that is not the smallest of all shares.
        yield _rows(first_schema, **open_nodes(s, at), shared=s.passed[s.row[at], s.depth[at]], leaves=np.zeros(len(at), np.int64), kind=np.full(len(at), 1))
        row = np.arange(len(s.conv))
        below = np.flatnonzero(f.parent >= 0)
        who = np.concatenate([row, f.least[below]])
        there = np.concatenate([f.end, f.parent[below]])
        lost = s.conv[who] != s.conv[f.least[there]]
        who, there = who[lost], there[lost]
        yield _rows(first_schema, conv=s.conv[who], shared=s.passed[f.low[there], f.depth[there]], kind=np.full(len(who), 2))
        leaf = s.node[s.last & ~s.open & (s.children == 0)]
        yield _rows(first_schema, conv=s.conv[f.least[leaf]], kind=np.full(len(leaf), 3))

    first = stored(_segments(blocks, flat, block, segment, losses), "trie-first")
    parts = first.filter("kind = 1")
    merged = stored(_merged(parts), "trie-open")
    beaten = parts.filter("n_convs > 0").join(merged.select("id", F.col("conv").alias("least")), "id").filter("conv <> least").select("conv", "shared")
    shared = first.filter("kind = 2").select("conv", "shared").union(beaten).groupBy("conv").agg(F.max("shared").alias("shared"))
    leaves = first.filter("kind = 3").select("conv").union(merged.filter("children = 0").select("conv"))
    known = shared.select("conv", "shared", F.lit(0).alias("leaf")).union(leaves.select("conv", F.lit(0).cast("long"), F.lit(1)))
    known = known.groupBy("conv").agg(F.max("shared").alias("shared"), F.max("leaf").cast("long").alias("leaf"))

    def sums(table: pa.Table) -> Iterator[pa.RecordBatch]:
        s = Segment(table, block)
        f = s.found
        own, leaf = (table[c].to_numpy() for c in ("shared", "leaf"))
        total, leaves = (np.concatenate([[0], np.cumsum(x)]) for x in (own, leaf))
        sum_own, sum_leaf = total[f.high + 1] - total[f.low], leaves[f.high + 1] - leaves[f.low]
        # Members that end at a node come first among its rows, by rising conversation.
        ending = np.bincount(f.end[s.ends], minlength=len(f.low))
        at = np.flatnonzero(s.open)
        node, glue = s.node[at], s.glue[at]
        texts, order = [None] * len(at), [None] * len(at)
        for i, (v, ends) in enumerate(zip(node, np.where(s.last[at] & ~glue, ending[node], 0))):
            if ends:
                here = np.arange(f.low[v], f.high[v] + 1)
                rows = s.conv[here[s.ends[here] & (f.end[here] == v)]].tolist()
                texts[i], order[i] = ",".join(map(str, rows)), rows[0]
        yield _rows(
            second_schema, **open_nodes(s, at), leaves=np.where(glue, 0, sum_leaf[node]), shared=np.where(glue, 0, sum_own[node]),
            kind=np.full(len(at), 1), ends=texts, order=order, saved=np.where(glue, 0, own[f.least[node]]),
        )
        at = np.flatnonzero(~s.open)
        node = s.node[at]
        n = f.high[node] - f.low[node] + 1
        parent_open = s.open[s.above[at]] & (s.above[at] >= 0)
        before = np.where(s.depth[at] > 0, s.passed[s.row[at], np.maximum(s.depth[at] - 1, 0)], 0)
        convs = list(map(str, s.conv.tolist()))
        digests = [
            hashlib.sha256(",".join(convs[low : low + k]).encode()).hexdigest() if k else _NOTHING
            for low, k in zip(f.low[node].tolist(), np.where(s.last[at], ending[node], 0).tolist())
        ]
        parents = s.conv[f.least[s.node[s.above[at]]]]
        yield _rows(
            second_schema, conv=s.conv[f.least[node]], depth=s.begin[s.row[at]] + s.depth[at],
            parent=pa.array(parents, mask=parent_open | (s.above[at] < 0)), above=[s.prefix(p) if o else None for p, o in zip(s.above[at], parent_open)],
            n_convs=n, children=s.children[at], leaves=sum_leaf[node], saved=sum_own[node] - own[f.least[node]] - (n - 1) * before,
            ends=digests, kind=np.zeros(len(at), np.int64),
        )

    zero = F.lit(0).cast("long")
    rows = blocks.join(known, "conv", "left").withColumns({c: F.coalesce(c, zero) for c in ("shared", "leaf")})
    second = stored(_segments(stored(rows, "trie-blocks"), f"{flat}, saved long, ends string, order long", block, segment, sums), "trie-second")
    # The share of the smallest member itself is no saving.
    parts = second.filter("kind = 1")
    merged = stored(_merged_sums(parts), "trie-open")
    digests = _digests(parts.filter("ends is not null").select("id", "order", "ends"))
    parents = merged.select(F.col("id").alias("above"), F.col("conv").alias("merged_parent"))
    closed = second.filter("kind = 0").select("conv", "depth", "parent", "above", "n_convs", "children", "leaves", "saved", F.col("ends").alias("ends_sha256"))
    opened = merged.join(digests, "id", "left").select(
        "conv", "depth", "parent", "above", "n_convs", "children", "leaves", "saved", F.coalesce("ends_sha256", F.lit(_NOTHING)).alias("ends_sha256")
    )
    nodes = closed.filter("above is null").withColumn("merged_parent", F.lit(None).cast("long")).drop("above").unionByName(
        closed.filter("above is not null").unionByName(opened).join(parents, "above", "left").drop("above")
    )
    return nodes.select(
        F.col("conv").alias("conv_id"), "depth", F.coalesce("parent", "merged_parent").alias("parent_conv_id"), "n_convs",
        F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), "ends_sha256",
    )


def _merged_sums(parts: DataFrame) -> DataFrame:
    """Open nodes with the sums of their members; `saved` of a part is the share of its smallest conversation."""
    merged = _merged(parts)
    smallest = parts.filter("n_convs > 0").groupBy("id").agg(F.min_by("saved", "conv").alias("own"))
    saved = F.col("shared") - F.col("own") - (F.col("n_convs") - 1) * F.col("before")
    return merged.join(smallest, "id").withColumn("saved", saved)


def _digests(texts: DataFrame) -> DataFrame:
    """(id, ends_sha256) of the texts of each id, joined by commas in their order. One text is in memory at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, digest = None, None
        for batch in batches:
            done = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if key != current:
                    if current is not None:
                        done.append((current, digest.hexdigest()))
                    current, digest = key, hashlib.sha256(text.encode())
                else:
                    digest.update(b"," + text.encode())
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done], pa.string())], names=["id", "ends_sha256"])
        if current is not None:
            yield pa.RecordBatch.from_arrays([pa.array([current], pa.binary()), pa.array([digest.hexdigest()], pa.string())], names=["id", "ends_sha256"])

    return texts.repartition("id").sortWithinPartitions("id", "order").mapInArrow(run, "id binary, ends_sha256 string")
