"""Packing, token alignment and prefix tries next to plain versions."""

import base64
import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from contentflow.llm import alignment, packing, prefix_trie, queries
from contentflow.llm.folders import stored
from contentflow.llm.tokens import byte_bpe, piece_bpe
import llm_plain as plain

SMALL = "/root/testdata/sf0.001"
A, B = queries.tokenizer("byte_bpe_50k.json"), queries.tokenizer("piece_bpe_32k.model")
ODD = [
    None, "", " ", "a", " two  spaces\n\n\tand tabs ", "<|endoftext|> and <s> </s>", "héllo wörld, naïve", "日本語のテキスト", "😀😀 ok", "‹▁› low line",
    "ﬁne ＡＢＣ", "\u0000nul", "x" * 700, "1234567890 " * 50, "same text", "same text", "word " * 3000, "▁", "é́",
]


def library(text):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(A)
    tokenizer.encode_special_tokens = True
    return tokenizer.encode(text, add_special_tokens=False).ids


def test_ids_are_those_of_the_library(spark):
    texts = [t for t in ODD if t] + [r.text for r in queries.table(spark, SMALL, "documents").limit(60).collect() if r.text]
    texts += ["".join(chr(c) + " " + chr(c) * 2 for c in range(k, k + 97)) for k in range(32, 12_000, 97)] + ["  " * 5000 + "\n", "don't I'LL we've '' '"]
    model = byte_bpe(A)
    for text in texts:
        ids = model.encode(text).tolist()
        assert ids == library(text)
        assert b"".join(model.bytes[i] for i in ids) == text.encode()


def packed_rows(spark, rows, **options):
    frame = spark.createDataFrame(rows, "doc_id long, text string, piece string, length int")
    return packing.pack(frame, A, **options)


def test_packing_holds_each_id_once(spark):
    rows = [(i if i % 7 else None, t, "x", 1) for i, t in enumerate(ODD * 3)] + [(5, "again", "x", 1)] * 2
    # The pieces are laid out anew on each call: one table, read twice.
    out = stored(packed_rows(spark, rows, capacity=64, group_pieces=20), "test-packed")
    assert out.columns == ["doc_id", "start", "length", "doc_tokens", "ids", "sequence_id", "offset"]
    got = out.toPandas()
    expected = Counter((i, tuple(library(t or "") + [0])) for i, t, _, _ in rows)
    ids = lambda data: np.frombuffer(data, "<u4").tolist()
    assert all(len(ids(r.ids)) == r.length <= 64 for r in got.itertuples())
    held = Counter((None if r.doc_id is None or math.isnan(r.doc_id) else int(r.doc_id), r.start, tuple(ids(r.ids)), r.doc_tokens) for r in got.itertuples())
    cut = Counter()
    for (key, tokens), times in expected.items():
        start = 0
        for n in packing.cuts(len(tokens), 64):
            cut[(key, start, tokens[start : start + n], len(tokens))] += times
            start += n
        assert start == len(tokens)
    assert held == cut
    for _, part in got.sort_values("offset").groupby("sequence_id"):
        assert part["offset"].tolist() == np.cumsum([0, *part["length"]])[:-1].tolist() and part["length"].sum() <= 64
    whole = {r.sequence_id: r for r in packing.sequences(out, 64, pad=9).collect()}
    for number, part in got.sort_values("offset").groupby("sequence_id"):
        inside = [x for data in part["ids"] for x in ids(data)]
        padded = inside if len(inside) & (len(inside) - 1) == 0 else inside + [9] * (64 - len(inside))
        assert ids(whole[number].ids) == padded and whole[number].length == len(inside)


@pytest.mark.parametrize("seed", range(3))
def test_differencing_balances_and_windows_hold(seed):
    rng = np.random.default_rng(seed)
    lengths = [int(x) for x in rng.integers(1, 513, 600 + 100 * seed)]
    for ways in (1, 7, 160, 300, 5000):
        bags = packing.differencing(lengths, ways)
        assert sorted(i for bag in bags for i in bag) == list(range(len(lengths))) and len(bags) <= ways
    sums = [sum(lengths[i] for i in bag) for bag in packing.differencing(lengths, 40)]
    assert max(sums) - min(sums) <= 3
    found = packing.windows(lengths)
    sums = [sum(lengths[i] for i in bag) for bag in found]
    assert max(sums) <= 1024 and len(found) <= 1.03 * sum(lengths) / 1024 + 2
    assert sorted(i for bag in found for i in bag) == list(range(len(lengths)))
    assert packing.differencing([], 3) == [] and packing.windows([]) == [] and packing.windows([1024, 1024]) == [[0], [1]]


def test_packing_query_pads_little(spark, tmp_path):
    out = queries.QUERIES["op12_packed_sequences"](spark, "/root/testdata/sf0.01").toPandas()
    assert out.dtypes.astype(str).to_dict() == dict.fromkeys(out.columns, "int64")
    assert list(out.columns) == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    sums = out.groupby("sequence_id")["length"].sum().to_numpy()
    padding = np.where(sums & (sums - 1), 1024 - sums, 0).sum()
    assert sums.max() <= 1024 and padding < 0.01 * sums.sum()
    texts = {r.doc_id: r.text for r in queries.table(spark, "/root/testdata/sf0.01", "documents").collect()}
    for r in out.sample(200, random_state=1).itertuples():
        ids = np.array(library(texts[r.doc_id] or "") + [0], "<u4")
        assert (zlib.crc32(ids[r.start : r.start + r.length].tobytes()), r.doc_tokens) == (r.ids_crc32, len(ids))
    assert out.groupby("doc_id")["length"].sum().sort_index().tolist() == out.groupby("doc_id")["doc_tokens"].first().sort_index().tolist()


def plain_alignment(texts):
    first, second = byte_bpe(A), piece_bpe(B)
    facts, counts = [], Counter()
    for text in texts:
        value = text or ""
        a, b = (first.encode(" " + value).tolist(), second.encode(value).tolist()) if value else ([], [])
        if any(b"".join(m.bytes[i] for i in ids) != (" " + value).encode() for m, ids in ((first, a), (second, b))):
            a, b = [], []
        ends = [np.cumsum([len(m.bytes[i]) for i in ids]).tolist() if ids else [] for m, ids in ((first, a), (second, b))]
        shared = sorted(set(ends[0]) & set(ends[1]))
        groups, low = [], 0
        for end in shared:
            groups.append(([i for i, e in zip(a, ends[0]) if low < e <= end], [i for i, e in zip(b, ends[1]) if low < e <= end]))
            low = end
        links = Counter((x, y) for g in groups for x in g[0] for y in g[1])
        counts.update(links.keys())
        facts.append((len(a), len(b), groups, links))
    best = defaultdict(int)
    for (x, _), n in counts.items():
        best[x] = max(best[x], n)
    out = []
    for n_a, n_b, groups, links in facts:
        string = ";".join(f"{','.join(map(str, g[0]))}|{','.join(map(str, g[1]))}" for g in groups)
        out.append(
            (n_a, n_b, len(groups), sum(links.values()), sum(n for p, n in links.items() if counts[p] == best[p[0]]), sum(n * counts[p] for p, n in links.items()), string)
        )
    return out


@pytest.mark.parametrize("frequent, row_pairs", [(200_000, 1 << 16), (12, 3)])
def test_alignment_counts_every_link(spark, monkeypatch, frequent, row_pairs):
    monkeypatch.setattr(alignment, "JOIN_ROWS", 50 if row_pairs < 10 else alignment.JOIN_ROWS)
    rng = random.Random(5)
    words = [t for t in " ".join(t for t in ODD if t and len(t) < 100).split()]
    texts = ODD + [" ".join(rng.choice(words) for _ in range(rng.randrange(30))) for _ in range(60)]
    rows = [(i if i % 9 else None, t, 1, "x") for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, part int, pairs string").repartition(3)
    out = alignment.align(frame, A, B, frequent=frequent, row_pairs=row_pairs)
    assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
    got = Counter(tuple(r) for r in out.collect())
    assert got == Counter((row[0], *facts) for row, facts in zip(rows, plain_alignment(texts)))
    assert alignment.align(frame.limit(0), A, B).count() == 0


def test_alignment_query_over_documents(spark):
    texts = queries.table(spark, SMALL, "documents").select("doc_id", "text").collect()
    expected = {r.doc_id: f for r, f in zip(texts, plain_alignment([r.text for r in texts]))}
    out = queries.QUERIES["op13_token_alignment"](spark, SMALL).collect()
    assert len(out) == len(texts)
    for r in out:
        *numbers, groups = expected[r.doc_id]
        assert list(r[1:7]) == numbers and r.groups_sha256 == (plain.sha(groups) if groups else "")


def plain_trie(conversations):
    """Nodes of {conversation: [(role, text), ...]}: every prefix, each subtree summed by itself."""
    members = defaultdict(list)
    for conv, turns in conversations.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(conv)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = Counter(), Counter()
    for node in sorted(members, key=len, reverse=True):
        leaves[node] += not children[node]
        saved[node] += (len(members[node]) - 1) * len(node[-1][1]) if node else 0
        if node:
            leaves[node[:-1]] += leaves[node]
            saved[node[:-1]] += saved[node]
    return sorted(
        (
            min(convs), len(node), min(members[node[:-1]]) if node else -1, len(convs), len(children[node]), leaves[node], saved[node],
            hashlib.sha256(",".join(str(c) for c in sorted(convs) if len(conversations[c]) == len(node)).encode()).hexdigest(),
        )
        for node, convs in members.items()
    )


def nodes(frame):
    return sorted(tuple(-1 if x is None else x for x in r) for r in frame.collect())


@pytest.mark.parametrize("block, segment, seed", [(32, 20_000, 1), (2, 7, 2), (1, 3, 3)])
def test_trie_is_that_of_all_prefixes(spark, monkeypatch, block, segment, seed):
    monkeypatch.setattr(prefix_trie, "STRIDE", 3)
    rng = random.Random(seed)
    conversations = {}
    for conv in rng.sample(range(-500, 5000), 160):
        turns = [(rng.choice("us"), rng.choice(["", "a", "bé"])) for _ in range(rng.choice([0, 1, 2, 3, 4, 4, 6, 8, 9, 12]))]
        if conversations and rng.random() < 0.5:
            other = rng.choice(list(conversations.values()))
            turns = other[: rng.randrange(len(other) + 1)] + (turns[:2] if rng.random() < 0.6 else [])
        conversations[conv] = turns
    conversations[9000] = conversations[9001] = [("u", "x")] * 70
    conversations[9002] = [("u", "x")] * 69 + [("u", "y")]
    rows = [(c, d, len(t), zlib.crc32(repr(x).encode()), hash(x) % 10**9, len(x[1])) for c, t in conversations.items() for d, x in enumerate(t, 1)]
    turns = spark.createDataFrame(rows, "conv long, depth long, total long, one long, two long, size long").repartition(5)
    members = spark.createDataFrame([(c, len(t)) for c, t in conversations.items()], "conv long, total long")
    assert nodes(prefix_trie.trie(turns, members, block=block, segment=segment)) == plain_trie(conversations)


def plain_rebuilt(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(x)] for c, x in own.items()}
    heads = {c: plain.crc(c) % 6 for c in own}
    return {c: own.get(c - c % 100, [])[: heads[c]] + own[c][heads[c] :] for c in own}


def test_conversations_are_rebuilt_and_counted(spark, tmp_path):
    rng = random.Random(8)
    rows = []
    for conv in [*range(0, 30), 100, 205, 207, 300, 301, 302]:
        turns = rng.sample(range(50), rng.randrange(1, 10))
        rows += [(conv, None if rng.random() < 0.05 else n, rng.choice(["u", "a", None]), rng.choice(["hi", "yo", None, "long " * 50])) for n in turns]
    rows += [(300, 99, "u", "end"), (300, 99, "u", "end"), (None, 1, "u", "lost")]
    # Equal turn numbers are ordered by hashes: here only among equal turns.
    rows = [r for i, r in enumerate(rows) if r[1] is not None or not any(q[0] == r[0] and q[1] is None for q in rows[:i])]
    rows += [(301, 1000 + i, "u", "x") for i in range(2000)]
    frame = spark.createDataFrame([(*r, "k", 1) for r in rows], "conv_id long, turn long, role string, text string, one string, place int").repartition(4)
    frame.write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries.QUERIES["op11_prefix_trie"](spark, str(tmp_path))
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert {t for _, t in got.dtypes[:-1]} == {"bigint"}
    assert nodes(got) == plain_trie(plain_rebuilt(rows))


def test_new_queries_on_empty_tables(spark, tmp_path):
    for name in ("documents", "conversations"):
        queries.table(spark, SMALL, name).limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    for name in ("op11_prefix_trie", "op12_packed_sequences", "op13_token_alignment"):
        assert queries.QUERIES[name](spark, str(tmp_path)).count() == 0
