"""Near duplicates, contamination and embeddings next to all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from contentflow.llm import components, decontamination, embeddings, minhash, queries
import llm_plain as plain

SMALL = "/root/testdata/sf0.001"


def copies(seed, groups=12, words=60):
    """Texts in groups of near copies, also chains in which only neighbours are alike."""
    rng, out = random.Random(seed), []
    for _ in range(groups):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(1, words))]
        for _ in range(rng.randrange(1, 8)):
            out.append(" ".join(base))
            if rng.random() < 0.7:
                base[rng.randrange(len(base))] = f"w{rng.randrange(400)}"
    out += ["", "  ", None, "one", "One", "one two", "one two three four", " ".join(f"x{i}" for i in range(9000))]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("size", [4, 5])
def test_components_are_those_of_all_pairs(spark, size):
    texts = copies(size)
    frame = spark.createDataFrame([(100 - i, t, 0, "k") for i, t in enumerate(texts)], "doc_id long, text string, component_id int, row1 string")
    found = {r.doc_id: r for r in minhash.near_duplicates(frame, shingle=size).collect()}
    roots = plain.near_groups(texts, size)
    for i, t in enumerate(texts):
        least = min(100 - j for j, r in enumerate(roots) if r == roots[i])
        got = found[100 - i]
        assert (got.component_id, got.kept, got.n_shingles) == (least, least == 100 - i, len(plain.shingles(t, size)))
    kept = minhash.keep_one(frame, minhash.near_duplicates(frame, shingle=size))
    assert sorted(r.doc_id for r in kept.collect()) == sorted({f.component_id for f in found.values()}) and kept.columns == frame.columns


def test_members_that_are_like_another_member_but_not_like_the_centre(spark):
    """Smallest ids are the least alike: the first star of the bucket confirms few of its pairs."""
    base = [f"b{i}" for i in range(100)]
    texts = []
    for i in range(12):
        words = list(base)
        words[8 * i % 96] = f"c{i}"
        words[(8 * i + 40) % 96] = f"d{i}"
        texts.append(" ".join(words))
    texts.append(" ".join(base))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    roots = plain.near_groups(texts)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(frame).collect()}
    assert [got[i] for i in range(len(texts))] == roots


def test_repeated_and_null_keys(spark):
    rows = [(None, "a b c d e f"), (None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (4, "q r s t u v"), (4, "q r s t u v"), (5, None), (None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = minhash.near_duplicates(frame)
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in found.collect()), key=str)
    assert got == sorted([(None, 3, False)] * 2 + [(3, 3, True)] * 2 + [(4, 4, True)] * 2 + [(5, 5, True), (None, None, True)], key=str)
    assert sorted((str(r.doc_id), r.text) for r in minhash.keep_one(frame, found).collect() if r.text) == [("3", "a b c d e f"), ("4", "q r s t u v")]
    assert minhash.near_duplicates(frame.limit(0)).count() == 0


def test_bins_agree_as_often_as_sets_are_alike():
    rng = np.random.default_rng(2)
    for n, share in ((12, 0.8), (400, 0.8), (400, 0.5)):
        agree = []
        for _ in range(40):
            both = rng.integers(0, 2**63, int(round(n * share)), dtype=np.uint64)
            rest = rng.integers(0, 2**63, n - len(both), dtype=np.uint64)
            one, two = np.sort(np.concatenate([both, rest])), np.sort(both)
            of = np.concatenate([np.zeros(len(one), np.int64), np.ones(len(two), np.int64)])
            a, b = minhash.signatures(of, np.concatenate([one, two]), 2)
            agree.append((a == b).mean())
        assert abs(np.mean(agree) - share) < 0.05
    single = minhash.signatures(np.array([0]), np.array([5], np.uint64), 2)
    assert len(set(single[0].tolist())) == 1 and (single[1] == minhash._EMPTY).all()


def test_connected_components(spark):
    rng = random.Random(4)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(35)] + [(i, i + 1) for i in range(100, 140)] + [(7, 7)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    roots = plain.roots(200, links)
    assert got == {n: roots[n] for e in links for n in e}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_contamination_in_one_block_and_in_many(spark):
    rng = random.Random(9)
    words = [f"t{i}" for i in range(30)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 25)))) for i in range(12)]
    items += [(None, "N1 n2 n3"), (50, "solo"), (50, "solo"), (51, None), (52, " .,"), (53, items[0][1]), (54, "ä ö " + items[1][1])]
    texts = [None, "", "...", "solo", "SOLO-solo x", "n1, n2: N3 n1 n2"]
    for _ in range(150):
        body = [rng.choice(words) for _ in range(rng.randrange(30))]
        cut = (items[rng.randrange(12)][1]).split()
        at = rng.randrange(len(body) + 1)
        texts.append(", ".join(body[:at] + cut[rng.randrange(2) :] + body[at:]))
    texts.append(" ".join(rng.choice(words) for _ in range(20_000)))
    frame = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, hits int, hits_before string")
    benchmark = spark.createDataFrame([(k, t, "z") for k, t in items], "item_id long, text string, extra string")
    expected = plain.contamination(texts, items)
    for limit in (10**6, 25):
        out = decontamination.decontaminate(frame, benchmark, block_windows=limit)
        assert out.columns == ["doc_id", "text", "hits_before", "n_words", "n_hit", "hits", "items"]
        for r in out.collect():
            assert (r.n_words, r.n_hit, list(r["items"])) == expected[r.doc_id]
            assert sum(s.end - s.first for s in r.hits) == r.n_hit
    clean = decontamination.decontaminate(frame, benchmark.limit(0)).agg(F.sum("n_hit"), F.sum("n_words")).first()
    assert tuple(clean) == (0, sum(e[0] for e in expected))
    assert decontamination.decontaminate(frame.limit(0), benchmark).count() == 0


def vectors(seed, n=300, size=16):
    rng = np.random.default_rng(seed)
    out = [rng.normal(size=size) for _ in range(n // 3)]
    while len(out) < n:
        out.append(out[rng.integers(len(out))] * rng.uniform(0.5, 2) + rng.normal(size=size) * rng.choice([0.0, 0.05, 0.1, 0.25]))
    return out


def test_embedding_links_are_those_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "TILE", 9)
    rows = [(i, [float(x) for x in np.float32(v)], int(i % 11 > 7)) for i, v in enumerate(vectors(1))]
    rows += [(400 + i, rows[i][1], rows[i][2]) for i in range(0, 60, 3)]
    size = len(rows[0][1])
    rows += [
        (900, None, 0), (901, [0.0] * size, 0), (902, [float("nan")] * size, 0), (903, [float("inf")] + [1.0] * (size - 1), 0), (904, [None] * size, 0), (905, rows[0][1], None),
        (906, rows[0][1][:4], 0), (907, rows[0][1][:4], 0), (908, [], 0),
    ]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, v string, n_links int")
    usable = [i for i, r in enumerate(rows) if r[0] < 900]
    unit = np.array([rows[i][1] for i in usable], dtype=np.float32).astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    close = (unit @ unit.T >= 0.93) & (np.array([rows[i][2] for i in usable])[:, None] == np.array([rows[i][2] for i in usable])[None, :])
    np.fill_diagonal(close, False)
    roots = plain.roots(len(usable), [(i, j) for i, j in zip(*np.nonzero(close))])
    expected = {rows[u][0]: (int(close[i].sum()), rows[roots[i]][0]) for i, u in enumerate(usable)}
    expected |= {r[0]: (0, r[0]) for r in rows if r[0] >= 900} | {906: (1, 906), 907: (1, 906)}
    assert close.sum() > 200
    out = embeddings.embedding_links(frame)
    assert out.columns == ["vec_id", "embedding", "label", "v", "n_links", "component_id", "kept"]
    for r in out.collect():
        assert (r.n_links, r.component_id, r.kept) == (*expected[r.vec_id], expected[r.vec_id][1] == r.vec_id), r.vec_id
    assert embeddings.embedding_links(frame.limit(0)).count() == 0


def test_bounded_products_lose_no_pair():
    a, b = np.array(vectors(3, 400, 24)), np.array(vectors(3, 300, 24))
    axes = np.linalg.eigh(a.T @ a)[1][:, ::-1]
    cosine = embeddings._unit(a) @ embeddings._unit(b).T
    i, j = embeddings.similar_pairs(a, b, axes, 0.9, False)
    assert set(zip(i.tolist(), j.tolist())) == set(zip(*(x.tolist() for x in np.nonzero(cosine >= 0.9))))
    i, j = embeddings.similar_pairs(a, a, axes, 0.9, True)
    own = np.triu(embeddings._unit(a) @ embeddings._unit(a).T >= 0.9, 1)
    assert set(zip(i.tolist(), j.tolist())) == set(zip(*(x.tolist() for x in np.nonzero(own))))


def test_queries_on_a_whole_table(spark):
    docs = {r.doc_id: r.text for r in queries.table(spark, SMALL, "documents").select("doc_id", "text").collect()}
    keys = sorted(docs)
    texts = [docs[k] for k in keys]
    roots = plain.near_groups(texts, 4)
    got = {r.doc_id: r for r in queries.QUERIES["op3_near_duplicates"](spark, SMALL).collect()}
    assert [got[k].component_id for k in keys] == [keys[r] for r in roots]
    items = [(r.item_id, r.text) for r in queries.table(spark, SMALL, "benchmark").collect()]
    got = {r.doc_id: r for r in queries.QUERIES["op4_benchmark_windows"](spark, SMALL).collect()}
    for k, (n, hit, ids) in zip(keys, plain.contamination(texts, items)):
        assert (got[k].n_words, got[k].n_hit, got[k].n_items, got[k].items_sha256) == (n, hit, len(ids), plain.sha(",".join(ids)))
