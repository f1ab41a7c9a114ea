"""Language, quality and toxicity: held-out accuracy on the test tables, exact search, and odd inputs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from contentflow.llm import langid, quality, queries, toxicity
import llm_plain as plain

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, score double, evidence string, ambiguous int"
ODD = [(None, "the cat", "en", None, 1.0, "e", 1), (7, None, "en", None, 1.0, "e", 1), (8, "", "en", "s", None, None, None), (9, " 12 !\n", None, None, 1.0, "", 0), (9, " 12 !\n", None, None, 1.0, "", 0), (10, "word " * 60_000, "en", None, 1.0, "", 0)]


def held(frame, labels, n, rest, label):
    got = frame.join(labels.select("doc_id", label), "doc_id").toPandas()
    assert (got["held_out"] == [plain.crc(d) % n == rest for d in got["doc_id"]]).all()
    assert got["score"].between(0, 1).all()
    return got[got["held_out"]], got


def test_languages_of_held_out_texts(spark):
    documents = queries.table(spark, SF, "documents")
    out = queries.QUERIES["op10_language_codes"](spark, SF)
    part, got = held(out, documents, 4, 2, "lang")
    assert (part["lang"] == part["lang_pred"]).mean() > 0.99 and len(got) == documents.count()


def test_quality_of_held_out_texts(spark):
    part, got = held(queries.QUERIES["op9_quality_ranking"](spark, SF), queries.table(spark, SF, "labels"), 5, 0, "quality")
    assert ((part["score"] >= 0.3) == part["quality"]).mean() > 0.95
    assert (got["predicted"] == (got["score"] >= 0.3)).all()


def test_toxicity_of_held_out_texts(spark):
    part, got = held(queries.QUERIES["op1_toxic_neighbours"](spark, SF), queries.table(spark, SF, "labels"), 3, 1, "toxic")
    assert ((part["score"] >= 0.7) == part["toxic"]).mean() > 0.93
    assert (got["predicted"] == (got["score"] >= 0.7)).all()


@pytest.mark.parametrize("n", [2, 3, 5, 6, 20])
def test_codewords_differ_in_many_bits(n):
    code = langid.codewords(n)
    apart = min((code[i] != code[j]).sum() for i in range(n) for j in range(i))
    assert code.shape[0] == n and apart >= max(1, code.shape[1] // 4)
    assert all(abs(c.sum()) < n for c in code.T)


def test_a_wrong_bit_is_corrected():
    code = langid.codewords(5)
    model = langid.Model(list("abcde"), code, None, None, np.ones(code.shape[1]))
    for word in range(5):
        margins = 4.0 * code[word].astype(float)
        margins[3] *= -1
        best, first, second = langid.decode(model, margins[None, :])
        assert best[0] == word and first[0] > second[0]


def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


def test_language_of_odd_texts(spark):
    texts = [(i, "der die das und", "de", None, 0.0, "", 0) for i in range(20)] + [(i, "the of and that", "en", None, 0.0, "", 0) for i in range(20, 40)]
    train = spark.createDataFrame(texts, DOCS)
    out = langid.predict(odd(spark), langid.fit(train.union(odd(spark)))).collect()
    assert len(out) == len(ODD)
    for r in out:
        lettered = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred in ("en", "de")) == lettered and (lettered or (r.lang_pred, r.score, r.ambiguous) == ("und", 0.0, True))
    empty = train.filter(F.lit(False))
    assert {r.lang_pred for r in langid.predict(odd(spark), langid.fit(empty)).collect()} == {"und"}
    one = langid.predict(odd(spark), langid.fit(train.filter("lang = 'de'"))).collect()
    assert {r.lang_pred for r in one} == {"de", "und"}
    assert langid.predict(empty, langid.fit(train)).count() == 0


def test_quality_and_toxicity_of_odd_tables(spark):
    rng = random.Random(1)
    words = ["alpha", "beta", "gamma", "delta", "omega", "sigma"]
    docs, marks = [], []
    for i in range(120):
        bad = i % 3 == 0
        text = " ".join(rng.choice(words) + str(rng.randrange(50)) for _ in range(20)) + (" vile!! vile!!" if bad else "")
        docs.append((i, text, None, None, 0.0, "", 0))
        marks += [(i, int(not bad), int(bad))] * (1 + (i == 5))
    documents = spark.createDataFrame(docs + ODD, DOCS)
    labels = spark.createDataFrame(marks + [(None, 1, 1), (7, None, None), (8, 0, 0), (999, 1, 0)], "doc_id long, quality int, toxic int")
    none = labels.filter(F.lit(False))

    model = quality.fit(documents, labels)
    got = quality.predict(documents, model).toPandas()
    assert len(got) == len(docs) + len(ODD) and got["score"].between(0, 1).all() and list(got.columns).count("score") == 1
    got = got[got["doc_id"] < 7].dropna(subset=["doc_id"])
    assert ((got["score"] < 0.3) == (got["doc_id"] % 3 == 0)).all()
    assert {r.score for r in quality.predict(odd(spark), quality.fit(documents, none)).collect()} == {0.5}
    assert {r.score for r in quality.predict(odd(spark), quality.fit(documents, labels.filter("quality = 1"))).collect()} == {1.0}

    index = toxicity.fit(documents, labels, documents)
    out = toxicity.predict(documents, index).toPandas()
    assert len(out) == len(docs) + len(ODD) and out["score"].between(0, 1).all()
    marked = out[out["doc_id"] < 7].dropna(subset=["doc_id"])
    assert ((marked["score"] >= 0.7) == (marked["doc_id"] % 3 == 0)).all()
    assert all(len(e) for e in marked[marked["score"] >= 0.7]["evidence"])
    assert {r.score for r in toxicity.predict(odd(spark), toxicity.fit(documents, none, documents)).collect()} == {0.5}
    assert toxicity.predict(documents.filter(F.lit(False)), index).count() == 0


def test_block_max_search_is_exact(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i), " ".join(f"w{t}" for t in rng.zipf(1.4, 12) % 40) + (" bad mean" if i % 2 else " good kind"), None, None, 0.0, "", 0) for i in range(400)]
    documents = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(r[0], r[0] % 2) for r in rows], "doc_id long, toxic int")
    monkey = toxicity.CHI_SQUARE
    toxicity.CHI_SQUARE = 0.0
    try:
        index = toxicity.fit(documents, labels, documents)
    finally:
        toxicity.CHI_SQUARE = monkey
    n, terms = len(index.keys), len(index.vocabulary)
    dense = np.zeros((n, terms))
    for t in range(terms):
        span = slice(index.starts[t, 0], index.starts[t, -1])
        dense[index.examples[span], t] = index.weights[span]
    assert n > 300 and np.allclose((dense**2).sum(axis=1), 1.0)
    for example in range(0, n, 7):
        term = np.flatnonzero(dense[example])
        near, cosine = index.nearest(term, dense[example, term], 15)
        best = np.sort(dense @ dense[example])[::-1][:15]
        assert np.allclose(cosine, best, atol=1e-8) and np.allclose(dense[near] @ dense[example], cosine)


def test_many_texts_are_searched_as_one_is(spark, monkeypatch):
    rng = np.random.default_rng(9)
    rows = [(int(i), " ".join(f"w{t}" for t in rng.zipf(1.3, 15) % 60) + (" bad" if i % 2 else " good"), None, None, 0.0, "", 0) for i in range(300)]
    documents = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(r[0], r[0] % 2) for r in rows], "doc_id long, toxic int")
    index = toxicity.fit(documents, labels, documents)
    pieces = list(toxicity.grams.pieces(toxicity.pa.array([r[1] for r in rows] + [""])))
    of, term, count = toxicity.vectors(pieces[0], index.vocabulary)
    asked = [(term[of == i], index.unit(term[of == i], count[of == i]), i % 3 - 1) for i in range(len(rows) + 1)]
    whole = [index.nearest(*text[:2], 15, but=text[2]) for text in asked]
    for columns in (0, 5, 4096):
        monkeypatch.setattr(toxicity, "COLUMNS", columns)
        other = toxicity.fit(documents, labels, documents)
        assert (other.column >= 0).sum() <= columns
        for (near, cosine), (one, its) in zip(other.search(asked, 15), whole, strict=True):
            assert np.allclose(cosine, its, atol=1e-6) and len(near) == len(one)
    # The matrix of the frequent terms is made where it is used: neither the driver nor the broadcast holds it.
    fresh = toxicity.fit(documents, labels, documents)
    assert "_dense" not in fresh.__dict__ and index.dense().size and "_dense" not in index.__getstate__()


def test_isotonic_curve_rises():
    x, y = np.arange(6.0), np.array([0, 1, 0, 1, 1, 0.5])
    knots, values = toxicity._isotonic(x, y, np.ones(6))
    assert (np.diff(values) >= 0).all() and (np.diff(knots) > 0).all() and values[0] == 0.0


def test_rare_words_of_examples_are_in_the_index(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(f"w{rng.randrange(30)}" for _ in range(12)), None, None, 0.0, "", 0) for i in range(200)]
    rows[7] = (7, "one scarce insult, said only here", None, None, 0.0, "", 0)
    documents = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(r[0], r[0] % 2) for r in rows], "doc_id long, toxic int")
    index = toxicity.fit(documents, labels, documents)
    seen = spark.createDataFrame([(1000, rows[7][1], None, None, 0.0, "", 0), (1001, "quite unseen", None, None, 0.0, "", 0)], DOCS)
    copy, other = toxicity.predict(seen, index, keep=["doc_id"]).orderBy("doc_id").collect()
    assert [(e.doc_id, e.label) for e in copy.evidence] == [(7, 1)] and copy.evidence[0].cosine > 0.9999 and not other.evidence
    # Document frequencies and lengths are those of all terms of all documents.
    worth = np.log((200 + 1) / (1 + 1.0)) + 1.0
    known = np.isin(index.vocabulary, toxicity.terms(next(toxicity.grams.pieces(toxicity.pa.array([rows[7][1]]))))[0])
    assert known.sum() > 6 and np.allclose(index.worth[known], worth)


def test_quality_line_is_the_quantile_of_all_labelled_rows(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(["fine", "plain", "x9$", "##"] if i % 3 else ["fine", "x9$", "##", "||"]) for _ in range(9)), None, None, 0.0, "", 0) for i in range(600)]
    documents = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(r[0], int(r[0] % 3 > 0)) for r in rows] + [(0, 0)], "doc_id long, quality int")
    monkeypatch.setattr(quality, "FEW", 5, raising=False)
    monkeypatch.setattr(quality, "BINS", 7, raising=False)
    model = quality.fit(documents, labels, most=40)
    texts = [r[1] for r in rows] + [rows[0][1]]
    x = np.concatenate([quality.features(p) for p in quality.grams.pieces(quality.pa.array(texts))])
    raw = (quality.standardised(x, model.middle, model.scale) @ model.weights).astype(float)
    bad = np.array([r[0] % 3 == 0 for r in rows] + [True])
    order = np.sort(raw)
    assert np.isclose(model.line, order[bad.sum() - 1 : bad.sum() + 1].mean(), atol=1e-5)
    assert np.isclose(model.slope, 6.0 / abs(raw[bad].mean() - raw[~bad].mean()), rtol=1e-4)


def test_only_whole_copies_are_one_example(spark):
    passage = " ".join(f"licence{i}" for i in range(60))
    rows = [(i, f"{passage} own{i}", None, None, 0.0, "", 0) for i in range(40)] + [(i, f"{passage.upper()}  OWN1!", None, None, 0.0, "", 0) for i in (41, 43)]
    documents = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(r[0], r[0] % 2) for r in rows], "doc_id long, toxic int")
    index = toxicity.fit(documents, labels, documents)
    assert sorted(index.keys) == list(range(40))
    votes = dict(zip(index.keys.tolist(), index.votes.tolist()))
    assert np.isclose(votes[1], 3.0) and np.allclose([votes[i] for i in range(40) if i != 1], 1.0)
