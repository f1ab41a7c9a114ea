"""Shards, mixes, language model scores and the pipeline."""

import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from contentflow.llm import langid, language_model, mixing, queries, sharding
from contentflow.llm.folders import stored
import llm_plain as plain

SMALL = "/root/testdata/sf0.001"
SHARD = "doc_id long, text string, span int, shard string, slot int"


def sharded(frame, n=4, **options):
    return sharding.shard(frame, n, queries.text_bytes(F.col("text")), **options).toPandas()


@pytest.mark.parametrize("kind", ["plain", "one key", "null keys", "hot key", "one row", "negative"])
def test_shards_are_equal_in_bytes_and_gapless(spark, kind):
    rng = np.random.default_rng(1)
    n = 1 if kind == "one row" else 3000
    keys = {"one key": [5] * n, "null keys": [None] * n, "hot key": [7 if i % 3 else i for i in range(n)], "negative": [i - 2000 for i in range(n)]}.get(kind, list(range(n)))
    rows = [(k, None if i % 50 == 0 else "é" * int(rng.zipf(1.5) % 300), 1, "x", 2) for i, k in enumerate(keys)]
    out = sharded(spark.createDataFrame(rows, SHARD), range_bytes=20_000)
    assert len(out) == n and list(out.columns) == ["doc_id", "text", "span", "size", "shard", "slot"]
    assert (out["size"] == [1 + len((t or "").encode()) for t in out["text"]]).all()
    for _, part in out.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))
    sums = out.groupby("shard")["size"].sum()
    if n > 1:
        assert len(sums) == 4 and sums.max() - sums.min() <= 2 * out["size"].max()
    if kind in ("plain", "negative"):
        ordered = out.sort_values("doc_id")
        assert ordered["shard"].is_monotonic_increasing
        assert all(part["slot"].is_monotonic_increasing for _, part in ordered.groupby("shard"))


def test_shards_of_equal_rows_and_of_none(spark):
    frame = spark.createDataFrame([(1, "same text", 0, "", 0)] * 900, SHARD)
    out = sharded(frame, range_bytes=500)
    assert sorted(out.groupby("shard").size()) == [225] * 4
    assert len(sharded(frame.limit(0))) == 0
    with pytest.raises(ValueError):
        sharding.shard(frame, 0, F.lit(1))


def test_shard_query(spark):
    out = queries.QUERIES["op5_shard_bytes"](spark, SMALL).toPandas().set_index("doc_id")
    docs = queries.table(spark, SMALL, "documents").collect()
    assert len(out) == len(docs) and set(out["law"]) == {"bytes"} and out["grown_shard"].isna().all()
    for r in docs:
        assert out.loc[r.doc_id, "text_crc32"] == zlib.crc32(r.text.encode())


def test_targets_fill_up_to_their_limits(spark):
    sizes = {"a": 10, "b": 1000, "c": 5, "é": 300, "z": 0, None: 40}
    frame = spark.createDataFrame([(k, v // 2) for k, v in sizes.items()] + [(k, v - v // 2) for k, v in sizes.items()], "source string, size long")
    got = {r.source: r for r in mixing.source_targets(frame, queries.source_weight()).collect()}
    order = sorted((k for k in sizes if k is not None)) + [None]
    expected = plain.targets([sizes[k] for k in order], [(5, 2, 1)[i % 3] for i in range(len(order))])
    for k, t in zip(order, expected):
        assert got[k].source_size == sizes[k] and math.isclose(got[k].target, t, abs_tol=1e-6)
    assert math.isclose(sum(expected), sum(sizes.values()))
    assert mixing.source_targets(frame.limit(0), queries.source_weight()).count() == 0


def mixed(spark, rows, **options):
    frame = spark.createDataFrame(rows, "doc_id long, source string, size long, copies string, part int")
    return mixing.mix(frame, mixing.source_targets(frame, queries.source_weight()), **options)


def test_a_mix_takes_its_targets_whatever_the_groups(spark):
    rng = np.random.default_rng(3)
    rows = [(i if i % 90 else None, ("a" if i % 3 else f"s{i % 5}") if i % 70 else None, int(rng.zipf(1.6) % 2000) if i % 40 else None, "x", 1) for i in range(4000)]
    for group_rows in (10, 500):
        out = mixed(spark, rows, group_rows=group_rows).toPandas()
        assert len(out) == len(rows) and list(out.columns) == ["doc_id", "source", "size", "part", "source_size", "target", "copies"]
        rate = out["target"] / out["source_size"]
        assert (out["copies"] >= np.floor(rate)).all() and (out["copies"] <= np.ceil(rate)).all() and (out["copies"] <= 3).all()
        for source, part in out.groupby("source", dropna=False):
            taken = (part["copies"] * part["size"].fillna(0)).sum()
            off = abs(taken - part["target"].iloc[0])
            assert off <= part["size"].max() and (group_rows == 10 or off <= 60 + 0.01 * part["target"].iloc[0]), source
    key = ["doc_id", "source", "size", "copies"]
    again = mixed(spark, rows, group_rows=500).toPandas()
    assert again[key].sort_values(key).astype(str).values.tolist() == out[key].sort_values(key).astype(str).values.tolist()
    assert mixed(spark, rows[:0] or rows).limit(0).count() == 0


def test_pivotal_steps_keep_expectations_and_sums():
    rng = np.random.default_rng(8)
    size = np.sort(rng.integers(1, 50, 40).astype(float))[::-1]
    part = rng.uniform(0, 1, 40)
    mean = np.zeros(40)
    for _ in range(4000):
        done = mixing._round_group(size, part, rng.uniform(0, 1, 40))
        assert ((done > 0) & (done < 1)).sum() <= 1 and math.isclose((done * size).sum(), (part * size).sum())
        mean += done / 4000
    assert np.abs(mean - part).max() < 0.05
    assert mixing._round_group(np.array([3.0]), np.array([0.4]), np.array([0.1])).tolist() == [0.4]


def test_mix_query_and_empty_table(spark, tmp_path):
    out = queries.QUERIES["op6_mix_sources"](spark, SMALL).toPandas()
    sums = out.groupby(["source_size", "target"]).agg(taken=("taken", "sum"), most=("size", "max")).reset_index()
    assert (np.abs(sums["taken"] - sums["target"]) <= sums["most"]).all()
    assert (out["taken"] <= 3 * out["size"]).all()
    queries.table(spark, SMALL, "documents").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("op5_shard_bytes", "op6_mix_sources", "op7_maxent_scores", "op10_language_codes", "op3_near_duplicates"):
        assert queries.QUERIES[name](spark, str(tmp_path)).count() == 0


TEXTS = [None, "", " \n", "a b a", "A  b\tc", "é é", "new words only", "x" * 500] + [f"a b c d{i % 7} e{i}" for i in range(80)]


def test_base_scores_and_rare_words(spark):
    rows = [(i, t, 0.0, "r", 1) for i, t in enumerate(TEXTS)] + [(3, "a b a", 0.0, "r", 1), (None, "a c", 0.0, "r", 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, score double, row string, the_row int")
    texts = [r[1] for r in rows]
    taught = [r[0] is not None and plain.crc(r[0]) % 7 != 2 for r in rows]
    expected = sorted((n, k, t, round(b, 6)) for n, k, t, b in plain.unigrams(texts, taught))
    scores = []
    for hot in (5, 10**6):
        out = language_model.score(frame, queries.remainder(7) != 2, hot=hot).toPandas()
        assert list(out.columns) == ["doc_id", "text", "row", "the_row", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        got = sorted((n, k, t, round(b, 6)) for n, k, t, b in out[["n_tokens", "n_known", "train_tokens", "base_score"]].itertuples(index=False))
        assert got == expected
        scores.append(sorted(out["score"].round(6)))
        assert (out["score"] < 0).all()
    # Heads follow the counts, not the number of hot words, as long as it is not below theirs.
    nothing = language_model.score(frame, F.lit(False)).toPandas()
    assert (nothing["base_score"] == 0).all() and (nothing["n_known"] == 0).all() and np.isfinite(nothing["score"]).all()


def test_probabilities_of_groups_add_up():
    rng = np.random.default_rng(4)
    model = language_model.MaxEnt(rng.normal(0, 0.3, language_model.SIZE).astype(np.float32))
    n = language_model.GROUPS
    before = [np.full(n, rng.integers(0, n)) for _ in range(3)]
    t = language_model.Tokens(np.arange(n), before, np.zeros(n, np.int64), np.arange(n))
    assert abs((10.0 ** model.log10(t)).sum() - 1.0) < 1e-4


def test_model_scores_beat_unigrams_on_held_out_texts(spark):
    out = queries.QUERIES["op7_maxent_scores"](spark, "/root/testdata/sf0.01").toPandas()
    for _, part in out.groupby("held_out"):
        assert part["score"].sum() > part["base_score"].sum()


def test_pipeline_stages_decide_as_their_plain_versions(spark, tmp_path):
    docs = queries.table(spark, SMALL, "documents")
    odd = spark.createDataFrame([(100_000, None, "en", "s", 0), (100_001, "12 34 !", "en", None, 7), (100_002, "", None, None, 0)], docs.schema)
    docs = stored(docs.union(odd), "test-docs")
    names = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stored(stage(spark, before, SMALL), f"test-{name}")
        kept[name] = before, docs
        if name != "sharding":
            assert docs.columns == names
    ids = {name: ([(r.doc_id, r.text) for r in a.collect()], [(r.doc_id, r.text) for r in b.collect()]) for name, (a, b) in kept.items()}
    before, after = ids["language"]
    assert sorted(after) == sorted((d, t) for d, t in before if any(c.isalpha() for c in t or ""))
    before, after = ids["near_duplicates"]
    before.sort()
    roots = plain.near_groups([t for _, t in before])
    assert sorted(after) == sorted({before[r] for r in roots})
    before, after = ids["decontamination"]
    items = [(r.item_id, r.text) for r in queries.table(spark, SMALL, "benchmark").collect()]
    assert sorted(after) == sorted(row for row, (_, hit, _) in zip(before, plain.contamination([t for _, t in before], items)) if not hit)
    before, after = ids["mixing"]
    assert set(after) <= set(before) and max(after.count(x) for x in set(after)) <= 3
    shards = kept["sharding"][1].toPandas()
    assert sorted(shards["doc_id"]) == sorted(d for d, _ in after)
    assert sorted(shards["shard"].unique()) == list(range(8))


def test_pipeline_runs_whole_and_on_clashing_names(spark):
    assert corpus_pipeline.run(spark, SMALL).count() > 50
    docs = queries.table(spark, SMALL, "documents").withColumns({c: F.lit("x") for c in ("score", "told", "copies", "hits", "items", "size", "_row1", "target")})
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SMALL), f"clash-{name}")
        assert name == "sharding" or docs.columns[-8:] == ["score", "told", "copies", "hits", "items", "size", "_row1", "target"]
    assert docs.filter("score = 'x' and target = 'x'").count() == docs.count() > 0


def test_language_is_told_from_the_first_and_the_last_word(spark):
    long = "und der die " * 30_000
    train = spark.createDataFrame([(i, "und der die das ist" if i % 2 else "the of and that is", "de" if i % 2 else "en") for i in range(40)], "doc_id long, text string, lang string")
    out = langid.predict(spark.createDataFrame([(1, "the " + long)], "doc_id long, text string"), langid.fit(train)).first()
    assert out.lang_pred == "de"


def test_rows_that_repeat_an_identity_do_not_crowd_a_group(spark, monkeypatch):
    rows = [(None, "a", 7, "x", 1)] * 900 + [(5, "b", 3, "x", 1)] * 400 + [(i, "a" if i % 2 else "b", 1 + i % 9, "x", 1) for i in range(300)]
    out = mixed(spark, rows, group_rows=50).toPandas()
    assert len(out) == len(rows) and out["doc_id"].isna().sum() == 900 and (out["doc_id"] == 5).sum() == 401
    for _, part in out.groupby("source"):
        assert abs((part["copies"] * part["size"]).sum() - part["target"].iloc[0]) <= part["size"].max()
