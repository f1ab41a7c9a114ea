"""Text quality by Bradley-Terry ranking."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from contentflow.llm import grams, learning
from contentflow.llm.folders import stored

BUCKETS, SIZES = 512, (1, 2)
#: Preference pairs drawn from the sample.
PAIRS = 100_000
#: Labelled rows of the sample, see learning.bounded_sample.
SAMPLE_ROWS = 12_000
#: A text is good from this score on: the quantile of the learned scores that separates as many texts as are marked bad.
THRESHOLD = 0.3
#: Bins of a histogram of scores, and scores that are sorted on the driver.
BINS, FEW = 4096, 10_000
#: A text of so many words has half its features' weight.
SHORT = 6.0
KINDS = ("upper", "lower", "digit", "space", "newline", "mark", "sign", "bar", "other")


def _kinds() -> np.ndarray:
    table = np.full(256, KINDS.index("lower"), dtype=np.int64)
    for kind, chars in {
        "upper": range(65, 91), "digit": range(48, 58), "space": (9, 32), "newline": (10, 13), "mark": b".,;:!?'\"-()",
        "sign": b"#$%&*+/<=>@\\^_`~", "bar": b"|[]{}", "other": (*range(9), 11, 12, *range(14, 32), 127),
    }.items():
        table[list(chars)] = KINDS.index(kind)
    return table


_KIND = _kinds()


def features(texts: grams.Texts) -> np.ndarray:
    """Shares of kinds of bytes, statistics of words and their repeats, and roots of byte n-gram shares."""
    n = len(texts)
    size = np.diff(texts.offsets)
    text = np.repeat(np.arange(n), size)
    kinds = np.bincount(text * len(KINDS) + _KIND[texts.data], minlength=n * len(KINDS)).reshape(n, -1) / np.maximum(size, 1)[:, None]
    found = grams.words(texts, grams.SPACED)
    count = found.counts
    per = np.maximum(count, 1)
    length = (found.end - found.begin).astype(float)
    mean = np.bincount(found.text, length, n) / per
    spread = np.sqrt(np.maximum(np.bincount(found.text, length**2, n) / per - mean**2, 0.0))
    of, _, times = grams.distinct_by_text(found.text, found.hashes)
    kinds_of_words = np.bincount(of, minlength=n) / per
    top = np.zeros(n)
    np.maximum.at(top, of, times)
    same = np.zeros(n)
    if len(found.hashes) > 1:
        again = (found.hashes[1:] == found.hashes[:-1]) & (found.text[1:] == found.text[:-1])
        same = np.bincount(found.text[1:], again, n) / per
    pair, first = grams.shingles(found, 2)
    of_pair, _, _ = grams.distinct_by_text(found.text[first], pair)
    pairs = np.bincount(of_pair, minlength=n) / np.maximum(count - 1, 1)
    stats = np.column_stack([np.sqrt(kinds), np.log1p(count), mean, spread, kinds_of_words, top / per, same, pairs, count == 0])
    counts = grams.byte_grams(texts, grams._LOWER, BUCKETS, SIZES)
    shares = np.sqrt(counts / np.maximum(counts.sum(axis=1, keepdims=True), 1.0))
    return np.hstack([stats, shares]).astype(np.float32)


def standardised(x: np.ndarray, middle: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Features by their spread. Those of a text of few words say less and are shrunk; how much is one more feature."""
    words = np.expm1(x[:, [len(KINDS)]])
    trust = words / (words + SHORT)
    return np.hstack([((x - middle) / scale).clip(-8, 8) * trust, 8.0 * (1.0 - trust)]).astype(np.float32)


@dataclass
class Model:
    """Standardised linear scores; `line` is the score quantile of the threshold, `slope` turns distance from it into odds."""

    middle: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    line: float
    slope: float
    constant: float | None = None

    def raw(self, x: np.ndarray) -> np.ndarray:
        return (standardised(x, self.middle, self.scale) @ self.weights).astype(float)

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return learning.sigmoid(self.slope * (self.raw(x) - self.line) + np.log(THRESHOLD / (1 - THRESHOLD)))


def ranked(values: DataFrame, rank: int) -> float:
    """The value of that rank, from 0, of the column raw: histograms narrow it down until few values are left."""
    while True:
        low, high, n = values.agg(F.min("raw"), F.max("raw"), F.count("*")).first()
        if low == high:
            return low
        if n <= FEW:
            return float(np.sort(values.toPandas()["raw"].to_numpy())[rank])
        bin_ = F.least(F.floor((F.col("raw") - low) / (high - low) * BINS), F.lit(BINS - 1))
        for number, count in sorted(values.groupBy(bin_.alias("bin")).count().collect()):
            if rank < count:
                break
            rank -= count
        values = values.filter(bin_ == number)


def fit(
    documents: DataFrame, labels: DataFrame, text: str = "text", label: str = "quality", key: str = "doc_id",
    most: int = SAMPLE_ROWS, seed: int = 9,
) -> Model:
    """Learns from a sample of about `most` labelled rows, half of either label.

    Each preference pair is a text marked 1 and one marked 0; the logistic loss on the difference of their features
    is what Bradley-Terry says of a comparison. The line and the slope are those of the scores of all labelled rows. Labels are 0 or 1; null labels and keys teach nothing. With one label only, or
    none, the score is that label's share, or one half.
    """
    marks = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("label")).filter("label in (0, 1)")
    counts = learning.class_counts(marks, "label")
    if len(counts) < 2:
        return Model(np.zeros(1), np.ones(1), np.zeros(1), 0.0, 0.0, float(next(iter(counts), 0.5)))
    sample = learning.bounded_sample(marks, "label", counts, key="key", most=most)
    # The sample's size is bounded by `most`, so its keys may be sent to every executor.
    joined = documents.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(sample), "key")
    got = grams.mapped(joined, "text", ["key", "label"], {"x": "binary"}, lambda t, _: (pa.array([v.tobytes() for v in features(t)], pa.binary()),))
    got = got.orderBy("key", "label", "x").toPandas()
    y = got["label"].to_numpy()
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return Model(np.zeros(1), np.ones(1), np.zeros(1), 0.0, 0.0, float(counts[1] / (counts[0] + counts[1])))
    x = np.frombuffer(b"".join(got["x"]), dtype=np.float32).reshape(len(y), -1)
    middle, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    x = standardised(x, middle, scale)
    rng = np.random.default_rng(seed)
    winner, loser = rng.choice(good, PAIRS), rng.choice(bad, PAIRS)

    def gradient(w: np.ndarray) -> np.ndarray:
        raw = x @ w
        wrong = learning.sigmoid(raw[loser] - raw[winner]) / PAIRS
        pull = np.bincount(loser, wrong, len(y)) - np.bincount(winner, wrong, len(y))
        return x.T @ pull.astype(np.float32) + np.float32(2e-3) * w

    w = learning.adam(gradient, (x.shape[1],), 250, 0.02)
    model = Model(middle, scale, w, 0.0, 0.0)
    rows = documents.select(F.col(key).alias("key"), F.col(text).alias("text")).filter(F.col("key").isNotNull())
    # Scores meet the labels, so that no text is shuffled.
    raws = grams.mapped(rows, "text", ["key"], {"raw": "double"}, lambda t, _: (model.raw(features(t)),))
    raws = stored(raws.join(marks, "key").select("label", "raw"), "quality-scores")
    # Decimals add up to the same in any order.
    mean = F.avg(F.col("raw").cast("decimal(20,10)")).cast("double")
    means = {r.label: (r.n, r.mean) for r in raws.groupBy("label").agg(F.count("*").alias("n"), mean.alias("mean")).collect()}
    # The quantile lies between two neighbouring scores; the line is in the middle of them.
    line = (ranked(raws, means[0][0] - 1) + ranked(raws, means[0][0])) / 2
    return Model(middle, scale, w, line, float(6.0 / max(abs(means[1][1] - means[0][1]), 1e-6)))


def predict(frame: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds score (double, 0 to 1, higher: better). Null and empty texts have the score of no words.

    A text of any length is read whole. Texts with the same features, and rows that repeat, have the same score. An empty table gives an empty
    result. A column score is replaced.
    """
    keep = [c for c in (frame.columns if keep is None else keep) if c != "score"]
    return grams.mapped(frame, text, keep, {"score": "double"}, lambda t, _: (model.score(features(t)),))
