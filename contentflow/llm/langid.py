"""Language identification by error-correcting output codes."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from contentflow.llm import grams, learning
from contentflow.llm.folders import unused

#: Hashed byte n-grams of letters are the features.
BUCKETS, SIZES = 4096, (1, 2, 3)
#: Up to so many languages, all two-way partitions of them are codewords' bits; beyond it random ones are drawn.
ALL_PARTITIONS = 5
#: The best language's score must be so much above the second's, or the text is flagged.
AMBIGUOUS = 0.1

#: Byte -> lower-cased letter; everything else that is ASCII is one separator.
LETTERS = grams.ALNUM.copy()
LETTERS[:128][~np.isin(np.arange(128), np.r_[65:91, 97:123])] = 32


@dataclass
class Model:
    """Languages, their codewords (languages x bits, +1 or -1), and weight, offset and reliability of each bit's classifier."""

    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    offset: np.ndarray
    trust: np.ndarray


def codewords(n: int, seed: int = 5) -> np.ndarray:
    """n codewords of +1 and -1. No bit is the same for all, none repeats another or its opposite."""
    if n < 2:
        return np.zeros((n, 0), dtype=np.int8)
    if n <= ALL_PARTITIONS:
        bits = [(1, *rest) for rest in product((1, -1), repeat=n - 1) if -1 in rest]
        return np.array(bits, dtype=np.int8).T
    rng, best, distance = np.random.default_rng(seed), None, -1
    for _ in range(200):
        code = rng.choice(np.array([-1, 1], dtype=np.int8), size=(n, int(np.ceil(10 * np.log2(n)))))
        code = np.unique(code * code[0], axis=1)
        code = code[:, np.abs(code.sum(axis=1 - 1)) < n]
        apart = min(int((code[i] != code[j]).sum()) for i in range(n) for j in range(i))
        if apart > distance:
            best, distance = code, apart
    return best


def features(texts: grams.Texts) -> np.ndarray:
    """Roots of n-gram shares, scaled to about 1; zero for a text without bytes."""
    counts = grams.byte_grams(texts, LETTERS, BUCKETS, SIZES)
    shares = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1.0)
    return np.sqrt(shares * BUCKETS).astype(np.float32)


def fit(rows: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id", most: int = learning.SAMPLE_ROWS) -> Model:
    """Learns from a sample of about `most` rows (see learning.bounded_sample) one logistic classifier for each bit.

    Rows with a null text, label or key teach nothing. A single language is always predicted; without any there is none.
    """
    rows = rows.filter(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(label).cast("string").alias("label"))
    counts = learning.class_counts(rows, "label")
    languages = sorted(counts)
    code = codewords(len(languages))
    if not code.size:
        return Model(languages, code, np.zeros((BUCKETS, 0), np.float32), np.zeros(0), np.zeros(0))
    sample = learning.bounded_sample(rows, "label", counts, key="key", most=most)
    got = grams.mapped(sample, "text", ["key", "label"], {"x": "binary"}, lambda t, _: (pa.array([v.tobytes() for v in features(t).astype(np.float16)], pa.binary()),))
    got = got.orderBy("key", "label", "x").toPandas()
    x = np.frombuffer(b"".join(got["x"]), dtype=np.float16).reshape(-1, BUCKETS).astype(np.float32)
    labels = np.array([languages.index(v) for v in got["label"]])
    target = code[labels].astype(np.float32)
    # Each language counts the same, however many rows of it are in the sample.
    each = (1.0 / np.bincount(labels, minlength=len(languages)).clip(1))[labels][:, None].astype(np.float32)
    each /= each.sum()
    offset = np.zeros(code.shape[1], np.float32)

    def gradient(w: np.ndarray) -> np.ndarray:
        slope = -target * learning.sigmoid(-target * (x @ w + offset)) * each
        return x.T @ slope + np.float32(1e-4) * w

    w = learning.adam(gradient, (BUCKETS, code.shape[1]), 120, 0.01)
    right = ((x @ w * target > 0) * each).sum(axis=0)
    return Model(languages, code, w, offset, np.maximum(2.0 * right - 1.0, 1e-3))


def decode(model: Model, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest codeword, its score and the second's. A bit counts by its logistic loss and by how reliable its classifier is."""
    loss = np.stack([(np.logaddexp(0.0, -margins * word) * model.trust).sum(axis=1) for word in model.code], axis=1)
    apart = min(float((model.trust * (a != b)).sum()) for i, a in enumerate(model.code) for b in model.code[:i])
    odds = np.exp(-(loss - loss.min(axis=1, keepdims=True)) / max(apart / 2, 1e-9))
    odds /= odds.sum(axis=1, keepdims=True)
    ranked = np.sort(odds, axis=1)
    return odds.argmax(axis=1), ranked[:, -1], ranked[:, -2]


def predict(frame: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds lang_pred (string), score (double, 0 to 1) and ambiguous (boolean: a second language is nearly as likely).

    Null texts, texts without a letter and every text under a model without languages get `und`, score 0, ambiguous.
    A text of any length is read whole. Of codewords that are equally near the first in the order of the languages wins, and the row is ambiguous. Rows
    that repeat get the same answer each; an empty table gives an empty result. Columns of these three names are replaced.
    """
    keep = [c for c in (frame.columns if keep is None else keep) if c not in ("lang_pred", "score", "ambiguous")]
    letters = unused(frame, "has_letter")
    frame = frame.withColumn(letters, F.coalesce(F.col(text).rlike("\\p{L}"), F.lit(False)))
    languages = np.array(model.languages, dtype=object)

    def work(texts: grams.Texts, _: pa.RecordBatch) -> tuple:
        n = len(texts)
        if not model.code.size:
            one = model.languages[0] if model.languages else "und"
            return [one] * n, np.ones(n), np.full(n, not model.languages)
        best, first, second = decode(model, features(texts) @ model.weights + model.offset)
        return languages[best], first, first - second < AMBIGUOUS

    done = grams.mapped(frame, text, [*keep, letters], {"lang_pred": "string", "score": "double", "ambiguous": "boolean"}, work)
    known = F.col(letters) & (F.col("lang_pred") != "und")
    return (
        done.withColumn("lang_pred", F.when(F.col(letters), F.col("lang_pred")).otherwise("und"))
        .withColumn("score", F.when(known, F.col("score")).otherwise(0.0))
        .withColumn("ambiguous", F.col("ambiguous") | ~known).drop(letters)
    )
