"""Toxicity by the nearest labelled examples, found through an inverted index whose frequent terms are columns of a matrix."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from contentflow.llm import grams, learning
from contentflow.llm.folders import stored

#: Labelled examples in the index, half of either label.
EXAMPLES = 8000
#: Terms whose chi-square in the sample is above this tell the labels apart and weigh more; all terms are in the index.
CHI_SQUARE = 25.0
#: Terms are words and the beginnings of longer words, of so many bytes.
BEGINNINGS = (4, 5)
#: Neighbours that vote, and texts that are searched for at a time.
NEIGHBOURS, TOGETHER = 15, 256
#: A term is frequent if more than this share of the examples have it, but no more terms than this are: the most frequent.
FREQUENT, COLUMNS = 1 / 20, 4096
#: A text is toxic from this score on.
THRESHOLD = 0.7


def terms(texts: grams.Texts) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the terms of each text, and the texts' numbers."""
    found = grams.words(texts, grams.ALNUM)
    hashes, text = [found.hashes], [found.text]
    for size in BEGINNINGS:
        longer = found.end - found.begin > size
        code = np.zeros(int(longer.sum()), dtype=np.uint64)
        for j in range(size):
            code = (code << np.uint64(8)) | grams.ALNUM[texts.data[found.begin[longer] + j]].astype(np.uint64)
        hashes.append(grams.mix(code + np.uint64(size)))
        text.append(found.text[longer])
    return np.concatenate(hashes), np.concatenate(text)


def whole(texts: grams.Texts) -> np.ndarray:
    """A hash of all words of each text in their order: the same for copies, whatever stands between the words."""
    found = grams.words(texts, grams.ALNUM)
    out = np.zeros(len(texts), dtype=np.uint64)
    place = np.arange(len(found.hashes)) - (found.ends - found.counts)[found.text]
    np.add.at(out, found.text, grams.mix(found.hashes + grams.mix(place.astype(np.uint64) + np.uint64(1))))
    return out.view(np.int64)


def counted(texts: grams.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, term hash, count), sorted."""
    hashes, text = terms(texts)
    order = np.argsort(text, kind="stable")
    return grams.distinct_by_text(text[order], hashes[order])


def vectors(texts: grams.Texts, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, term number, count), sorted, for the terms in the sorted vocabulary."""
    text, hashes, count = counted(texts)
    if not len(vocabulary):
        return (np.zeros(0, np.int64),) * 3
    at = np.searchsorted(vocabulary, hashes).clip(max=len(vocabulary) - 1)
    known = vocabulary[at] == hashes
    return text[known], at[known], count[known]


@dataclass
class Index:
    """Postings of all terms of the examples.

    `starts[t, 0]` to `starts[t, 1]` are the postings of term t: example numbers and TF-IDF weights of unit-length
    vectors; `worth` is a term's inverse document frequency times its extra weight. `column[t]` is the place of a frequent
    term among the columns of `dense`, else -1.
    """

    vocabulary: np.ndarray
    worth: np.ndarray
    keys: np.ndarray
    labels: np.ndarray
    votes: np.ndarray
    starts: np.ndarray
    examples: np.ndarray
    weights: np.ndarray
    column: np.ndarray
    base: float = 0.0
    knots: tuple[np.ndarray, np.ndarray] = field(default_factory=lambda: (np.zeros(1), np.zeros(1)))

    def dense(self) -> np.ndarray:
        """The weights of the frequent terms in all examples. Each process makes them from the postings when it first searches."""
        made = self.__dict__.get("_dense")
        if made is None:
            often = np.flatnonzero(self.column >= 0)
            made = np.zeros((len(self.keys), len(often)), np.float32)
            for term, (start, end) in zip(often, self.starts[often].tolist()):
                made[self.examples[start:end], self.column[term]] = self.weights[start:end]
            self._dense = made
        return made

    def __getstate__(self) -> dict:
        return {name: value for name, value in self.__dict__.items() if name != "_dense"}

    def nearest(self, term: np.ndarray, weight: np.ndarray, k: int, but: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and cosines of the k most similar examples with a positive cosine, without example `but`."""
        return next(self.search([(term, weight, but)], k))

    def search(self, texts: list[tuple[np.ndarray, np.ndarray, int]], k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """`nearest` for each (terms, weights, example to leave out).

        What the frequent terms add to the cosines is one product of matrices for many texts, what the others add is summed up from their
        postings. The product has single precision and may be rounded otherwise among other texts, so the cosines of all examples that may be
        among the k best are summed up anew.
        """
        dense = self.dense()
        for first in range(0, len(texts), TOGETHER):
            some = texts[first : first + TOGETHER]
            columns = [self.column[term] for term, _, _ in some]
            whole = np.zeros((len(some), dense.shape[1]), np.float32)
            for row, (_, weight, _), column in zip(whole, some, columns):
                often = column >= 0
                row[column[often].astype(np.int64)] = weight[often]
            for added, (term, weight, but), column in zip(whole @ dense.T, some, columns):
                if not len(term):
                    yield np.zeros(0, np.int64), np.zeros(0)
                    continue
                often = column >= 0
                rare = self._rare(term[~often], weight[~often])
                rough = rare + added
                if but >= 0:
                    rough[but] = 0.0
                line = np.partition(rough, len(rough) - k)[len(rough) - k] if len(rough) > k else 0.0
                # The margin is far above the rounding of single precision.
                near = np.flatnonzero(rough > line - 1e-5) if line > 1e-5 else np.flatnonzero(rough > 0)
                cosine = rare[near] + (dense[near[:, None], column[often]] * weight[often]).sum(axis=1)
                yield self._best(near[cosine > 0], cosine[cosine > 0], k)

    def _rare(self, term: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """What some terms add to the cosine of each example, from their postings."""
        size = self.starts[term, 1] - self.starts[term, 0]
        ends = size.cumsum()
        place = np.repeat(self.starts[term, 0] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)
        return np.bincount(self.examples[place], np.repeat(weight, size) * self.weights[place], len(self.keys))

    @staticmethod
    def _best(near: np.ndarray, cosine: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cosine) > k:
            kept = cosine >= np.partition(cosine, len(cosine) - k)[len(cosine) - k]
            near, cosine = near[kept], cosine[kept]
        order = np.lexsort((near, -cosine))[:k]
        return near[order], cosine[order]

    def unit(self, term: np.ndarray, count: np.ndarray) -> np.ndarray:
        weight = (1.0 + np.log(count)) * self.worth[term]
        return weight / np.sqrt((weight**2).sum())

    def vote(self, near: np.ndarray, cosine: np.ndarray) -> float:
        """Share of toxic votes; nearer examples count more, each for the labelled rows that it stands for."""
        weight = self.votes[near] / (1.05 - np.minimum(cosine, 1.0))
        return float((weight * self.labels[near]).sum() / weight.sum())

    def calibrated(self, vote: float) -> float:
        return float(np.interp(vote, *self.knots))


def _isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing curve through (x, y) of least squares (pooling of adjacent violators)."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []  # sum of weight, of weight * y, of weight * x
    for i in order:
        pools.append([weight[i], weight[i] * y[i], weight[i] * x[i]])
        while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
            top = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], top)]
    return np.array([p[2] / p[0] for p in pools]), np.array([p[1] / p[0] for p in pools])


def _extra(n: np.ndarray, toxic: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """The extra weight of each term: 1, and more the further its chi-square over the examples is above CHI_SQUARE.

    `n` examples have the term, and `toxic` toxic ones.
    """
    share = labels.mean()
    spread = n * (1 - n / (len(labels) + 1.0)) * share * (1 - share)
    chi = (toxic - n * share) ** 2 / spread
    return np.sqrt(1.0 + np.maximum(chi - CHI_SQUARE, 0.0))


def _vocabulary(sample: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sorted hashes of all terms of the examples, and how many examples and toxic examples have each."""

    def run(batches):
        for batch in batches:
            labels = batch.column(1).to_numpy(zero_copy_only=False)
            for piece in grams.pieces(batch.column(0)):
                of, hashes, _ = counted(piece)
                hashes, at = np.unique(hashes, return_inverse=True)
                n, toxic = np.bincount(at, minlength=len(hashes)), np.bincount(at, labels[piece.first : piece.last][of], len(hashes))
                yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(n), pa.array(toxic.astype(np.int64))], names=["t", "n", "toxic"])

    told = sample.select("text", "label").mapInArrow(run, "t long, n long, toxic long")
    got = told.groupBy("t").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic")).toArrow()
    vocabulary, n, toxic = (got.column(c).to_numpy() for c in ("t", "n", "toxic"))
    order = np.argsort(vocabulary.view(np.uint64))
    return vocabulary.view(np.uint64)[order], n[order], toxic[order]


def _numbers(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    """The numbers in a column of binaries, one after the other."""
    return np.concatenate([np.frombuffer(b.as_buffer(), kind) for b in column] or [np.zeros(0, kind)])


def _frequencies(documents: DataFrame, text: str, vocabulary: np.ndarray) -> tuple[np.ndarray, int]:
    """In how many of all documents each term of the vocabulary occurs, and the number of documents."""

    def run(batches):
        total, rows = np.zeros(len(vocabulary), np.int64), 0
        for batch in batches:
            rows += batch.num_rows
            for piece in grams.pieces(batch.column(0)):
                total += np.bincount(vectors(piece, vocabulary)[1], minlength=len(vocabulary))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1)), pa.array(np.append(total[used], rows))], names=["t", "n"])

    got = documents.select(F.col(text).cast("string")).mapInArrow(run, "t long, n long").groupBy("t").agg(F.sum("n").alias("n")).toPandas()
    frequency = np.zeros(len(vocabulary), np.int64)
    term, count = got["t"].to_numpy(np.int64), got["n"].to_numpy(np.int64)
    frequency[term[term >= 0]] = count[term >= 0]
    return frequency, int(count[term < 0].sum())


def fit(documents: DataFrame, labels: DataFrame, corpus: DataFrame, text: str = "text", label: str = "toxic", key: str = "doc_id", most: int = EXAMPLES) -> Index:
    """Indexes a sample of about `most` labelled documents. Document frequencies are those of the whole `corpus`.

    All terms of the examples are indexed; those that tell the labels apart weigh more. The votes of examples are calibrated by leaving each example
    out in turn. Labels are 0 or 1; null labels, keys and texts teach nothing. With one label only, the score is that
    label; without any it is one half.
    """
    marks = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("label")).filter("label in (0, 1)")
    counts = learning.class_counts(marks, "label")
    empty = np.zeros(0)
    nothing = Index(np.zeros(0, np.uint64), *[empty] * 8, float(next(iter(counts), 0.5)))
    if len(counts) < 2:
        return nothing
    chosen = learning.bounded_sample(marks, "label", counts, key="key", most=most)
    # The number of chosen keys is bounded by `most`, so they may be sent to every executor.
    sample = documents.select(F.col(key).alias("key"), F.col(text).alias("text")).filter(F.col("text").isNotNull()).join(F.broadcast(chosen), "key")
    # A text that was copied a thousand times is one example, else its words would look like signs of its label; it votes for its copies.
    sample = grams.mapped(sample, "text", ["key", "label", "text"], {"whole": "long"}, lambda t, _: (whole(t),))
    sample = sample.groupBy("label", "whole").agg(F.min("key").alias("key"), F.min_by("text", "key").alias("text"), F.count("*").alias("copies"))
    sample = sample.select("key", "label", "copies", "text").repartition(documents.sparkSession.sparkContext.defaultParallelism, "key")
    sample = stored(sample.withColumn("row", F.monotonically_increasing_id()), "toxicity-sample")
    if sample.select("label").distinct().count() < 2:
        return nothing
    vocabulary, with_term, toxic = _vocabulary(sample)
    if not len(vocabulary):
        vocabulary, with_term, toxic = np.zeros(0, np.uint64), empty, empty
    frequency, n = _frequencies(corpus, text, vocabulary)
    labels_ = sample.select("label").toPandas()["label"].to_numpy(np.int64)
    worth = (np.log((n + 1) / (frequency + 1.0)) + 1.0) * _extra(with_term, toxic, labels_)

    def weigh(texts: grams.Texts, _: pa.RecordBatch) -> tuple:
        of, term, count = vectors(texts, vocabulary)
        weight = (1.0 + np.log(count)) * worth[term]
        weight /= np.sqrt(np.bincount(of, weight**2, len(texts)))[of]
        cuts = np.searchsorted(of, np.arange(len(texts) + 1))
        lead, high = np.full(len(texts), len(vocabulary)), np.zeros(len(texts))
        first = np.lexsort((term, -weight, of))
        first = first[np.flatnonzero(np.diff(of[first], prepend=-1))]
        lead[of[first]], high[of[first]] = term[first], weight[first]
        parts = (pa.array([a[i:j].tobytes() for i, j in zip(cuts, cuts[1:])], pa.binary()) for a in (term.astype(np.int32), weight.astype(np.float32)))
        return pa.array(lead), pa.array(high), *parts

    # Examples with the same leading term are neighbours in the index. Terms get their numbers in the tasks: the driver gets eight bytes a posting.
    rows = grams.mapped(sample, "text", ["key", "label", "copies", "row"], {"lead": "long", "high": "double", "terms": "binary", "weights": "binary"}, weigh)
    rows = rows.orderBy("lead", F.desc("high"), "key", "label", "row").toArrow()
    keys, labels_, copies, place = (rows.column(c).to_numpy() for c in ("key", "label", "copies", "row"))
    labels_ = labels_.astype(np.int64)
    stands = {v: counts[v] / max(1, int(copies[labels_ == v].sum())) for v in (0, 1)}
    votes_of = copies * np.array([stands[v] for v in labels_])
    term, weight = _numbers(rows.column("terms"), np.int32), _numbers(rows.column("weights"), np.float32)
    example = np.repeat(np.arange(len(keys), dtype=np.int32), [len(b.as_buffer()) // 4 for b in rows.column("terms")])
    del rows
    ends = np.cumsum(np.bincount(term, minlength=len(vocabulary)))
    starts = np.column_stack([np.append(0, ends[:-1]), ends]) if len(ends) else np.zeros((0, 2), np.int64)
    order = np.argsort(term, kind="stable")
    del term
    example, weight = example[order], weight[order]
    del order
    size = starts[:, 1] - starts[:, 0]
    common = np.argsort(-size, kind="stable")[:COLUMNS]
    common = common[size[common] > len(keys) * FREQUENT]
    column = np.full(len(vocabulary), -1)
    column[common] = np.arange(len(common))
    index = Index(vocabulary, worth, keys, labels_, votes_of, starts, example, weight, column)

    shared = documents.sparkSession.sparkContext.broadcast(index)
    by_row = np.argsort(place)
    place = place[by_row]

    def leave_out(texts: grams.Texts, batch: pa.RecordBatch) -> tuple:
        index = shared.value
        of, term, count = vectors(texts, index.vocabulary)
        cuts = np.searchsorted(of, np.arange(len(texts) + 1))
        number = by_row[np.searchsorted(place, batch.column(0).to_numpy())]
        asked = [(term[i:j], index.unit(term[i:j], count[i:j]), int(own)) for i, j, own in zip(cuts, cuts[1:], number)]
        return pa.array(number), [index.vote(*found) if len(found[0]) else None for found in index.search(asked, NEIGHBOURS)]

    voted = grams.mapped(sample, "text", ["row"], {"number": "long", "vote": "double"}, leave_out).orderBy("number").toArrow()
    shared.destroy()
    vote = voted.column("vote").to_numpy()
    known = ~np.isnan(vote)
    prior = counts[1] / (counts[0] + counts[1])
    index.base = ((labels_ * votes_of)[~known].sum() + prior) / (votes_of[~known].sum() + 1.0)
    if known.any():
        index.knots = _isotonic(vote[known], labels_[known].astype(float), votes_of[known])
    return index


def predict(frame: DataFrame, index: Index, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds score (double, 0 to 1) and evidence (up to 3 nearest examples: doc_id, label, cosine).

    A text without any term of the index, as null and empty texts, has no neighbours and the share of toxic examples
    among such texts as its score. A text of any length is read whole; of equally near examples those with the lower number are taken. Rows that
    repeat get the same score each; an empty table gives an empty result. Columns of the two names are replaced.
    """
    keep = [c for c in (frame.columns if keep is None else keep) if c not in ("score", "evidence")]
    shared = frame.sparkSession.sparkContext.broadcast(index)  # about EXAMPLES examples at most, with all their terms

    def work(texts: grams.Texts, _: pa.RecordBatch) -> tuple:
        index = shared.value
        of, term, count = vectors(texts, index.vocabulary)
        cuts = np.searchsorted(of, np.arange(len(texts) + 1))
        asked, same, known = [], [], {}
        for i, j in zip(cuts, cuts[1:]):
            here = (term[i:j].tobytes(), count[i:j].tobytes())
            if here not in known:
                known[here] = len(asked)
                asked.append((term[i:j], index.unit(term[i:j], count[i:j]), -1))
            same.append(known[here])
        found = []
        for near, cosine in index.search(asked, NEIGHBOURS):
            score = index.calibrated(index.vote(near, cosine)) if len(near) else index.base
            found.append((score, [
                {"doc_id": int(index.keys[e]), "label": int(index.labels[e]), "cosine": float(min(c, 1.0))} for e, c in zip(near[:3], cosine[:3])
            ]))
        scores, evidence = [found[n][0] for n in same], [found[n][1] for n in same]
        return scores, evidence

    return grams.mapped(frame, text, keep, {"score": "double", "evidence": "array<struct<doc_id:long,label:int,cosine:double>>"}, work)
