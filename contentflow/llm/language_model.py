"""A hashed maximum-entropy language model with class-factored softmax.

A token is predicted in three steps: its class and then its member of the class by log-linear models of the words before
it, and the word among those of its group by its count. Frequent words are groups of their own; all others
share a group with the words that end alike. Class and member together are the group.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from contentflow.llm import grams
from contentflow.llm.folders import stored, unused

CLASSES, MEMBERS = 32, 32
GROUPS = CLASSES * MEMBERS
#: Groups of one word; group 0 is the end of a text. The others are dealt by a hash of a word's last bytes.
HEAD, ENDING = 768, 3
#: What stands before a text.
BEFORE = GROUPS
#: Hashed buckets of pairs of words before.
PAIRS = 4096
#: Counts of so many of the most frequent words are sent to every executor; the others are joined.
HOT_WORDS = 400_000
#: Rounds of training. Each takes its part of the texts, so that every text is used once.
ROUNDS, STEP_TOKENS, RATE = 2, 16_384, 0.25
#: Parameter vectors that one task averages.
FAN_IN = 32
#: Numbers per row of a parameter vector on its way.
CHUNK = 65_536

END = np.uint64(0xE4D0F7E875)
_SLOTS = 1 + 3 * (GROUPS + 1) + PAIRS
_MEMBER_ROWS = CLASSES * (GROUPS + 1) + CLASSES
SIZE = (_SLOTS + _MEMBER_ROWS) * 32


def _endings(texts: grams.Texts, found: grams.Words) -> np.ndarray:
    """The shared group of each word, by its last bytes."""
    code = np.zeros(len(found.begin), dtype=np.uint64)
    for j in range(1, ENDING + 1):
        at = np.maximum(found.end - j, found.begin)
        byte = grams.SPACED[texts.data[at]].astype(np.uint64)
        code = (code << np.uint64(8)) | np.where(found.end - j >= found.begin, byte, np.uint64(0))
    return (HEAD + grams.mix(code) % np.uint64(GROUPS - HEAD)).astype(np.int64)


def token_counts(texts_of: DataFrame, text: str = "text") -> DataFrame:
    """(h, ending, c): how often each token occurs in all texts, ends of texts included. Tasks add up before the shuffle."""

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def counted():
            hashes, endings = (np.concatenate(x) for x in zip(*held))
            found, first, count = np.unique(hashes, return_index=True, return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(endings[first].astype(np.int32)), pa.array(count)], names=["h", "ending", "c"])

        ends = 0
        for batch in batches:
            ends += batch.num_rows
            for piece in grams.pieces(batch.column(0)):
                found = grams.words(piece, grams.SPACED)
                held.append((found.hashes, _endings(piece, found)))
                if sum(len(h) for h, _ in held) > 6_000_000:
                    yield counted()
        if ends:
            held.append((np.array([END]), np.zeros(1, np.int64)))
            last = counted()
            count = last.column(2).to_numpy().copy()
            count[last.column(0).to_numpy() == END.astype(np.int64)] = ends
            yield pa.RecordBatch.from_arrays([last.column(0), last.column(1), pa.array(count)], names=["h", "ending", "c"])

    rows = texts_of.select(F.col(text).cast("string")).mapInArrow(run, "h long, ending int, c long")
    return rows.groupBy("h", "ending").agg(F.sum("c").alias("c"))


@dataclass
class Vocabulary:
    """Sorted hashes of the most frequent words with counts and groups (-1: by ending), and totals over all tokens.

    `shared` is, for each group of several words, the sum of their counts and their number.
    """

    hashes: np.ndarray
    counts: np.ndarray
    head: np.ndarray
    shared: np.ndarray
    tokens: int
    words: int

    def heads_only(self) -> Vocabulary:
        own = self.head >= 0
        return Vocabulary(self.hashes[own], self.counts[own], self.head[own], self.shared, self.tokens, self.words)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Place of each hash, -1 for others."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        at = np.searchsorted(self.hashes, hashes).clip(max=len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at, -1)


def vocabulary(counts: DataFrame, hot: int = HOT_WORDS) -> Vocabulary:
    """The `hot` most frequent tokens of a table of token counts, and its totals."""
    end = int(END)
    tokens, words = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    # The lowest count from which on no more than `hot` tokens are left: how many tokens have which count is a short table.
    sizes = counts.groupBy("c").agg(F.count("*").alias("n")).toPandas().sort_values("c", ascending=False)
    enough = sizes[sizes["n"].cumsum() <= hot]["c"]
    least = int(enough.min()) if len(enough) else None
    top = counts.filter(F.col("c") >= least).select("h", "c").toPandas() if least is not None else None
    hashes, count = (top[c].to_numpy(np.int64) for c in ("h", "c")) if top is not None else (np.zeros(0, np.int64),) * 2
    ranked = np.array([r.h for r in counts.filter(F.col("h") != end).orderBy(F.desc("c"), "h").limit(HEAD - 1).collect()], np.int64)
    # Words of a group of their own and the end are always known, with their counts.
    own = np.append(ranked, end)
    missing = own[~np.isin(own, hashes)]
    if len(missing):
        known = {r.h: r.c for r in counts.filter(F.col("h").isin(missing.tolist())).select("h", "c").collect()}
        hashes, count = np.append(hashes, missing), np.append(count, [known.get(h, 0) for h in missing.tolist()])
    order = np.argsort(hashes.view(np.uint64), kind="stable")
    hashes, count = hashes.view(np.uint64)[order], count[order]
    head = np.full(len(hashes), -1, np.int64)
    head[np.searchsorted(hashes, ranked.view(np.uint64))] = np.arange(1, len(ranked) + 1)
    head[np.searchsorted(hashes, END)] = 0
    sums = np.zeros((GROUPS, 2))
    tail = counts.filter(~F.col("h").isin(own.tolist()))
    for row in tail.groupBy("ending").agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect():
        sums[row.ending] = row.c, row.n
    return Vocabulary(hashes, count, head, sums, int(tokens), int(words))


@dataclass
class Tokens:
    """Tokens of a piece: group, groups of the three before, text number, and which tokens are words."""

    group: np.ndarray
    before: list[np.ndarray]
    text: np.ndarray
    words: np.ndarray


def tokens(texts: grams.Texts, found: grams.Words, group: np.ndarray) -> Tokens:
    n = len(texts)
    words = np.arange(len(found.hashes)) + found.text
    out = np.zeros(len(found.hashes) + n, dtype=np.int64)
    out[words] = group
    text = np.repeat(np.arange(n), found.counts + 1)
    place = np.arange(len(out)) - (found.ends - found.counts + np.arange(n))[text]
    padded = np.concatenate([np.full(3, BEFORE), out])
    before = [np.where(place >= k, padded[3 - k : 3 - k + len(out)], BEFORE) for k in (1, 2, 3)]
    return Tokens(out, before, text, words)


def groups(vocabulary: Vocabulary, texts: grams.Texts, found: grams.Words, place: np.ndarray) -> np.ndarray:
    head = vocabulary.head[place]
    return np.where((place >= 0) & (head >= 0), head, _endings(texts, found))


class MaxEnt:
    """The parameters of classes and members, and steps on them."""

    def __init__(self, flat: np.ndarray | None = None) -> None:
        flat = np.zeros(SIZE, np.float32) if flat is None else flat.astype(np.float32)
        self.flat = flat
        self.classes = flat[: _SLOTS * 32].reshape(_SLOTS, 32)
        self.members = flat[_SLOTS * 32 :].reshape(_MEMBER_ROWS, 32)

    @staticmethod
    def features(t: Tokens, part: slice) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Rows of the class table: word before, skipped words before, and the last pair; rows of the member table."""
        one, two, three = (b[part] for b in t.before)
        pair = (one * (GROUPS + 1) + two).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        width = GROUPS + 1
        rows = [1 + one, 1 + width + two, 1 + 2 * width + three, 1 + 3 * width + (pair >> np.uint64(52)).astype(np.int64) % PAIRS]
        class_ = t.group[part] // MEMBERS
        return rows, [class_ * width + one, CLASSES * width + class_]

    @staticmethod
    def _softmax(z: np.ndarray) -> np.ndarray:
        z -= z.max(axis=1, keepdims=True)
        np.exp(z, out=z)
        z /= z.sum(axis=1, keepdims=True)
        return z

    def forward(self, t: Tokens, part: slice):
        rows, member_rows = self.features(t, part)
        z = self.classes[rows[0]]
        for r in rows[1:]:
            z += self.classes[r]
        z += self.classes[0]
        y = self.members[member_rows[0]]
        y += self.members[member_rows[1]]
        return rows, member_rows, self._softmax(z), self._softmax(y)

    def log10(self, t: Tokens) -> np.ndarray:
        """log10 of each token's class and member probability."""
        out = np.empty(len(t.group))
        for first in range(0, len(out), STEP_TOKENS):
            part = slice(first, first + STEP_TOKENS)
            _, _, p, q = self.forward(t, part)
            g, i = t.group[part], np.arange(len(p))
            out[part] = np.log10(np.maximum(p[i, g // MEMBERS], 1e-30)) + np.log10(np.maximum(q[i, g % MEMBERS], 1e-30))
        return out

    def learn(self, t: Tokens, squares: np.ndarray) -> None:
        """Gradient steps over the tokens; `squares` holds the sums of squared gradients that scale the steps."""
        class_squares = squares[: _SLOTS * 32].reshape(_SLOTS, 32)
        member_squares = squares[_SLOTS * 32 :].reshape(_MEMBER_ROWS, 32)
        for first in range(0, len(t.group), STEP_TOKENS):
            part = slice(first, first + STEP_TOKENS)
            rows, member_rows, p, q = self.forward(t, part)
            g, i = t.group[part], np.arange(len(p))
            p[i, g // MEMBERS] -= 1.0
            q[i, g % MEMBERS] -= 1.0
            for table, sums, keys, slope in (
                *((self.classes, class_squares, r, p) for r in rows),
                *((self.members, member_squares, r, q) for r in member_rows),
            ):
                order = np.argsort(keys.astype(np.uint16), kind="stable")
                sorted_ = keys[order]
                cuts = np.flatnonzero(np.diff(sorted_, prepend=-1))
                self._step(table, sums, sorted_[cuts], np.add.reduceat(slope[order], cuts, axis=0))
            self._step(self.classes, class_squares, np.zeros(1, np.int64), p.sum(axis=0, keepdims=True))

    @staticmethod
    def _step(table: np.ndarray, squares: np.ndarray, rows: np.ndarray, slope: np.ndarray) -> None:
        squares[rows] += slope * slope
        table[rows] -= RATE * slope / np.sqrt(squares[rows] + 1e-6)


def _averaged(parts: DataFrame) -> np.ndarray:
    """The mean of the tasks' parameters, weighted by their tokens: FAN_IN of them at a time, chunk by chunk."""
    parts = stored(parts, "parameters")
    n = parts.select("task").distinct().count()
    if not n:
        return np.zeros(SIZE, np.float32)

    def mean(rows: pa.Table) -> pa.Table:
        weight = rows["weight"].to_numpy().astype(float)
        total = sum(w * np.frombuffer(v.as_buffer(), np.float16).astype(np.float32) for w, v in zip(weight, rows["values"]))
        values = (total / weight.sum()).astype(np.float16).tobytes()
        return pa.table({"task": rows["team"].slice(0, 1), "chunk": rows["chunk"].slice(0, 1), "weight": [weight.sum()], "values": pa.array([values], pa.binary())})

    while True:
        n = -(-n // FAN_IN)
        team = F.pmod(F.xxhash64("task"), F.lit(n)).cast("long")
        parts = parts.withColumn("team", team).groupBy("team", "chunk").applyInArrow(mean, "task long, chunk int, weight double, values binary")
        if n == 1:
            rows = parts.orderBy("chunk").collect()
            return np.concatenate([np.frombuffer(r["values"], np.float16) for r in rows]).astype(np.float32)
        parts = stored(parts, "parameters")


def train(texts_of: DataFrame, known: Vocabulary, text: str = "text", key: str = "doc_id") -> MaxEnt:
    """Distributed gradient updates over all texts.

    In each round every task starts from the common parameters, takes gradient steps through its texts, and the
    weighted mean of what the tasks have reached is the next start. What a task sends is as large as the model.
    """
    context = texts_of.sparkSession.sparkContext
    model = MaxEnt()
    heads = known.heads_only()
    part = F.pmod(F.xxhash64(F.lit(31), key, text), F.lit(ROUNDS))
    for turn in range(ROUNDS):
        start = context.broadcast((heads, model.flat))

        def run(batches, start=start):
            heads, flat = start.value
            own, squares, seen, first = MaxEnt(flat.copy()), np.zeros(SIZE, np.float32), 0, None
            for batch in batches:
                for piece in grams.pieces(batch.column(1)):
                    found = grams.words(piece, grams.SPACED)
                    t = tokens(piece, found, groups(heads, piece, found, heads.find(found.hashes)))
                    own.learn(t, squares)
                    seen += len(t.group)
                first = batch.column(0)[0].as_py() if first is None else first
            if seen:
                chunks = [own.flat[i : i + CHUNK].astype(np.float16).tobytes() for i in range(0, SIZE, CHUNK)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([first] * len(chunks), pa.int64()), pa.array(range(len(chunks)), pa.int32()), pa.array([float(seen)] * len(chunks)), pa.array(chunks, pa.binary())],
                    names=["task", "chunk", "weight", "values"],
                )

        rows = texts_of.filter(part == turn).select(F.xxhash64(key, text), F.col(text).cast("string"))
        parts = rows.mapInArrow(run, "task long, chunk int, weight double, values binary")
        model = MaxEnt(_averaged(parts))
    return model


def score(
    frame: DataFrame, training: Column, text: str = "text", key: str = "doc_id", keep: list[str] | None = None, hot: int = HOT_WORDS,
) -> DataFrame:
    """Adds n_tokens, n_known, train_tokens (long), base_score and score (double).

    Learns from the rows for which `training` holds and scores all. Words are runs of anything but white space, A-Z
    in lower case; every text has one end token more. base_score is the add-one unigram log10 probability, with counts of
    all training tokens; n_known tokens occur among them. score is the model's log10 probability of the text.
    The words of a group share its probability by their counts plus one, and one part is left for words never seen.

    Counts of the most frequent words go to every executor, at most `hot`; the others of each text are joined
    with the table of counts. Null texts are empty. Rows that repeat are counted and scored each. A text of any length is scored whole, its
    words in pieces of bounded size. Without training rows all counts are 0; an empty table gives an empty result. Added columns are replaced.
    """
    new = ("n_tokens", "n_known", "train_tokens", "base_score", "score")
    keep = [c for c in (frame.columns if keep is None else keep) if c not in new]
    taught = frame.filter(F.coalesce(training, F.lit(False)))
    counts = stored(token_counts(taught, text), "token-counts")
    known = vocabulary(counts, hot)
    model = train(taught, known, text, key)
    shared = frame.sparkSession.sparkContext.broadcast((known, model.flat))

    def work(texts: grams.Texts, _: pa.RecordBatch) -> tuple:
        known, flat = shared.value
        n = len(texts)
        found = grams.words(texts, grams.SPACED)
        place = known.find(found.hashes)
        group = groups(known, texts, found, place)
        t = tokens(texts, found, group)
        model_sum = np.bincount(t.text, MaxEnt(flat).log10(t), n)
        # A word in a shared group: its count among the group's. Words of a group of their own have it all.
        common = group >= HEAD
        total = np.log10(known.shared.sum(axis=1) + 1.0)
        count = np.log10(np.where(place >= 0, known.counts[place], 0) + 1.0)
        model_sum += np.bincount(found.text[common], (count - total[group])[common], n)
        end = known.counts[known.find(np.array([END]))][0]
        base = np.bincount(found.text, count, n) + np.log10(end + 1.0) - (found.counts + 1) * np.log10(known.tokens + known.words + 1.0)
        seen = np.bincount(found.text[place >= 0], minlength=n) + (end > 0)
        of, rare, times = grams.distinct_by_text(found.text[place < 0], found.hashes[place < 0])
        cuts = np.searchsorted(of, np.arange(n + 1)).astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(cuts), pa.array(x)) for x in (rare.view(np.int64), times)]
        return found.counts + 1, seen, base, model_sum, *lists

    names = dict(zip(("n_tokens", "seen", "base", "model", "rare", "times", "row"), (unused(frame, f"the_{x}") for x in ("n_tokens", "seen", "base", "model", "rare", "times", "row"))))
    types = {"n_tokens": "long", "seen": "long", "base": "double", "model": "double", "rare": "array<long>", "times": "array<long>"}
    rows = grams.mapped(frame, text, keep, {names[k]: t for k, t in types.items()}, work)
    # Written once, so that a row's number is the same on both sides of the join.
    rows = stored(rows.withColumn(names["row"], F.monotonically_increasing_id()), "scored-rows")
    rare = rows.select(F.col(names["row"]).alias("row"), F.explode(F.arrays_zip(F.col(names["rare"]).alias("h"), F.col(names["times"]).alias("n"))).alias("x")).select("row", "x.h", "x.n")
    sums = rare.join(counts.select("h", "c"), "h").groupBy("row").agg(F.sum(F.col("n") * F.log10(F.col("c") + 1.0)).alias("more"), F.sum("n").alias("also"))
    more, also, row = (unused(rows, x) for x in ("more", "also", "its_row"))
    done = rows.join(sums.select(F.col("row").alias(row), F.col("more").alias(more), F.col("also").alias(also)), F.col(names["row"]) == F.col(row), "left")
    return done.select(
        *keep, F.col(names["n_tokens"]).alias("n_tokens"), (F.col(names["seen"]) + F.coalesce(also, F.lit(0))).alias("n_known"),
        F.lit(known.tokens).cast("long").alias("train_tokens"), (F.col(names["base"]) + F.coalesce(more, F.lit(0.0))).alias("base_score"),
        (F.col(names["model"]) + F.coalesce(more, F.lit(0.0))).alias("score"),
    )
