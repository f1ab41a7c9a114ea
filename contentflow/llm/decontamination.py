"""Benchmark decontamination by a prefix-filtered join of word windows."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from contentflow.llm import grams
from contentflow.llm.folders import stored, unused

#: Words of a window. An item of fewer words is one window.
WINDOW = 10
#: Words of a shingle, the token by which windows are joined; shorter windows are their own shingle.
SHINGLE = 3
#: Windows that are sent to every executor at once; more are joined in several passes over the texts.
BLOCK_WINDOWS = 200_000


@dataclass
class Windows:
    """A bounded block of distinct windows of one length, and the items that each belongs to.

    `words` has a row of word hashes per window. Every occurrence of a window holds all its shingles, so the one that is
    rarest in the corpus is a necessary prefix: `token` is its hash, `shift` its place in the window. Windows are
    ordered by token.
    """

    words: np.ndarray
    token: np.ndarray
    shift: np.ndarray
    items: list[list[str]]

    @property
    def shingle(self) -> int:
        return min(SHINGLE, self.words.shape[1])

    @cached_property
    def bits(self) -> np.ndarray:
        return _bits(self.token)


def item_windows(benchmark: DataFrame, text: str = "text", key: str = "item_id", window: int = WINDOW) -> DataFrame:
    """(window: binary word hashes, items: sorted ids) for each distinct window of the items' words."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for piece in grams.pieces(batch.column(1)):
                found = grams.words(piece, grams.ALNUM)
                rows, owner = [], []
                for t, (last, count) in enumerate(zip(found.ends, found.counts)):
                    own = found.hashes[last - count : last]
                    width = min(window, count)
                    cuts = [own[i : i + width].tobytes() for i in range(count - width + 1)] if count else []
                    rows += cuts
                    owner += [piece.first + t] * len(cuts)
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), ids.take(pa.array(owner, pa.int64()))], names=["window", "item"])

    cut = benchmark.select(F.col(key).cast("string").alias("item"), F.col(text).cast("string").alias("text")).mapInArrow(run, "window binary, item string")
    return cut.groupBy("window").agg(F.sort_array(F.collect_set("item")).alias("items"))


def _tokens(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all shingles of each window, by place."""
    width = words.shape[1]
    return np.column_stack([grams.chain([words[:, i + j] for j in range(size)]) for i in range(width - size + 1)])


def _find(sorted_values: np.ndarray, filter_bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Places in `values` that occur in `sorted_values`; a bit table drops nearly all others first."""
    at = np.flatnonzero(filter_bits[(values >> np.uint64(42)).astype(np.int64)])
    place = np.searchsorted(sorted_values, values[at]).clip(max=len(sorted_values) - 1)
    return at[sorted_values[place] == values[at]]


def _bits(values: np.ndarray) -> np.ndarray:
    bits = np.zeros(1 << 22, dtype=bool)
    bits[(values >> np.uint64(42)).astype(np.int64)] = True
    return bits


def _frequencies(documents: DataFrame, text: str, tokens: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """How often each shingle of the block occurs in all documents, by shingle length."""
    shared = documents.sparkSession.sparkContext.broadcast(tokens)

    def run(batches):
        tokens = shared.value
        bits = {size: _bits(values) for size, values in tokens.items()}
        total = {size: np.zeros(len(values), np.int64) for size, values in tokens.items()}
        for batch in batches:
            for piece in grams.pieces(batch.column(0)):
                found = grams.words(piece, grams.ALNUM)
                for size, values in tokens.items():
                    seen = grams.shingles(found, size)[0]
                    hit = np.searchsorted(values, seen[_find(values, bits[size], seen)])
                    total[size] += np.bincount(hit, minlength=len(values))
        for size, counts in total.items():
            used = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), size)), pa.array(used), pa.array(counts[used])], names=["size", "token", "n"])

    got = documents.select(F.col(text).cast("string")).mapInArrow(run, "size long, token long, n long")
    got = got.groupBy("size", "token").agg(F.sum("n").alias("n")).toPandas()
    counts = {size: np.zeros(len(values), np.int64) for size, values in tokens.items()}
    for size, part in got.groupby("size"):
        counts[size][part["token"].to_numpy()] = part["n"].to_numpy()
    return counts


def _with_prefixes(rows: list, documents: DataFrame, text: str) -> list[Windows]:
    """The block's windows by length, each joined by its rarest shingle."""
    by_width: dict[int, list] = {}
    for row in rows:
        by_width.setdefault(len(row.window) // 8, []).append(row)
    words = {w: np.frombuffer(b"".join(r.window for r in part), dtype=np.uint64).reshape(-1, w) for w, part in by_width.items()}
    places = {w: _tokens(words[w], min(SHINGLE, w)) for w in words}
    tokens = {
        size: np.unique(np.concatenate([places[w].ravel() for w in words if min(SHINGLE, w) == size])) for size in {min(SHINGLE, w) for w in words}
    }
    counts = _frequencies(documents, text, tokens)
    out = []
    for width, part in by_width.items():
        size = min(SHINGLE, width)
        shift = counts[size][np.searchsorted(tokens[size], places[width])].argmin(axis=1)
        token = places[width][np.arange(len(part)), shift]
        order = np.argsort(token, kind="stable")
        out.append(Windows(words[width][order], token[order], shift[order], [list(part[i]["items"]) for i in order]))
    return out


def _occurrences(found: grams.Words, windows: Windows) -> tuple[np.ndarray, np.ndarray]:
    """(first word, window) of every occurrence of the windows in a piece."""
    width = windows.words.shape[1]
    seen, starts = grams.shingles(found, windows.shingle)
    hit = _find(windows.token, windows.bits, seen)
    low, high = np.searchsorted(windows.token, seen[hit], "left"), np.searchsorted(windows.token, seen[hit], "right")
    times = high - low
    at = np.repeat(starts[hit], times)
    window = np.repeat(low - np.cumsum(times) + times, times) + np.arange(times.sum())
    first = at - windows.shift[window]
    # By its place in the window the shingle says where the window would lie: inside one text or nowhere.
    inside = (first >= 0) & (first + width <= len(found.hashes))
    first, window, at = first[inside], window[inside], at[inside]
    whole = (found.text[first] == found.text[at]) & (found.text[first + width - 1] == found.text[at])
    first, window = first[whole], window[whole]
    for j in range(width):
        same = found.hashes[first + j] == windows.words[window, j]
        first, window = first[same], window[same]
    return first, window


def decontaminate(
    documents: DataFrame, benchmark: DataFrame, text: str = "text", item_text: str = "text", item: str = "item_id",
    keep: list[str] | None = None, window: int = WINDOW, block_windows: int = BLOCK_WINDOWS,
) -> DataFrame:
    """Adds n_words, n_hit (long), hits (array of first and past-last word of covered stretches) and items (sorted ids).

    A window is `window` consecutive words of an item, or all words of a shorter one. A word of a document is hit if it
    lies in an occurrence of a window. Windows and documents meet by each window's rarest shingle; place and
    length drop what cannot fit, and the words of what is left are compared one by one.

    Benchmarks of more than `block_windows` distinct windows are joined in blocks, one pass over the documents for each, so
    what is sent to the executors is bounded. Null and empty texts have no words; items without words have no
    windows; items with a null id hit words but are not listed. Rows that repeat are searched each, and so is a text of any length, whole. An empty
    table on either side hits nothing. Columns of the added names are replaced.
    """
    new = {"n_words": "long", "n_hit": "long", "hits": "array<struct<first:long,end:long>>", "items": "array<string>"}
    keep = [c for c in (documents.columns if keep is None else keep) if c not in new]
    cut = stored(item_windows(benchmark, item_text, item, window), "benchmark-windows")
    blocks = max(1, -(-cut.count() // block_windows))
    frame = documents.drop(*new)
    hits_before, items_before = unused(frame, "hits_before"), unused(frame, "items_before")
    for block in range(blocks):
        rows = cut.filter(F.pmod(F.xxhash64("window"), F.lit(blocks)) == block).orderBy("window").collect()
        prepared = _with_prefixes(rows, documents, text) if rows else []
        shared = documents.sparkSession.sparkContext.broadcast(prepared)
        later = block > 0

        def work(texts: grams.Texts, batch: pa.RecordBatch, shared=shared, later=later) -> tuple:
            found = grams.words(texts, grams.ALNUM)
            count = found.counts
            cover = np.zeros(len(found.hashes) + 1, dtype=np.int64)
            items: list[set] = [set() for _ in range(len(texts))]
            if later:
                # What the blocks before have found.
                for t, (spans, ids) in enumerate(zip(batch.column(hits_before).to_pylist(), batch.column(items_before).to_pylist())):
                    items[t].update(ids)
                    for span in spans:
                        cover[found.ends[t] - count[t] + span["first"]] += 1
                        cover[found.ends[t] - count[t] + span["end"]] -= 1
            for windows in shared.value:
                first, window = _occurrences(found, windows)
                np.add.at(cover, first, 1)
                np.add.at(cover, first + windows.words.shape[1], -1)
                for t, w in zip(found.text[first].tolist(), window.tolist()):
                    items[t].update(i for i in windows.items[w] if i is not None)
            hit = np.cumsum(cover)[:-1] > 0
            hits = [[] for _ in range(len(texts))]
            for t in np.unique(found.text[hit]):
                begin = found.ends[t] - count[t]
                edges = np.flatnonzero(np.diff(hit[begin : found.ends[t]].astype(np.int8), prepend=0, append=0))
                hits[t] = [{"first": int(a), "end": int(b)} for a, b in zip(edges[::2], edges[1::2])]
            return count, np.bincount(found.text[hit], minlength=len(texts)), hits, [sorted(i) for i in items]

        # Between blocks, the texts and what was found so far are a written table.
        last = block == blocks - 1
        columns = keep if last else [*keep, *([text] if text not in keep else [])]
        if later:
            frame = frame.drop("n_words", "n_hit").withColumnsRenamed({"hits": hits_before, "items": items_before})
        frame = grams.mapped(frame, text, [*columns, *([hits_before, items_before] if later else [])], new, work).drop(hits_before, items_before)
        if not last:
            frame = stored(frame, "decontamination")
    return frame
