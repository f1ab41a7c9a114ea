"""Words, shingles and byte n-grams of whole Arrow batches as numpy arrays.

A batch's texts stay in one buffer of UTF-8 bytes; nothing becomes a Python string. Batches are worked on in
pieces of bounded size, so that the memory of a task does not follow the length of its texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from contentflow.llm.folders import unused

PIECE_BYTES = 2_000_000
PIECE_ROWS = 512

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Byte -> lower-cased byte, 0 for separators. Words are runs of bytes that are not 0.
SPACED = _LOWER.copy()
SPACED[[9, 10, 11, 12, 13, 32]] = 0
ALNUM = _LOWER.copy()
ALNUM[:48], ALNUM[58:65], ALNUM[91:97], ALNUM[123:128] = 0, 0, 0, 0

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, by position in a piece."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 2 * PIECE_BYTES)
        _powers[:] = []
        for base in (_BASE, _INVERSE):
            table = np.full(size, np.uint64(base), dtype=np.uint64)
            table[0] = 1
            _powers.append(np.multiply.accumulate(table))
    return _powers[0], _powers[1]


class Texts(NamedTuple):
    """Texts `first` to `last` of a batch: their bytes, and where each begins in these."""

    first: int
    last: int
    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return self.last - self.first


def pieces(texts: pa.Array, limit: int = PIECE_BYTES, rows: int = PIECE_ROWS) -> Iterator[Texts]:
    """Runs of at most `rows` texts and `limit` bytes, or one text; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    buffer = texts.buffers()[2]
    data = np.frombuffer(buffer, dtype=np.uint8) if buffer else np.zeros(0, dtype=np.uint8)
    first = 0
    while first < len(texts):
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), first + rows, len(texts))
        yield Texts(first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
        first = last


class Words(NamedTuple):
    """Words of the texts of a piece, in order: hash, text number, byte span; `ends[i]` is past the last word of text i."""

    hashes: np.ndarray
    text: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    ends: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.ends, prepend=0)


def words(texts: Texts, table: np.ndarray) -> Words:
    n = len(texts.data)
    low = table[texts.data]
    inside = np.zeros(n + 1, dtype=bool)
    inside[:n] = low != 0
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    closes = ~inside
    closes[0] = False
    closes[1:] &= inside[:-1]
    # A text's first byte begins a word even if the text before ends in one.
    edges = texts.offsets[1:-1]
    edges = edges[(edges > 0) & (edges < n)]
    joined = edges[inside[edges] & inside[edges - 1]]
    opens[joined], closes[joined] = True, True
    begin, end = np.flatnonzero(opens), np.flatnonzero(closes)
    power, inverse = _power_tables(n + 1)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * power[:n], out=total[1:])
    hashes = mix((total[end] - total[begin]) * inverse[begin] + (end - begin).astype(np.uint64))
    ends = np.searchsorted(begin, texts.offsets[1:], side="left")
    text = np.repeat(np.arange(len(texts)), np.diff(ends, prepend=0))
    return Words(hashes, text, begin, end, ends)


def shingles(found: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k consecutive words of one text, and the numbers of their first words."""
    n = len(found.hashes)
    if n < k:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    starts = np.flatnonzero(found.text[: n - k + 1] == found.text[k - 1 :])
    return chain([found.hashes[starts + j] for j in range(k)]), starts


def chain(columns: list[np.ndarray]) -> np.ndarray:
    """One hash of several, in their order."""
    out = np.full(len(columns[0]), np.uint64(len(columns)), dtype=np.uint64)
    for column in columns:
        out = mix(out * np.uint64(_BASE) + column)
    return out


def distinct_by_text(text: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, hash) pairs, sorted, with their counts. `text` is not decreasing."""
    if not len(hashes):
        return text, hashes, np.zeros(0, dtype=np.int64)
    order = np.argsort(hashes)
    # Numbers of 16 bits are sorted by their digits, in linear time.
    small = text[order].astype(np.uint16) if text[-1] < 1 << 16 else text[order]
    order = order[np.argsort(small, kind="stable")]
    text, hashes = text[order], hashes[order]
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    return text[at], hashes[at], np.diff(at, append=len(hashes))


def byte_grams(texts: Texts, table: np.ndarray, buckets: int, sizes: tuple[int, ...]) -> np.ndarray:
    """(texts, buckets) counts of hashed n-grams of the mapped bytes, none across two texts. buckets is a power of 2."""
    low, n = table[texts.data].astype(np.uint32), len(texts.data)
    text = np.repeat(np.arange(len(texts), dtype=np.int64), np.diff(texts.offsets))
    out = np.zeros(len(texts) * buckets, dtype=np.float64)
    for size in sizes:
        if n < size:
            continue
        code = low[: n - size + 1].copy()
        for j in range(1, size):
            code = (code << np.uint32(8)) | low[j : n - size + 1 + j]
        code = (code + np.uint32(size)) * np.uint32(2654435761)
        code ^= code >> np.uint32(15)
        inside = text[: n - size + 1] == text[size - 1 :]
        at = text[: n - size + 1] * buckets + (code & np.uint32(buckets - 1))
        out += np.bincount(at[inside], minlength=len(out))
    return out.reshape(len(texts), buckets)


def mapped(
    frame: DataFrame, text: str, keep: list[str], new: dict[str, str], work: Callable[[Texts, pa.RecordBatch], tuple],
) -> DataFrame:
    """The columns `keep` and, from `work` on each piece of each batch's texts, the columns `new` (name -> Spark type).

    `work` gets a piece and its rows and returns one array per new column.
    """
    alias = unused(frame, "the_text")
    kept = [F.col(f"`{c}`") for c in keep]
    types = T.StructType([*frame.select(*kept).schema.fields, *T._parse_datatype_string(", ".join(f"`{n}` {t}" for n, t in new.items())).fields])
    arrow = to_arrow_schema(types)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            for piece in pieces(texts):
                rows = batch.slice(piece.first, len(piece))
                made = work(piece, rows)
                arrays = [rows.column(i) for i in range(len(keep))]
                for array, field in zip(made, list(arrow)[len(keep) :], strict=True):
                    arrays.append(array.cast(field.type) if isinstance(array, (pa.Array, pa.ChunkedArray)) else pa.array(array, type=field.type))
                yield pa.RecordBatch.from_arrays(arrays, names=types.names)

    return frame.select(*kept, F.col(f"`{text}`").cast("string").alias(alias)).mapInArrow(run, types)
