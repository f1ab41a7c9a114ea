"""Arrow batches as numpy arrays, next to plain Python."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from contentflow.llm import grams
import llm_plain as plain

TEXTS = ["Ab c", None, "", "d", "  é x\ty\n", "ab C", "\x0bq\x0c", "a" * 3000, "İ Ä"]


def all_pieces(texts, **limits):
    return list(grams.pieces(pa.array(texts, pa.string()), **limits))


def test_words_are_those_of_the_pattern_and_never_cross_texts():
    for table, pattern in ((grams.SPACED, plain.SPACE_WORD), (grams.ALNUM, plain.ALNUM_WORD)):
        for limit in (1, 10, 10**6):
            seen = {}
            for piece in all_pieces(TEXTS, limit=limit):
                found = grams.words(piece, table)
                for t in range(len(piece)):
                    own = found.hashes[found.text == t].tolist()
                    words = pattern.findall(plain.low(TEXTS[piece.first + t]))
                    assert len(own) == len(words) == found.counts[t]
                    for h, w in zip(own, words):
                        assert seen.setdefault(w, h) == h
            assert len(set(seen.values())) == len(seen)


def test_pieces_cover_all_texts_in_order_also_of_a_sliced_array():
    array = pa.array(["x", *TEXTS, "y"], pa.string()).slice(1, len(TEXTS))
    covered = [i for p in grams.pieces(array, limit=5, rows=2) for i in range(p.first, p.last)]
    assert covered == list(range(len(TEXTS)))
    assert not list(grams.pieces(pa.array([], pa.string())))


def test_shingles_and_distinct_pairs():
    piece = all_pieces(["a b a b a", "a b", "c"])[0]
    found = grams.words(piece, grams.SPACED)
    hashes, first = grams.shingles(found, 2)
    assert found.text[first].tolist() == [0, 0, 0, 0, 1]
    assert len(set(hashes.tolist())) == 2 and hashes[0] == hashes[2] == hashes[4]
    text, distinct, counts = grams.distinct_by_text(found.text[first], hashes)
    assert text.tolist() == [0, 0, 1] and sorted(counts.tolist()[:2]) == [2, 2] and counts[2] == 1


def test_byte_grams_count_every_gram_once():
    rng = random.Random(3)
    texts = ["".join(rng.choice("abc é") for _ in range(rng.randrange(12))) for _ in range(40)]
    counts = grams.byte_grams(all_pieces(texts)[0], grams._LOWER, 64, (1, 2, 3))
    for text, row in zip(texts, counts):
        size = len(text.encode())
        assert row.sum() == sum(max(0, size - k + 1) for k in (1, 2, 3))
    again = grams.byte_grams(all_pieces(texts[:1] * 2)[0], grams._LOWER, 64, (1, 2, 3))
    assert np.array_equal(again[0], counts[0]) and np.array_equal(again[1], counts[0])


def test_mapped_keeps_rows_types_and_clashing_names(spark):
    frame = spark.createDataFrame([(1, "a b", None), (None, None, "x")], "id long, text string, the_text string")
    out = grams.mapped(frame, "text", ["id", "the_text"], {"n": "long"}, lambda t, _: (grams.words(t, grams.SPACED).counts,))
    assert out.dtypes == [("id", "bigint"), ("the_text", "string"), ("n", "bigint")]
    assert {tuple(r) for r in out.collect()} == {(1, None, 2), (None, "x", 0)}
    assert grams.mapped(frame.filter(F.lit(False)), "text", ["id"], {"n": "long"}, lambda t, _: (t,)).count() == 0
