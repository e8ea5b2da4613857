"""Nearest words by pieces against all pairs."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from subvox.operators import lexicon as lx


def edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute(codes, entries):
    out = {}
    for code in {c for c in codes if c is not None}:
        near = [(edits(code, c), rank, word) for word, c, rank in entries if c is not None]
        if near and (code or min(near)[0] == 0):
            out[code] = min(near)[::2]
    return out


def drawn(rng, n, letters, longest):
    return ["".join(rng.choices(letters, k=rng.randint(0, longest))) for _ in range(n)]


@pytest.mark.parametrize(("letters", "longest", "first"), [("ab", 9, 1), ("abcdé😀", 14, 1), ("abcdefghijklmnop", 24, 2), ("abc", 6, None)])
def test_nearest_words(spark, letters, longest, first):
    rng = random.Random(longest)
    entries = [(f"w{i}", c, i) for i, c in enumerate(drawn(rng, 120, letters, longest))] + [("none", None, 500), ("again", "abab", 501)]
    codes = drawn(rng, 60, letters, longest + 4) + ["zzzz", "z" * 40, "y", entries[3][1], None, ""] * 2
    # Words with a few errors, so that several rounds settle something.
    for _, c, _ in entries[:40]:
        code = list(c)
        for _ in range(rng.randint(1, 4)):
            code.insert(rng.randint(0, len(code)), rng.choice(letters))
        codes.append("".join(code))
    hyps = spark.createDataFrame([(c, 1) for c in codes], "code string, word int")
    got = lx.nearest_words(hyps, spark.createDataFrame(entries, "word string, code string, rank int"), first).collect()
    assert len(got) == len({r.code for r in got})
    assert {r.code: (r.distance, r.word) for r in got} == brute(codes, entries)


def test_nearest_words_of_empty_tables(spark):
    hyps, lexicon = spark.createDataFrame([("ab",)], "code string"), spark.createDataFrame([("w", "abc", 0)], "word string, code string, rank int")
    assert lx.nearest_words(hyps, lexicon.limit(0)).count() == 0
    assert lx.nearest_words(hyps.limit(0), lexicon).count() == 0


def test_a_word_meets_few_strings(spark):
    """Pieces of far words don't meet: the pairs measured are a small part of all."""
    rng = random.Random(4)
    words = sorted({"".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=12)) for _ in range(3000)})
    entries = spark.createDataFrame([(w, 12, w, i) for i, w in enumerate(words)], "_c string, _len int, word string, rank int")
    strings = spark.createDataFrame([(w[:5] + "#" + w[6:],) for w in words[:500]], "code string")
    met = lx._met(strings, entries, 2, {12: len(words)})
    assert met.where("_d = 1").select("code").distinct().count() == 500 and met.count() < 500 * len(words) / 50
    assert "CartesianProduct" not in met._jdf.queryExecution().toString() and "NestedLoop" not in met._jdf.queryExecution().toString()
