"""Repeated words and bytes against brute force."""

import random

import numpy as np
import pytest
from brute import collected, corpus, frame, repeated_bytes, repeated_words

from barloom.llm.substrings import drop_repeated_words, reach, recompress
from barloom.llm.suffixes import drop_repeated_bytes, least_suffix


@pytest.fixture(scope="module")
def rows():
    return corpus()


def test_words(spark, rows):
    assert collected(drop_repeated_words(frame(spark, rows)).drop("kept")) == sorted(repeated_words(rows), key=str)


def test_bytes(spark, rows):
    rows = [r for r in rows if len(r[1] or "") < 20000]
    assert collected(drop_repeated_bytes(frame(spark, rows)).drop("kept")) == sorted(repeated_bytes(rows), key=str)


def test_other_widths(spark, rows):
    rows = [r for r in rows if len(r[1] or "") < 5000][::2]
    assert collected(drop_repeated_words(frame(spark, rows, clash=False), 20).drop("kept")) == sorted(repeated_words(rows, 20), key=str)
    assert collected(drop_repeated_bytes(frame(spark, rows, clash=False), 50).drop("kept")) == sorted(repeated_bytes(rows, 50), key=str)


def test_carried_and_layout(spark):
    rows = [(1, "a\n b", "x"), (None, None, None), (2, "", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {tuple(r) for r in drop_repeated_words(df, carry=("lang",)).select("doc_id", "kept", "lang").collect()}
    assert got == {(1, "a\n b", "x"), (None, "", None), (2, "", "y")}


def test_empty(spark):
    assert drop_repeated_words(frame(spark, [])).count() == 0
    assert drop_repeated_bytes(frame(spark, [])).count() == 0


def test_symbols_agree_inside_equal_strings():
    """Whatever surrounds it, a string has the same symbols from CONTEXT words off its ends on."""
    rng = random.Random(2)
    context, longest = reach(2)
    for _ in range(300):
        common = [rng.randrange(3) for _ in range(40)]
        seen = []
        for _ in range(2):
            lead, tail = ([rng.randrange(3) for _ in range(rng.randrange(20))] for _ in range(2))
            names = np.array([(x + 1) * 0x9E3779B97F4A7C15 % 2**64 for x in lead + common + tail], np.uint64)
            symbols, first = recompress(names, np.array([0, len(names)]))
            assert np.diff(first).max() <= longest
            low, high = len(lead) + context, len(lead) + len(common) - context
            seen.append([(a - len(lead), int(s)) for s, a, b in zip(symbols, first, first[1:]) if a >= low and b <= high])
        assert seen[0] == seen[1] and seen[0]


def test_least_suffix():
    data = np.frombuffer(random.Random(3).randbytes(500), np.uint8)
    one = least_suffix(data, 1)
    assert (one == np.arange(500)).all()
    wide = least_suffix(data, 30)
    assert ((wide >= np.arange(500)) & (wide < np.arange(500) + 30)).all() and (np.diff(wide) >= 0).all()
