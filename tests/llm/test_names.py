"""Unlike strings keep unlike names: regular strings on which polynomials modulo powers of two coincide."""

import numpy as np
from brute import collected, frame, sha

from barloom.llm.decontaminate import leaks
from barloom.llm.minhash import near_duplicates
from barloom.llm.substrings import drop_repeated_words
from barloom.llm.suffixes import drop_repeated_bytes
from barloom.llm.textarrays import Spans, word_names


def thue_morse(n, a="a", b="b"):
    return "".join(a if bin(i).count("1") % 2 == 0 else b for i in range(n))


PAIR = (thue_morse(2048), thue_morse(2048, "b", "a"))


def test_words():
    for width in (7, 63, 64, 65, 128):
        texts = [thue_morse(width), thue_morse(width, "b", "a")]
        data = np.frombuffer("".join(texts).encode(), np.uint8)
        names = word_names(data, np.array([0, width]), np.array([width, 2 * width]))
        assert names[0] != names[1]


def test_substrings(spark):
    rows = [(i, " ".join([f"w{k}" for k in range(17)] + [w] + [f"v{k}" for k in range(17)])) for i, w in enumerate(PAIR)]
    got = [r[:3] for r in collected(drop_repeated_words(frame(spark, rows)))]
    assert got == [(0, 35, 0), (1, 35, 0)]
    longer = [(i, thue_morse(4096, "x ", "y ")) for i in range(2)]
    assert [r[2] for r in collected(drop_repeated_words(frame(spark, longer)))] == [4096, 4096]


def test_near_duplicates(spark):
    rows = list(enumerate(PAIR))
    assert [(r[0], r[2], r[3]) for r in collected(near_duplicates(frame(spark, rows)))] == [(0, 0, True), (1, 1, True)]


def test_bytes(spark):
    """Windows of 200 bytes around complementary strings of 128."""
    a, b = (thue_morse(128, *letters) for letters in (("a", "b"), ("b", "a")))
    head, tail = "".join(chr(33 + i % 60) for i in range(36)), "".join(chr(93 - i % 50) for i in range(36))
    rows = [(i, head + x + tail) for i, x in enumerate((a, b))]
    got = [r[:5] for r in collected(drop_repeated_bytes(frame(spark, rows)))]
    assert got == [(i, 200, 0, 0, sha(t.encode())) for i, t in rows]


def test_leaks(spark):
    item = " ".join([f"w{k}" for k in range(10)] + [PAIR[0]] * 10)
    other = " ".join([f"w{k}" for k in range(10)] + [PAIR[1]] * 10)
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    found = leaks(frame(spark, [(1, item), (2, other)]), bench).collect()
    assert {r["doc_id"] for r in found} == {1}


def test_spans_of_equal_items():
    rng = np.random.default_rng(3)
    data = rng.integers(0, 3, 500).astype(np.uint8)
    data[300:400] = data[50:150]
    for spans in (Spans.of_bytes(data), Spans.of_names(data * np.uint64(2**61 + 12345), data * np.uint64(2**62 + 999))):
        names = spans.names(np.array([50, 300, 51]), np.array([150, 400, 151]))
        assert (names[0] == names[1]).all() and (names[0] != names[2]).all()
        twice = spans.names(np.arange(480), np.arange(480) + 20)
        want = {}
        for i in range(480):
            assert want.setdefault(data[i:i + 20].tobytes(), tuple(twice[i])) == tuple(twice[i])
        assert len(set(want.values())) == len(want)
