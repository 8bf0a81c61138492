"""Near duplicates and components against brute force."""

import random

from brute import collected, corpus, frame, groups

from barloom.llm.components import components
from barloom.llm.minhash import near_duplicates, one_of_each


def test_groups(spark):
    rows = corpus()
    assert collected(near_duplicates(frame(spark, rows))) == sorted(groups(rows), key=str)


def test_bridge_between_groups(spark):
    """A document that links two others which are not linked themselves."""
    rng = random.Random(7)
    base = [f"w{rng.random()}" for _ in range(300)]
    left = [*base[:260], *(f"l{i}" for i in range(40))]
    right = [*(f"r{i}" for i in range(40)), *base[40:]]
    rows = [(3, " ".join(base)), (2, " ".join(left)), (9, " ".join(right))]
    want = groups(rows)
    assert len({w[2] for w in want}) == 1
    assert collected(near_duplicates(frame(spark, rows))) == sorted(want, key=str)


def test_one_of_each(spark):
    rows = [(2, "a b c d e f"), (1, "a B c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (3, ""), (4, ""), (5, None)]
    assert sorted((r.doc_id or 0) for r in one_of_each(frame(spark, rows)).collect()) == [0, 1, 3, 4, 5]


def test_one_id_for_unlike_texts(spark):
    """Unlike texts under one id both stay, also if one of them is a copy of a document with a lesser id."""
    rows = [(1, "a b c d e f"), (4, "g h i j k l"), (4, "A b c d e f"), (4, "m n o p q r"), (4, "m n o p q r"), (6, "G h i j k l"), (7, "s t u v w x")]
    got = sorted((r.doc_id, r.text) for r in one_of_each(frame(spark, rows)).collect())
    assert got == [(1, "a b c d e f"), (4, "g h i j k l"), (4, "m n o p q r"), (7, "s t u v w x")]


def test_empty(spark):
    assert near_duplicates(frame(spark, [])).count() == 0


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 140)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for u, v in edges:
        a, b = find(u), find(v)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    linked = {x for u, v in edges if u != v for x in (u, v)}
    assert got == {x: find(x) for x in linked}
