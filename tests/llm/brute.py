"""Brute-force versions and small inputs for the tests of the training-data operators."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Columns that operators use inside themselves.
CLASH = (
    "pack int, bucket string, names int, node string, component int, size string, signature int, key1 string, leader int, block string, "
    "band int, u string, v int, c string, y int, k string, held_out int, score string, n_words string, _text int, _words string, "
    "html_ int, lengths string, carried int, data string, doc_ids int, reason string, kept int, low string, high int"
)


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def words_of(text):
    return WORD.findall(text or "")


def repeated_words(rows, width=35):
    docs = [words_of(t) for _, t in rows]
    count = Counter(tuple(w[i:i + width]) for w in docs for i in range(len(w) - width + 1))
    out = []
    for (doc_id, _), w in zip(rows, docs):
        gone = set()
        for i in range(len(w) - width + 1):
            if count[tuple(w[i:i + width])] > 1:
                gone.update(range(i, i + width))
        left = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc_id, len(w), len(gone), sha(left.encode())))
    return out


def repeated_bytes(rows, width=200):
    docs = [(t or "").encode() for _, t in rows]
    count = Counter(d[i:i + width] for d in docs for i in range(len(d) - width + 1))
    out = []
    for (doc_id, _), d in zip(rows, docs):
        gone = set()
        for i in range(len(d) - width + 1):
            if count[d[i:i + width]] > 1:
                gone.update(range(i, i + width))
        spans = sum(1 for i in gone if i - 1 not in gone)
        out.append((doc_id, len(d), len(gone), spans, sha(bytes(x for i, x in enumerate(d) if i not in gone))))
    return out


def shingles(text, n=5):
    w = words_of((text or "").translate(LOWER))
    return frozenset(tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def groups(rows):
    """Near-duplicate components over all pairs."""
    sets = [shingles(t) for _, t in rows]
    root = {d: d for d, _ in rows if d is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, _) in enumerate(rows):
        for j in range(i):
            b = rows[j][0]
            if a is None or b is None or not sets[i] or not sets[j]:
                continue
            both = len(sets[i] & sets[j])
            if 100 * both >= 75 * len(sets[i] | sets[j]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [(d, len(s), None if d is None else find(d), d is None or find(d) == d) for (d, _), s in zip(rows, sets)]


def edit_distance(item, region):
    """Least word edits between the item and any part of the region."""
    row = [0] * (len(region) + 1)
    for i, x in enumerate(item, 1):
        new = [i]
        for j, y in enumerate(region, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def corpus(seed=4, n=250):
    """Texts with few different words, shared passages, near copies, nulls, empty and repeated rows."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        size, kinds = rng.choice([0, 1, 34, 35, 36, 60, 120, 300]), rng.choice([2, 3, 50])
        rows.append((i, " ".join(str(rng.randrange(kinds)) for _ in range(size))))
    passage = [f"w{rng.randrange(10**6)}é" for _ in range(400)]
    for i in range(60):
        a = rng.randrange(300)
        lone = lambda: [str(rng.random()) for _ in range(rng.randrange(40))]
        rows.append((2000 + i, "  ".join(lone() + passage[a:a + rng.randrange(30, 90)]) + "\n" + "\t".join(lone())))
    base = [str(rng.randrange(3000)) for _ in range(200)]
    rows += [(3000 + i, " ".join(w if rng.random() > 0.01 else str(rng.random()) for w in base)) for i in range(60)]
    rows += [
        (4000, None), (4001, ""), (4002, "  \n"), (4003, "x " * 500), (4004, "y z " * 100), (4005, "a b c d E"), (4006, "A b c d e"),
        (4007, "long" * 40000), (4008, "q " * 30000), (None, "q w e r t " * 9), (None, None), (5, rows[5][1]), (6, rows[6][1]),
    ]
    return rows


def frame(spark, rows, parts=3, clash=True):
    """A documents table, with clashing extra columns full of nulls."""
    out = spark.createDataFrame([tuple(r) for r in rows], "doc_id long, text string").repartition(parts)
    if clash:
        for column in CLASH.split(", "):
            name, kind = column.split(" ")
            out = out.selectExpr("*", f"cast(null as {kind}) as `{name}`")
    return out


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=str)
