"""Alignment of two tokenizers against a plain version, and the monoid of fragments."""

import hashlib
import random
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from brute import collected, frame
from tokenizers import Tokenizer

import barloom.llm.align as module
from barloom.llm.align import align
from barloom.llm.fragments import Fragment, Tokens, spelled
from barloom.llm.two_tokens import many, stretch, stretches

WORDS = ["the", "of", "naïve", "日本語", "cat.", "(x)", "12,5", "<s>", "<|endoftext|>", "don't", "über", "   ", "\n", "\t", "👩", "zxqv"]


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    letters = {chr(c): c for c in [*range(33, 127), *range(161, 173), *range(174, 256)]}
    n = 0
    for c in range(256):
        if c not in letters.values():
            letters[chr(256 + n)] = c
            n += 1
    return a, b, letters


def plain(rows, libraries):
    a_lib, b_lib, letters = libraries
    digests, pairs = [], []
    for doc_id, text in rows:
        groups = []
        if text:
            a = a_lib.encode(" " + text, add_special_tokens=False).ids
            b = b_lib.encode(text)
            a_raw = [bytes(letters[c] for c in a_lib.id_to_token(i)) for i in a]
            b_raw = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p) else p.replace("▁", " ").encode() for p in map(b_lib.id_to_piece, b)]
            if b"".join(a_raw) == b"".join(b_raw) == (" " + text).encode():
                i = j = 0
                while i < len(a):
                    ga, gb, x, y = [], [], 0, 0
                    while not ga or x != y:
                        if x <= y:
                            ga.append(a[i])
                            x += len(a_raw[i])
                            i += 1
                        else:
                            gb.append(b[j])
                            y += len(b_raw[j])
                            j += 1
                    groups.append((ga, gb))
        links = Counter((x, y) for ga, gb in groups for x in ga for y in gb)
        spell = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in groups)
        digests.append((doc_id, sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), hashlib.sha256(spell.encode()).hexdigest() if groups else ""))
        pairs.append(links)
    held = Counter(p for links in pairs for p in links)
    best = defaultdict(int)
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    out = []
    for (doc_id, n_a, n_b, n_groups, sha), links in zip(digests, pairs):
        n_best = sum(n for p, n in links.items() if held[p] == best[p[0]])
        out.append((doc_id, n_a, n_b, n_groups, sum(links.values()), n_best, sum(n * held[p] for p, n in links.items()), sha))
    return sorted(out, key=str)


def some_text(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "s", "é"]) for _ in range(n))


def rows_of(seed=3):
    rng = random.Random(seed)
    rows = [(i, some_text(rng, rng.choice([1, 5, 40, 300]))) for i in range(80)]
    rows += [(100, None), (101, ""), (102, " "), (103, "  a  "), (104, "a▁b"), (105, "x\x00y"), (106, "no" * 500), (107, " " * 3000), (None, "null id"), (None, None)]
    rows += [(5, rows[5][1]), (5, rows[5][1]), (6, "another text of that id")]
    return rows


def test_against_plain(spark, libraries):
    rows = rows_of()
    assert collected(align(frame(spark, rows))) == plain(rows, libraries)


def test_very_long(spark, libraries):
    """Texts of many stretches, joined in more than one round, beside short ones; one has a place that B alters."""
    rng = random.Random(4)
    long = some_text(rng, 60000)
    rows = [(1, long), (2, "short of the cat."), (1, long), (3, some_text(rng, 30000) + "▁"), (4, "ab" * 50000), (5, " \n" * 40000)]
    assert len(stretches(long, 1 << 15)) > 8
    assert collected(align(frame(spark, rows))) == plain(rows, libraries)


def test_empty(spark):
    assert align(frame(spark, [])).collect() == []
    assert [tuple(r) for r in align(frame(spark, [(1, None)])).collect()] == [(1, 0, 0, 0, 0, 0, 0, "")]


def test_any_tree_of_fragments():
    rng = random.Random(5)
    for _ in range(40):
        text = some_text(rng, rng.randrange(1, 120))
        (whole,), (same,) = many([text])
        if not same:
            continue
        want = Fragment.of(whole).finished()
        parts = []
        for k, (a, b, c, d) in enumerate(stretches(text, rng.choice([3, 10, 60]))):
            a_at, b_at = (1 + len(text[:x].encode()) if k else 0 for x in (a, c))
            parts.append(Fragment.of(*stretch(text[a:b], a_at, text[c:d], b_at, k == 0)))
        while len(parts) > 1:
            i = rng.randrange(len(parts) - 1)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        got = parts[0].finished()
        assert (got.text, got.groups) == (want.text, want.groups)
        assert got.pairs.tolist() == want.pairs.tolist() and got.times.tolist() == want.times.tolist()


def test_wide_groups_are_not_written_out():
    """A group of many tokens counts its links from the numbers of its ids."""
    n = 400
    tokens = Tokens(np.arange(n) % 7, np.arange(1, n + 1) * 2, np.arange(n) % 5, np.append(np.arange(1, n) * 2 - 1, 2 * n))
    closed = Fragment.of(tokens).finished()
    want = Counter((x % 7) << 32 | (y % 5) for x in range(n) for y in range(n))
    assert dict(zip(closed.pairs.tolist(), closed.times.tolist())) == want and closed.groups == 1
    assert spelled(tokens, tokens.cuts())[0].tobytes().decode() == ",".join(str(x % 7) for x in range(n)) + "|" + ",".join(str(x % 5) for x in range(n)) + ";"


def test_packs_are_small():
    """A pack of two megabytes of rare pairs is a small row, and a task needs little memory to make it."""
    rng = random.Random(6)
    texts = [" ".join("".join(rng.choices("abcdefghijklmnopqrst", k=rng.randrange(2, 9))) for _ in range(550)) for _ in range(600)]
    assert sum(map(len, texts)) > 1.9e6
    module._packed(0, [0], ["loads the vocabularies"])
    tracemalloc.start()
    pack = module._packed(0, list(range(600)), texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert pack.num_rows == 1 and pack.nbytes < 3e6
    assert peak < 8e7


def test_packs_are_the_same_from_any_parts(monkeypatch):
    ids, texts = zip(*rows_of(7))
    want = module._packed(3, list(ids), list(texts))
    for size in (1, 700, 5000):
        monkeypatch.setattr(module, "PART", size)
        assert module._packed(3, list(ids), list(texts)).equals(want)
