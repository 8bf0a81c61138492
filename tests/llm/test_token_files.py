"""Re-Pair blocks: exact round trips and random access; the files against the tokenizers library."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from brute import frame
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from barloom.llm import word_tokens
from barloom.llm.repair import LEAST, Block, _winners, encode_block
from barloom.llm.token_files import blocks, document_ids, read_ids, token_files, write_ids


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


ODD = [
    "", " ", "A b  c\n\tD", "don't I'LL it's", "l'été À ÉTÉ ŒUVRE straße", "x\x1cy \x85z", "日本語テキスト", "é é", "<|endoftext|> a<|startoftext|>b", "ΣΑΣ İı ŉ ſ",
    "12,345.67", "a" * 300, "👩‍👧 ok", "'s 't 're's", "!!!???...", "ﬁ ½ ²", " wide　space",
]


def test_ids(library):
    for text in [*ODD, " ".join(ODD) * 5]:
        assert word_tokens.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids, text


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("abst'ARE éÉßœ.,1\n\x1d <|>Σ-")), max_size=40))
def test_any_ids(text):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert word_tokens.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_parts_are_merged_once(library, monkeypatch):
    """Texts are encoded together: one call merges each different part of their words, whatever its case and signs."""
    known, calls = word_tokens._known(), []
    merged = known.merged
    monkeypatch.setattr(known, "merged", lambda parts: calls.append(parts.to_pylist()) or merged(parts))
    texts = ["Étonnant word, word. WORD", None, "", " don't 42word étonnant,  ", "WORD日本 <|endoftext|>"] * 50
    got = word_tokens.encode_all(pa.array(texts).slice(1))
    assert [np.frombuffer(g.as_py(), "<u2").tolist() for g in got] == [library.encode(t or "", add_special_tokens=False).ids for t in texts[1:]]
    assert sorted(calls[0]) == sorted(["étonnant", "word", ",", ".", "don", "'t", "4", "2"]) and len(calls) == 1


def test_ids_together(library):
    """Each text has its own ids where several are encoded at once, with control characters or without, in both string types."""
    for texts in (ODD, [t for t in ODD if "\x1c" not in t], ["\x00 a\x00b", "a" * 64, "a" * 65, "'" * 70, None]):
        for kind in (pa.string(), pa.large_string()):
            got = word_tokens.encode_all(pa.array(texts, kind))
            assert [np.frombuffer(g.as_py(), "<u2").tolist() for g in got] == [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert len(word_tokens.encode_all(pa.array([], pa.string()))) == 0


def test_winners():
    """In a row of neighbours with one score, higher than the scores beside it, every second place is replaced."""
    rng = np.random.default_rng(3)
    for kinds, share in ((1, 1.0), (2, 0.9), (3, 0.5), (40, 0.9)):
        places = np.flatnonzero(rng.random(500) < share)
        score = rng.integers(1, kinds + 1, len(places))
        by_place, expected, row = dict(zip(places.tolist(), score.tolist())), [], []
        for i, place in enumerate(places.tolist()):
            row = [*row, i] if by_place.get(place - 1) == by_place[place] else [i]
            if by_place.get(place + 1) != by_place[place]:
                beside = max(by_place.get(place - len(row), 0), by_place.get(place + 1, 0))
                expected += row[::2] if by_place[place] > beside else []
        assert _winners(places, score).tolist() == expected
    assert _winners(np.zeros(0, np.int64), np.zeros(0, np.int64)).tolist() == []


@pytest.mark.parametrize("kinds", [1, 2, 5, 40])
def test_round_trip(kinds):
    rng = np.random.default_rng(kinds)
    for n in (0, 1, 2, 50, 5000):
        ids = rng.integers(0, kinds, n)
        if n == 5000:
            ids = np.tile(ids[:100], 50)
        ends = np.append(np.sort(rng.integers(0, n + 1, 6)), n)
        data = encode_block([None, *range(6)], ids, ends, 50)
        block = Block.read(data)
        found, found_ends = block.all()
        assert found.tolist() == ids.tolist() and found_ends.tolist() == ends.tolist() and block.doc_ids == [None, *range(6)]
        for k in range(7):
            assert block.document(k).tolist() == ids[ends[k - 1] if k else 0:ends[k]].tolist()
        for a in range(0, n, max(1, n // 20)):
            assert block.tokens(a, 17).tolist() == ids[a:a + 17].tolist()
        assert block.tokens(n, 5).tolist() == []
        if n == 5000:
            assert len(block.left) and len(block.symbols) < n / 10


def test_rules_are_of_frequent_pairs():
    ids = np.array(([7, 8] * 3 + [9]) * LEAST + [1, 2])
    block = Block.read(encode_block([1], ids, np.array([len(ids)]), 10))
    made = {10 + k: (a, b) for k, (a, b) in enumerate(zip(block.left.tolist(), block.right.tolist()))}
    assert made[10] == (7, 8) and (1, 2) not in made.values()
    assert all(block.lengths[s] == block.lengths[a] + block.lengths[b] for s, (a, b) in made.items())


def test_files(spark, library):
    rng = random.Random(8)
    rows = [(rng.randrange(10**6), " ".join(rng.choice(["the", "Cat", "sat.", "naïve", "zxq!"]) for _ in range(rng.choice([0, 1, 30, 400])))) for _ in range(200)]
    rows += [(10**7 + i, t) for i, t in enumerate(ODD)] + [(5, None), (None, "no id"), (rows[3][0], rows[3][1]), (rows[4][0], "another text")]
    got = sorted((tuple(r) for r in token_files(frame(spark, rows)).collect()), key=lambda r: r[1])
    ids = {}
    for d, t in rows:
        ids.setdefault(d, []).append([*library.encode(t or "", add_special_tokens=False).ids, 2])
    assert [r[0] for r in got] == sorted((d for d, _ in rows), key=lambda d: (d is not None, d))
    start = 0
    for d, first, n, crc in got:
        assert first == start and (n, crc) in {(len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for x in ids[d]}
        start += n
    assert start == sum(len(x) for d in ids for x in ids[d])
    assert token_files(frame(spark, [])).count() == 0


def test_small_blocks(spark, library):
    """Many blocks over several tasks: positions go on from block to block; one document is read from its block alone."""
    rows = [(i, f"text number {i} " * (i % 7)) for i in range(300)]
    path = write_ids(frame(spark, rows, 4), size=50)
    assert spark.read.parquet(path).count() > 20
    got = sorted(tuple(r) for r in read_ids(spark, path).collect())
    start = 0
    for (d, first, n, _), (i, text) in zip(got, rows):
        own = [*library.encode(text, add_special_tokens=False).ids, 2]
        assert (d, first, n) == (i, start, len(own))
        start += n
    assert [x.tolist() for x in document_ids(spark, path, 123)] == [[*library.encode(rows[123][1], add_special_tokens=False).ids, 2]]
    assert document_ids(spark, path, 10**6) == []
    assert blocks(frame(spark, [(1, "a"), (2, "b")]), size=1).count() == 2
