"""Token counts and packing against the tokenizers library."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from brute import frame
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from barloom.llm import packing
from barloom.llm.packing import cut_windows, pack
from barloom.llm.token_counts import token_counts
from barloom.llm.tokens import RUN, encode, pieces


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


ODD = ["", " ", "a  b", "x \n y", "tab\t z", "l'été don't I'LL", "１２ ½ ² Ⅷ", "a  b c", "<|endoftext|> in <|endoftext|>", "日本語 テキスト", "👩‍👧 ok", "\x1c \x85 ", "word" * 30]


def test_ids(library):
    for text in [*ODD, " ".join(ODD) * 40]:
        assert encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("space", [" ", "\n", "\t", "\u2003"])
def test_long_runs_of_white_space(library, space):
    """Runs longer than the pattern can walk back over: alone, between words, before and after a special string."""
    for n in (RUN, 10**6 if space != "\u2003" else RUN + 1):
        for before, after in (("", ""), ("a", "b"), ("a ", "<|endoftext|>x"), ("<|endoftext|>", " \n y")):
            text = before + space * n + after
            assert encode(text).tolist() == library.encode(text, add_special_tokens=False).ids
    assert len(encode("a" + space * 3 * 10**6 + "b")) > 10**6


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab'sé \n\t.,1½ ")), max_size=80))
def test_pieces(text):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    parts = pieces(text, 5)
    assert "".join(parts) == text
    assert [i for p in parts for i in encode(p).tolist()] == library.encode(text, add_special_tokens=False).ids


def test_counts(spark, library):
    rows = [*((i, t) for i, t in enumerate(ODD)), (50, None), (None, "x y"), (3, "tab\t z"), (60, "some words " * 60000)]
    got = sorted((tuple(r) for r in token_counts(frame(spark, rows)).collect()), key=str)
    n = {t: len(library.encode(t or "", add_special_tokens=False).ids) for _, t in rows}
    assert got == sorted(((d, len((t or "").encode()), n[t], n[t] > 1024) for d, t in rows), key=str)
    assert token_counts(frame(spark, [])).count() == 0


def test_packing(spark, library, monkeypatch):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(["the", "cat", "sat.", "Oh!", "zxq"]) for _ in range(rng.choice([0, 1, 30, 400, 3000])))) for i in range(150)]
    rows += [(900, None), (None, "null id"), (7, rows[7][1])]
    got = pack(frame(spark, rows, 2)).toPandas()
    ids = [np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for _, t in rows]
    want = {(d, len(x)): x for (d, _), x in zip(rows, ids)}
    by_doc: dict = {}
    for r in got.itertuples():
        key = (None if r.doc_id != r.doc_id else int(r.doc_id), r.doc_tokens)
        by_doc.setdefault(key, []).append((r.start, r.length))
        assert zlib.crc32(want[key][r.start:r.start + r.length].tobytes()) == r.ids_crc32
    for key, spans in by_doc.items():
        times = sum(1 for (d, _), x in zip(rows, ids) if (d, len(x)) == key)
        assert sum(n for _, n in spans) == times * key[1]
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == [0, *np.cumsum(s.length)[:-1].tolist()] and s.length.sum() <= 1024
    full = got.groupby("sequence_id").length.sum()
    assert 1 - full.sum() / (1024 * len(full)) < 0.02
    assert pack(frame(spark, [])).count() == 0


def test_cuts_are_optimal():
    rng = random.Random(6)
    for _ in range(200):
        places, penalty = [0], [0]
        while places[-1] < 60:
            places.append(places[-1] + rng.randrange(1, 8))
            penalty.append(rng.choice([0, 2, 12]))
        size, n = 10, len(places)
        best = [0] * n
        for i in range(n - 2, -1, -1):
            best[i] = min(size - (places[j] - places[i]) + penalty[j] + best[j] for j in range(i + 1, n) if places[j] - places[i] <= size)
        cuts = cut_windows(np.array(places), np.array(penalty), size)
        cost = sum(size - (places[b] - places[a]) + penalty[b] for a, b in zip(cuts, cuts[1:]))
        assert cuts[0] == 0 and cuts[-1] == n - 1 and cost == best[0]


def test_plans_join(spark, monkeypatch):
    """Small plans give the same documents back in order."""
    docs = [(i, "word " * (i % 50)) for i in range(300)]
    got = pack(frame(spark, docs, 1)).toPandas()
    assert got.length.sum() == sum(len(encode(t)) + 1 for _, t in docs)
    assert packing.PLAN > 1024
