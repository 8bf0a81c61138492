"""Both tokenizers of an alignment inside tasks: byte_bpe_50k.json (A) and piece_bpe_32k.model (B)."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa

from barloom.llm import tokens
from barloom.llm.fragments import Tokens

PIECES = "piece_bpe_32k.model"
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")
#: Places where a token of A, or of B, always ends.  A never joins white space to what comes before it;
#: no piece of B has a space after another character (checked on loading), and its encoder puts a space first itself.
_CUT_A = re.compile(f"[^{tokens.SPACE}][{tokens.SPACE}]")
_CUT_B = re.compile("[^ ▁] [^ ▁]")


@lru_cache(1)
def _a_bytes() -> pa.Array:
    code = tokens.encoding()
    return pa.array([code.decode_single_token_bytes(i) for i in range(code.n_vocab)], pa.large_binary())


@lru_cache(1)
def _model():
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(PIECES))
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    if any(re.search("[^▁]▁", p) for p in pieces):
        raise ValueError(f"{PIECES} has pieces with a space inside")
    raw = [bytes([int(m[1], 16)]) if (m := _BYTE.fullmatch(p)) else p.replace("▁", " ").encode() for p in pieces]
    return model, pa.array(raw, pa.large_binary())


def _joined(ids: np.ndarray, table: pa.Array) -> tuple[np.ndarray, memoryview]:
    """Ends of the tokens in bytes, and their bytes one after the other."""
    if not len(ids):
        return np.zeros(0, np.int64), memoryview(b"")
    found = table.take(pa.array(ids))
    offsets = np.frombuffer(found.buffers()[1], np.int64, len(ids) + 1)
    return offsets[1:], memoryview(found.buffers()[2]).cast("B")[:int(offsets[-1])]


def many(texts: list[str], a_texts: list[str] | None = None) -> tuple[list[Tokens], list[bool]]:
    """Tokens of each text with byte ends from 0, and whether both vocabularies give the bytes of space + text.

    ``a_texts`` are the stretches that A encodes where they differ from space + text.
    """
    model, b_table = _model()
    a_texts = [" " + t for t in texts] if a_texts is None else a_texts
    a_ids = [tokens.encode(t, special=False) for t in a_texts]
    b_ids = model.encode(texts, num_threads=1) if texts else []
    out, whole = [], []
    for text, a_text, a, b in zip(texts, a_texts, a_ids, b_ids):
        b = np.array(b, np.int64)
        a_ends, a_bytes = _joined(a, _a_bytes())
        b_ends, b_bytes = _joined(b, b_table)
        out.append(Tokens(a.astype(np.int64), a_ends, b, b_ends))
        whole.append(a_bytes == a_text.encode() and b_bytes == (" " + text).encode())
    return out, whole


def stretches(text: str, size: int) -> list[tuple[int, int, int, int]]:
    """(A from, A to, B from, B to) in characters, of about ``size`` each; both sequences cover the text.

    The two vocabularies are cut at different places, each at the first safe one of its own; without
    one a stretch is longer.
    """
    a_cuts, b_cuts, at = [0], [0], size
    while at < len(text):
        a, b = _CUT_A.search(text, at - 1), _CUT_B.search(text, at - 1)
        a_cuts.append(max(a_cuts[-1], a.start() + 1 if a else len(text)))
        b_cuts.append(max(b_cuts[-1], b.start() + 1 if b else len(text)))
        at = max(at + size, min(a_cuts[-1], b_cuts[-1]))
    a_cuts.append(len(text))
    b_cuts.append(len(text))
    return list(zip(a_cuts, a_cuts[1:], b_cuts, b_cuts[1:]))


def stretch(a_text: str, a_at: int, b_text: str, b_at: int, first: bool) -> tuple[Tokens, bool]:
    """Tokens of one stretch, ends counted from the start of space + text; ``a_at``, ``b_at`` are its byte places."""
    a = tokens.encode(" " + a_text if first else a_text, special=False)
    a_ends, a_bytes = _joined(a, _a_bytes())
    model, table = _model()
    b = np.array(model.encode(b_text if first else b_text[1:], num_threads=1) if b_text else [], np.int64)
    b_ends, b_bytes = _joined(b, table)
    whole = a_bytes == ((" " if first else "") + a_text).encode() and b_bytes == ((" " if first else "") + b_text).encode()
    return Tokens(a.astype(np.int64), a_ends + a_at, b, b_ends + b_at), whole
