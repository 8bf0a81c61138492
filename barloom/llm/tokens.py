"""The 50k byte-pair vocabulary inside tasks.

The ids are those of the ``tokenizers`` library for ``byte_bpe_50k.json`` (the tests compare them).
They are made with the same vocabulary as ranks, several times faster.  A special string inside a
text is one token, which is that library's default.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa

VOCABULARY = "byte_bpe_50k.tiktoken"
SPECIAL = {"<|endoftext|>": 50256}
#: Texts longer than this (in characters) are encoded piece by piece.
PIECE = 1 << 18
#: White space as the vocabulary's pattern has it, and runs of it that the pattern cannot take at once.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
RUN = 1 << 16
_RUN = re.compile(f"[{SPACE}]{{{RUN},}}")


@lru_cache(2)
def encoding(name: str = VOCABULARY):
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(name), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)


def pieces(text: str, size: int = PIECE) -> list[str]:
    """The text cut where no token can reach across: before a single space between two other characters.

    A token starts with its space or has none, so nothing joins the character before the space to it.
    Special strings hold no space.  Without such a place the text stays in one piece.
    """
    out, start = [], 0
    while len(text) - start > size:
        at = text.find(" ", start + size)
        while at > 0 and (text[at - 1].isspace() or text[at + 1:at + 2].isspace()):
            at = text.find(" ", at + 1)
        if at < 0 or at + 1 >= len(text):
            break
        out.append(text[start:at])
        start = at
    return [*out, text[start:]]


def _known(text: str, special: bool) -> np.ndarray:
    """Ids of a text without very long runs of white space."""
    code = encoding()
    more = {"allowed_special": "all"} if special else {"disallowed_special": ()}
    if len(text) <= PIECE:
        return code.encode_to_numpy(text, **more)
    return np.concatenate([code.encode_to_numpy(x, **more) for x in pieces(text)])


def encode(text: str | None, special: bool = True) -> np.ndarray:
    """Ids of the whole text; a null is empty.  Without ``special`` a special string is ordinary text.

    The pattern walks back over a run of white space, which a very long run does not allow.  Such a
    run is one stretch of the pattern, without its last character where more text follows, so it is
    merged by itself and the text around it is cut there.
    """
    if not text:
        return np.zeros(0, np.uint32)
    if len(text) < RUN:
        return _known(text, special)
    out, at = [], 0
    for run in _RUN.finditer(text):
        a, b = run.span()
        if b < len(text) and not (special and any(text.startswith(x, b) for x in SPECIAL)):
            b -= 1
        if a > at:
            out.append(_known(text[at:a], special))
        out.append(np.array(encoding()._encode_single_piece(text[a:b]), np.uint32))
        at = b
    if at < len(text):
        out.append(_known(text[at:], special))
    return np.concatenate(out)


def byte_balanced(batch: pa.RecordBatch, column: str, most: int = 1 << 21):
    """Slices of the batch of about ``most`` bytes of text each (one row at least)."""
    import pyarrow.compute as pc

    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(lengths) // most
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)
