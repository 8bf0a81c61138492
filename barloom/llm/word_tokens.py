"""The 49k word-piece vocabulary inside tasks.

This vocabulary drops white space, and no token, normal form or special string reaches across it, so
the ids of a text are those of its words one after the other.  Texts are encoded together: each
different word of plain letters is cut into parts and each different part merged once, in one call;
other words are encoded by the ``tokenizers`` library and remembered.
"""

from __future__ import annotations

import json
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from barloom.llm.tokens import SPACE

VOCABULARY = "word_bpe_49k.json"
BASE = 49408
END = 2
#: Characters that Python's split() takes for white space and the vocabulary does not.
_OTHER = re.compile("[\x1c-\x1f]")
_BREAK = re.compile(f"[{SPACE}]+")
#: Words of printable ASCII and of Latin letters whose lower case and normal form are plain, and their
#: parts as the vocabulary's pattern has them after lower-casing.
_LETTERS = "a-zß-öø-įı-ňŋ-ž"
_PLAIN = "^[!-~À-ÖØ-öø-įı-ňŊ-ž]+$"
_PARTS = f"[{_LETTERS}]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^{_LETTERS}0-9]+"
#: Words remembered at most, and the longest length of these and of plain words.
WORDS, LONGEST = 1 << 19, 64


def _merges(path: str):
    """The vocabulary's merges for ``tiktoken``, or None where they can't be put as ranks.

    The end of a word is a space, which no word holds.  It joins the byte before it first of all, and
    every other token's id is the rank of its merge.
    """
    import tiktoken

    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    byte = {c: b for b, c in bytes_to_letters().items()}
    end = model["end_of_word_suffix"]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    rising = all(model["vocab"][a + b] == 512 + i for i, (a, b) in enumerate(pairs))
    ranks = {}
    for token, i in model["vocab"].items():
        letters = bytes(byte[c] for c in token.removesuffix(end)) if not token.startswith("<|") else b" "
        if b" " not in letters:
            ranks[letters + b" " * token.endswith(end)] = i
    if not rising or len(ranks) != 510 + len(pairs):  # only the space's own two tokens are left out
        return None
    ranks[b" "] = len(model["vocab"])  # never left alone
    return tiktoken.Encoding("words", pat_str="[^ ]+ ", mergeable_ranks=ranks, special_tokens={})


def bytes_to_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it prints, else one from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class _Known(dict):
    """Word to its ids, two bytes each; filled on demand by the library and emptied when full."""

    def __init__(self, name: str):
        import public_tokenizers
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(public_tokenizers.path(name))
        if self.library.get_vocab_size() > 1 << 16:
            raise ValueError(f"{name} has ids above 65535")
        self.merges = _merges(public_tokenizers.path(name))
        self.last = np.zeros(1 << 16, bool)  # tokens that end a part
        if self.merges:
            self.last[[i for raw, i in self.merges._mergeable_ranks.items() if raw.endswith(b" ") and len(raw) > 1]] = True

    def __missing__(self, word: str) -> bytes:
        out = array("H", self.library.encode(word, add_special_tokens=False).ids).tobytes()
        if len(word) <= LONGEST:
            if len(self) >= WORDS:
                self.clear()
            self[word] = out
        return out

    def merged(self, parts: pa.Array) -> pa.Array:
        """Ids of each of some parts in lower case."""
        text = " ".join([*parts.to_numpy(zero_copy_only=False), ""])
        ids = np.frombuffer(self.merges._core_bpe.encode_to_tiktoken_buffer(text, set()), np.uint32).astype("<u2")
        ends = np.append(0, np.flatnonzero(self.last[ids]) + 1)
        return _binary(2 * ends, pa.py_buffer(ids))

    def plain(self, words: pa.Array) -> pa.Array:
        """Ids of each of some plain words."""
        marked = pc.replace_substring_regex(pc.utf8_lower(words), _PARTS, r"\0 ")
        parts = pc.split_pattern(pc.ascii_rtrim(marked, " "), " ")
        found = parts.flatten().dictionary_encode()
        return _joined(self.merged(found.dictionary).take(found.indices), parts)

    def all(self, words: pa.Array) -> pa.Array:
        """Ids of each of some words: the plain ones are merged by ``tiktoken`` with the same merges."""
        is_plain = pc.and_not(pc.match_substring_regex(words, _PLAIN), pc.match_substring(words, "<|"))
        is_plain = pc.and_(is_plain, pc.less_equal(pc.utf8_length(words), LONGEST)).to_numpy(zero_copy_only=False) & bool(self.merges)
        other = words.filter(pa.array(~is_plain)).to_pylist()
        out = pa.array([self[w] for w in other], pa.large_binary())
        if len(other) == len(words):
            return out
        place = np.where(is_plain, np.cumsum(is_plain) + len(other), np.cumsum(~is_plain)) - 1
        return pa.concat_arrays([out, self.plain(words.filter(pa.array(is_plain)))]).take(pa.array(place))


def _binary(offsets: np.ndarray, data: pa.Buffer) -> pa.Array:
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), data])


def _joined(values: pa.Array, lists: pa.Array) -> pa.Array:
    """The values of each list put together; they are those of all the lists."""
    _, offsets, data = values.buffers()
    return _binary(np.frombuffer(offsets, np.int64)[lists.offsets.to_numpy()], data)


@lru_cache(1)
def _known(name: str = VOCABULARY) -> _Known:
    return _Known(name)


def _words(texts: pa.Array) -> pa.Array:
    """The words of each text, perhaps with empty ones."""
    if pc.any(pc.match_substring_regex(texts, _OTHER.pattern)).as_py():
        return pa.array([_BREAK.split(t) if _OTHER.search(t) else t.split() for t in texts.to_pylist()], pa.large_list(pa.large_string()))
    return pc.utf8_split_whitespace(texts)


def encode_all(texts: pa.Array) -> pa.Array:
    """Ids of each whole text, two bytes each; a null is empty."""
    words = _words(pc.fill_null(texts, ""))
    found = words.flatten().dictionary_encode()
    return _joined(_known().all(found.dictionary).take(found.indices), words)


def encode(text: str | None) -> np.ndarray:
    """Ids of the whole text; a null is empty."""
    return np.frombuffer(encode_all(pa.array([text], pa.large_string()))[0].as_py(), "<u2")
