"""Re-Pair grammar compression of token ids.

Frequent pairs of neighbouring symbols are replaced by new symbols, again and again, the most
frequent first.  A round takes all pairs of about the highest remaining frequency at once; where two
of their occurrences overlap, the more frequent pair wins, and in a row of equally frequent ones every
second.  No pair reaches across the end of a document, so each document is a range of symbols and is
decoded without its neighbours; the expansion lengths give the place of any token.

A block of documents is one byte string:

    magic, counts            8 bytes, then 7 little-endian 64-bit numbers: documents, ids, terminals,
                             rules, rounds, symbols, bytes of a symbol
    documents                64-bit ids, one byte each for "has an id", 64-bit ends in symbols
    rounds                   32-bit number of rules of each
    rules                    32-bit left and right symbols, 64-bit expansion lengths
    symbols                  2 or 4 bytes each
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np

MAGIC = b"REPAIR01"
#: Fewest occurrences of a pair that gets a rule, and most rounds.
LEAST, ROUNDS = 8, 24
_SLOTS = 1 << 20


def expand_ranges(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (counts[0] of them), first[1], ..."""
    total = int(counts.sum())
    ahead = np.cumsum(counts) - counts
    return np.arange(total) + np.repeat(first - ahead, counts)


def _slots(key: np.ndarray, closed: np.ndarray | None = None) -> np.ndarray:
    """A place in a table of 2 ** 20 for each pair; a place of its own, the last, for pairs that reach across a document's end."""
    out = (key * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(44)).view(np.int64)
    if closed is not None:
        out[closed] = _SLOTS
    return out


def _frequent(key: np.ndarray, slot: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    """The most frequent pairs, their counts, the places of pairs that may be among them, and whether these are all from ``least`` on.

    A slot's count bounds those of its pairs from above, so only pairs of full slots are sorted.
    """
    full = np.bincount(slot, minlength=_SLOTS + 1)
    full[_SLOTS] = 0
    bound = max(least, int(full.max()) // 64)
    while True:
        near = np.flatnonzero((full >= bound).take(slot))
        found = np.sort(key.take(near))
        starts = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]])) if len(found) else np.zeros(0, np.int64)
        counts = np.diff(np.append(starts, len(found)))
        often = np.flatnonzero(counts >= bound)
        if len(often) or bound == least:
            return found.take(starts.take(often)), counts.take(often), near, bound == least
        bound = least  # unlike pairs shared a slot


def _winners(places: np.ndarray, score: np.ndarray) -> np.ndarray:
    """Indexes of the places to replace: in a row of neighbours with one score, higher than the scores beside it, every second."""
    if not len(places):
        return places
    touch = places[1:] == places[:-1] + 1
    rise = score[1:] > score[:-1]
    level = touch & (score[1:] == score[:-1])
    best = np.ones(len(places), bool)
    best[1:] = rise | ~touch | level
    best[:-1] &= ~(rise & touch)
    inner = np.flatnonzero(level)
    if len(inner):
        cut = inner[1:] != inner[:-1] + 1
        first, last = inner[np.concatenate([[True], cut])], inner[np.concatenate([cut, [True]])] + 1
        lengths = last - first + 1
        row = expand_ranges(first, lengths)
        best[row] = np.repeat(best[first] & best[last], lengths) & ((row - np.repeat(first, lengths)) % 2 == 0)
    return np.flatnonzero(best)


def compress(ids: np.ndarray, ends: np.ndarray, terminals: int, least: int = LEAST, rounds: int = ROUNDS):
    """Rules (left, right), rules of each round, symbols, and the documents' ends in symbols."""
    symbols = ids.astype(np.uint32)
    closed = np.zeros(len(symbols), bool)  # the symbol is the last of its document
    closed[ends[ends > 0] - 1] = True
    left, right, sizes = [], [], []
    number = terminals
    for _ in range(rounds):
        if len(symbols) < 2:
            break
        key = symbols[:-1].astype(np.uint64)
        key <<= np.uint64(32)
        key |= symbols[1:]
        slot = _slots(key, np.flatnonzero(closed[:-1]))
        pairs, counts, near, rarest = _frequent(key, slot, least)
        if not len(pairs):
            break
        table = np.full(_SLOTS + 1, -1, np.int32)
        table[_slots(pairs)] = np.arange(len(pairs))  # of pairs in one slot the last has its turn, the others later
        chosen = table.take(slot.take(near))
        some = np.flatnonzero(chosen >= 0)
        at, chosen = near.take(some), chosen.take(some)
        same = np.flatnonzero(pairs.take(chosen) == key.take(at))
        at, chosen = at.take(same), chosen.take(same)
        won = _winners(at, counts.take(chosen))
        at, chosen = at.take(won), chosen.take(won)
        used = np.bincount(chosen, minlength=len(pairs))
        good = used >= max(2, least // 2)
        kept = np.flatnonzero(good.take(chosen))
        at, chosen = at.take(kept), chosen.take(kept)
        if not len(at):
            break
        rank = np.cumsum(good) - 1
        left.append((pairs[good] >> np.uint64(32)).astype(np.int64))
        right.append((pairs[good] & np.uint64(0xFFFFFFFF)).astype(np.int64))
        sizes.append(int(good.sum()))
        symbols[at] = number + rank.take(chosen)
        closed[at] = closed.take(at + 1)
        number += sizes[-1]
        stay = np.ones(len(symbols), bool)
        stay[at + 1] = False
        stay = np.flatnonzero(stay)
        symbols, closed = symbols.take(stay), closed.take(stay)
        if rarest and len(at) * 128 < len(symbols):
            break
    none = np.zeros(0, np.int64)
    marks = np.flatnonzero(closed) + 1  # one for each document that is not empty
    filled = np.diff(ends, prepend=0) > 0
    doc_ends = np.concatenate([[0], marks])[np.cumsum(filled)]
    return (np.concatenate(left or [none]), np.concatenate(right or [none])), np.array(sizes, np.int64), symbols, doc_ends


def encode_block(doc_ids: list[int | None], ids: np.ndarray, ends: np.ndarray, terminals: int) -> bytes:
    """The byte string of documents whose tokens end at ``ends`` of ``ids``."""
    (left, right), rounds, symbols, doc_ends = compress(ids, np.asarray(ends, np.int64), terminals)
    lengths = _lengths(left, right, rounds, terminals)[terminals:]
    width = 2 if terminals + len(left) <= 1 << 16 else 4
    head = np.array([len(doc_ids), len(ids), terminals, len(left), len(rounds), len(symbols), width], "<i8")
    return b"".join([
        MAGIC, head.tobytes(),
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
        np.array([d is not None for d in doc_ids], "u1").tobytes(),
        doc_ends.astype("<i8").tobytes(), rounds.astype("<u4").tobytes(),
        left.astype("<u4").tobytes(), right.astype("<u4").tobytes(), lengths.astype("<i8").tobytes(),
        symbols.astype(f"<u{width}").tobytes(),
    ])


def _lengths(left: np.ndarray, right: np.ndarray, rounds: np.ndarray, terminals: int) -> np.ndarray:
    """Number of tokens of each symbol; the rules of a round use only symbols of earlier rounds."""
    out = np.ones(terminals + len(left), np.int64)
    at = 0
    for size in rounds.tolist():
        part = slice(at, at + size)
        out[terminals + at:terminals + at + size] = out[left[part]] + out[right[part]]
        at += size
    return out


@dataclass
class Block:
    """A block read from its byte string; nothing is expanded before it is asked for."""

    doc_ids: list[int | None]
    doc_ends: np.ndarray
    n_ids: int
    terminals: int
    rounds: np.ndarray
    left: np.ndarray
    right: np.ndarray
    lengths: np.ndarray
    symbols: np.ndarray

    @classmethod
    def read(cls, data: bytes) -> Block:
        if data[:8] != MAGIC:
            raise ValueError("not a block of token ids")
        docs, n_ids, terminals, rules, rounds, symbols, width = np.frombuffer(data, "<i8", 7, 8).tolist()
        at = 64

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, count, at)
            at += out.nbytes
            return out

        numbers, present = take("<i8", docs).tolist(), take("u1", docs).tolist()
        doc_ends, sizes = take("<i8", docs), take("<u4", rounds)
        left, right, lengths = take("<u4", rules), take("<u4", rules), take("<i8", rules)
        own = np.concatenate([np.ones(terminals, np.int64), lengths])
        return cls([d if p else None for d, p in zip(numbers, present)], doc_ends, n_ids, terminals, sizes, left, right, own, take(f"<u{width}", symbols))

    @cached_property
    def ends(self) -> np.ndarray:
        """Tokens up to and with each symbol."""
        return np.cumsum(self.lengths[self.symbols])

    def _expand(self, symbols: np.ndarray) -> np.ndarray:
        """Tokens of a few symbols, rule by rule."""
        out = symbols.astype(np.int64)
        while len(out) and (rule := out >= self.terminals).any():
            new = np.repeat(out, 1 + rule)
            at = np.flatnonzero(rule) + np.arange(int(rule.sum()))
            inner = out[rule] - self.terminals
            new[at], new[at + 1] = self.left[inner], self.right[inner]
            out = new
        return out.astype(np.uint32)

    def document(self, number: int) -> np.ndarray:
        """Tokens of one document."""
        return self._expand(self.symbols[self.doc_ends[number - 1] if number else 0:self.doc_ends[number]])

    def tokens(self, start: int, length: int) -> np.ndarray:
        """Tokens [start, start + length) of the block; only symbols that reach into them are expanded."""
        length = max(0, min(length, self.n_ids - start))
        if not length:
            return np.zeros(0, np.uint32)
        a = int(np.searchsorted(self.ends, start, "right"))
        b = int(np.searchsorted(self.ends, start + length, "left"))
        before = int(self.ends[a - 1]) if a else 0
        return self._expand(self.symbols[a:b + 1])[start - before:start - before + length]

    def all(self) -> tuple[np.ndarray, np.ndarray]:
        """All tokens, and the documents' ends in tokens.  Every rule is expanded once."""
        offsets = np.concatenate([np.arange(self.terminals), self.terminals + np.cumsum(self.lengths[self.terminals:]) - self.lengths[self.terminals:]]).astype(np.int64)
        flat = np.empty(self.terminals + int(self.lengths[self.terminals:].sum()), np.uint32)
        flat[:self.terminals] = np.arange(self.terminals, dtype=np.uint32)
        at = 0
        for size in self.rounds.tolist():
            part = slice(at, at + size)
            both = np.column_stack([self.left[part], self.right[part]]).ravel().astype(np.int64)
            begin = int(offsets[self.terminals + at]) if size else 0
            source = expand_ranges(offsets[both], self.lengths[both])
            flat[begin:begin + len(source)] = flat[source]
            at += size
        ids = flat[expand_ranges(offsets[self.symbols], self.lengths[self.symbols])]
        return ids, np.concatenate([[0], self.ends])[self.doc_ends]
