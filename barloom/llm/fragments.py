"""Fragments of a text's two token sequences, as a monoid.

A fragment covers a stretch of tokens of vocabulary A and one of vocabulary B, with their ends in
bytes.  Byte places where tokens of both end cut it: what lies up to the first such place is its open
prefix, what follows the last is its open suffix, and between them are closed groups, of which only
digests are kept.  Joining two neighbours settles the suffix of the left with the prefix of the right;
joining is associative, so fragments of a very long text may be joined in any tree.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

_NONE = np.zeros(0, np.int64)
#: Links of one group up to which they are written out in the vectorised path.
WIDE = 1 << 14


def _digits() -> tuple[np.ndarray, np.ndarray]:
    numbers = np.arange(1 << 16)
    size = np.char.str_len(numbers.astype(str)).astype(np.int64)
    table = np.zeros((len(numbers), 6), np.uint8)
    text = np.char.ljust(numbers.astype("S5"), 5)
    table[:, :5] = np.frombuffer(text.tobytes(), np.uint8).reshape(-1, 5)
    return table, size


_TABLE, _SIZE = _digits()


def ranges(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (counts[0] of them), first[1], ..."""
    ahead = np.cumsum(counts) - counts
    return np.arange(int(counts.sum())) + np.repeat(first - ahead, counts)


@dataclass
class Tokens:
    """Ids and byte ends of a stretch of A tokens and of one of B tokens."""

    a: np.ndarray = field(default_factory=lambda: _NONE)
    a_ends: np.ndarray = field(default_factory=lambda: _NONE)
    b: np.ndarray = field(default_factory=lambda: _NONE)
    b_ends: np.ndarray = field(default_factory=lambda: _NONE)

    def __add__(self, other: Tokens) -> Tokens:
        return Tokens(*(np.concatenate([getattr(self, c), getattr(other, c)]) for c in ("a", "a_ends", "b", "b_ends")))

    def cuts(self) -> np.ndarray:
        """Bytes at which tokens of both end."""
        return np.intersect1d(self.a_ends, self.b_ends, assume_unique=True)

    def part(self, low: int, high: int) -> Tokens:
        """The tokens that end in (low, high]."""
        i, j = np.searchsorted(self.a_ends, [low, high], "right")
        k, m = np.searchsorted(self.b_ends, [low, high], "right")
        return Tokens(self.a[i:j], self.a_ends[i:j], self.b[k:m], self.b_ends[k:m])


def grouped(tokens: Tokens, cuts: np.ndarray):
    """Group of each A and B token, and the groups' sizes."""
    ga, gb = np.searchsorted(cuts, tokens.a_ends), np.searchsorted(cuts, tokens.b_ends)
    return ga, gb, np.bincount(ga, minlength=len(cuts)), np.bincount(gb, minlength=len(cuts))


def spelled(tokens: Tokens, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The groups as text ``a1,a2|b1;a3|b2,b3;`` (bytes), and where each group's text ends."""
    ga, gb, na, nb = grouped(tokens, cuts)
    a_before, b_before = np.cumsum(na) - na, np.cumsum(nb) - nb
    n = len(tokens.a) + len(tokens.b)
    ids, mark = np.empty(n, np.int64), np.full(n, ord(","), np.uint8)
    ids[np.arange(len(tokens.a)) + b_before[ga]] = tokens.a
    ids[np.arange(len(tokens.b)) + (a_before + na)[gb]] = tokens.b
    mark[a_before + b_before + na - 1] = ord("|")
    mark[a_before + b_before + na + nb - 1] = ord(";")
    letters, size = _TABLE[ids], _SIZE[ids]
    letters[np.arange(n), size] = mark
    flat = letters[np.arange(6) <= size[:, None]]
    return flat, np.cumsum(size + 1)[np.cumsum(na + nb) - 1]


def links(tokens: Tokens, cuts: np.ndarray, owner: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Owner, A id, B id and number of links, one line for each pair of ids that a group links (repeats may occur).

    ``owner`` names the owner of each group, such as its text.  A group of many links contributes each
    pair of different ids once, with its number.
    """
    ga, gb, na, nb = grouped(tokens, cuts)
    owner = np.zeros(len(cuts), np.int64) if owner is None else owner
    wide = na * nb > WIDE
    b_before = np.cumsum(nb) - nb
    times = np.where(wide, 0, nb)[ga]
    at = np.repeat(np.arange(len(tokens.a)), times)
    out = [(owner[ga[at]], tokens.a[at], tokens.b[ranges(b_before[ga], times)], np.ones(len(at), np.int64))]
    a_before = np.cumsum(na) - na
    for g in np.flatnonzero(wide).tolist():
        x, x_times = np.unique(tokens.a[a_before[g]:a_before[g] + na[g]], return_counts=True)
        y, y_times = np.unique(tokens.b[b_before[g]:b_before[g] + nb[g]], return_counts=True)
        out.append((np.full(len(x) * len(y), owner[g]), np.repeat(x, len(y)), np.tile(y, len(x)), np.outer(x_times, y_times).ravel()))
    return tuple(np.concatenate(c) for c in zip(*out))


def summed(names: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different names, rising, and the sums of their times."""
    if not len(names):
        return _NONE, _NONE
    order = np.argsort(names, kind="stable")
    names, times = names[order], times[order]
    first = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]]))
    return names[first], np.add.reduceat(times, first)


@dataclass
class Closed:
    """Digest of closed groups: their text, number, links, and the linked pairs (A id << 32 | B id) with their numbers."""

    text: bytes = b""
    groups: int = 0
    pairs: np.ndarray = field(default_factory=lambda: _NONE)
    times: np.ndarray = field(default_factory=lambda: _NONE)

    @classmethod
    def of(cls, tokens: Tokens, cuts: np.ndarray) -> Closed:
        """Digest of tokens that end at the last cut."""
        if not len(cuts):
            return cls()
        _, a, b, times = links(tokens, cuts)
        return cls(spelled(tokens, cuts)[0].tobytes(), len(cuts), *summed((a.astype(np.int64) << 32) | b, times))

    def __add__(self, other: Closed) -> Closed:
        if not other.groups:
            return self
        if not self.groups:
            return other
        both = summed(np.concatenate([self.pairs, other.pairs]), np.concatenate([self.times, other.times]))
        return Closed(self.text + other.text, self.groups + other.groups, *both)


@dataclass
class Fragment:
    """Open prefix, closed groups and open suffix; without any cut all tokens are prefix."""

    prefix: Tokens
    closed: Closed
    suffix: Tokens
    cut: bool
    n_a: int
    n_b: int
    whole: bool = True  # both vocabularies give the text's bytes

    @classmethod
    def of(cls, tokens: Tokens, whole: bool = True) -> Fragment:
        cuts = tokens.cuts()
        n_a, n_b = len(tokens.a), len(tokens.b)
        if not len(cuts):
            return cls(tokens, Closed(), Tokens(), False, n_a, n_b, whole)
        first, last, end = int(cuts[0]), int(cuts[-1]), np.iinfo(np.int64).max
        return cls(tokens.part(-1, first), Closed.of(tokens.part(first, last), cuts[1:]), tokens.part(last, end), True, n_a, n_b, whole)

    def __add__(self, other: Fragment) -> Fragment:
        middle = self.suffix + other.prefix if self.cut else self.prefix + other.prefix
        settled = Fragment.of(middle)
        begun = Closed.of(settled.prefix, settled.prefix.cuts()) if self.cut and settled.cut else Closed()
        if self.cut:  # the left's last cut closes what begins the middle
            prefix = self.prefix
            suffix = settled.suffix if settled.cut else settled.prefix
        else:
            prefix, suffix = settled.prefix, settled.suffix
        closed = self.closed + begun + settled.closed + other.closed
        return Fragment(prefix, closed, other.suffix if other.cut else suffix, self.cut or settled.cut,
                        self.n_a + other.n_a, self.n_b + other.n_b, self.whole and other.whole)

    def finished(self) -> Closed:
        """The groups of a fragment that is a whole text: its start is a cut, and so is its end."""
        if len(self.suffix.a) or len(self.suffix.b) or not self.cut:
            raise ValueError("the text does not end at a common cut")
        return Closed.of(self.prefix, self.prefix.cuts()) + self.closed
