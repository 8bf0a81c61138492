"""Texts of an Arrow batch as flat numpy arrays: bytes, words, names of words and of windows.

``word_names`` chains a mixing step over the bytes of a word, eight at a time.  Windows and spans of
items are named by ``Spans``: polynomials over four random bases modulo the prime 2 ** 31 - 1, packed
into 128 bits, so a window's name is a difference of prefix sums.  The polynomials modulo 2 ** 64
(``prefix``, ``span_hash``) serve short runs of word names and features only: for long regular strings
they lose many bits.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts one after the other, and the n + 1 offsets; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
    data = column.buffers()[2]
    if data is None or data.size == 0:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]], offsets - offsets[0]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word ``[^\\x20\\x09-\\x0D]+``, and the number of words before each text (n + 1)."""
    if not len(data):
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(len(offsets), np.int64)
    solid = ~_SPACE[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    first[cuts] = solid[cuts]
    last[cuts - 1] = solid[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of a hash."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(4)
def _coefficients(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1)


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """base ** i and its inverse for i below n, modulo 2 ** 64."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        up = np.full(size, base, np.uint64)
        down = np.full(size, pow(base, -1, 2**64), np.uint64)
        up[0] = down[0] = 1
        have = (np.multiply.accumulate(up), np.multiply.accumulate(down))
        if size <= 1 << 23:
            _powers[base] = have
    return have[0][:n], have[1][:n]


def prefix(values: np.ndarray, base: int) -> np.ndarray:
    """Prefix sums of value times power (n + 1)."""
    up, _ = powers(len(values), base)
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up, out=out[1:])
    return out


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Hash of the values in each [start, end): equal for equal values, wherever they lie."""
    _, down = powers(len(sums), base)
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def byte_sums(data: np.ndarray, which: int = 0) -> np.ndarray:
    return prefix(_coefficients(11 + which)[data], BASES[which])


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    return span_hash(byte_sums(data, which), starts, ends, BASES[which])


_SEEDS = (0x243F6A8885A308D3, 0x13198A2E03707344)
#: Words of more bytes are named one by one.
_LONG_WORD = 64


def word_names(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """64-bit name of each word's bytes; the names of ``which`` 0 and 1 are independent."""
    size = (ends - starts).astype(np.int64)
    seed = np.uint64(_SEEDS[which])
    out = mix(size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + seed)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))  # the eight bytes from each place on
    long = np.flatnonzero(size > _LONG_WORD)
    active = np.flatnonzero((size > 0) & (size <= _LONG_WORD))
    step = 0
    while len(active):
        part = eight[starts[active] + step]
        short = size[active] - step
        last = short < 8
        part[last] &= (np.uint64(1) << (short[last].astype(np.uint64) * np.uint64(8))) - np.uint64(1)
        out[active] = mix(out[active] * np.uint64(0xD6E8FEB86659FD93) + mix(part + seed))
        step += 8
        active = active[short > 8]
    for k in long.tolist():
        out[k] = xxhash.xxh3_64_intdigest(data[starts[k]:ends[k]].tobytes(), seed=int(seed))
    return out


_PRIME = (1 << 31) - 1
_LANES = (1_103_515_245, 1_664_525_013, 1_597_334_677, 1_812_433_253)
_lane_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers_31(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """base ** i and its inverse for i below n, modulo the prime; built by doubling."""
    have = _lane_powers.get(base)
    if have is None or len(have[0]) < n:
        out = []
        for b in (base, pow(base, -1, _PRIME)):
            row = np.ones(1, np.uint64)
            while len(row) < max(n, 1 << 16):
                row = np.concatenate([row, row * np.uint64(pow(b, len(row), _PRIME)) % np.uint64(_PRIME)])
            out.append(row.astype(np.uint32))
        have = (out[0], out[1])
        if len(have[0]) <= 1 << 23:
            _lane_powers[base] = have
    return have[0][:n], have[1][:n]


class Spans:
    """Names of any spans of a row of items.

    ``lanes`` are four arrays of numbers below 2 ** 31, or one that serves for all four.
    """

    def __init__(self, lanes: list[np.ndarray]) -> None:
        n = len(lanes[0])
        self.sums = []
        for k, base in enumerate(_LANES):
            lane = lanes[k % len(lanes)]
            sums = np.zeros(n + 1, np.uint64)
            np.multiply(lane, _powers_31(n, base)[0], out=sums[1:], dtype=np.uint64)
            if n and int(lane.max()) * n >= 1 << 32:
                sums %= np.uint64(_PRIME)
            np.cumsum(sums, out=sums)
            self.sums.append(sums)

    @classmethod
    def of_bytes(cls, data: np.ndarray) -> Spans:
        return cls([data.astype(np.uint16) + np.uint16(1)])

    @classmethod
    def of_names(cls, first: np.ndarray, second: np.ndarray) -> Spans:
        low = np.uint64((1 << 31) - 1)
        return cls([part % np.uint64(_PRIME) for x in (first, second) for part in (x & low, x >> np.uint64(33))])

    def names(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Two 64-bit names of the items in each [start, end): equal for equal items, wherever they lie."""
        size = (ends - starts).astype(np.uint64)
        lanes = []
        for base, sums in zip(_LANES, self.sums):
            inverse = _powers_31(len(sums), base)[1]
            lanes.append((sums[ends] - sums[starts]) % np.uint64(_PRIME) * inverse[starts].astype(np.uint64) % np.uint64(_PRIME))
        return np.stack([mix(((lanes[k] << np.uint64(31)) | lanes[k + 1]) + (size << np.uint64(62))) ^ mix(size) for k in (0, 2)], 1)


def window_starts(before: np.ndarray, width: int) -> np.ndarray:
    """First item of each window of ``width`` items that lies inside one text."""
    counts = np.maximum(np.diff(before) - width + 1, 0)
    return concat_ranges(before[:-1], counts)


def concat_ranges(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (counts[0] of them), first[1], ..."""
    counts = np.asarray(counts, np.int64)
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    ahead = np.cumsum(counts) - counts
    return np.arange(total) + np.repeat(np.asarray(first, np.int64) - ahead, counts)


def per_text(before: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """Sum of the flags of each text's items."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[before[1:]] - sums[before[:-1]]


def covered(starts: np.ndarray, widths: np.ndarray | int, n: int) -> np.ndarray:
    """Items below n that lie in one of the windows."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + widths, -1)
    return np.cumsum(edge[:-1]) > 0
