"""Benchmark decontamination: passages within an edit distance of a benchmark item.

Words are compared without case and punctuation; an item of n words leaks where at most a fifth of n
word edits separate it from a passage.  Every item-sized window of a text is a query against all items:

* The CGK embedding walks over the window, at each step writing the word under the pointer and moving on
  if a random bit of (step, word) says so.  Few edits leave most steps equal, so edit distance becomes
  Hamming distance.
* Bit sampling: each of ``WALKS`` independent walks yields a key from ``SAMPLES`` of its steps.  A window
  that agrees with an item in any key is a candidate.
* Candidates are verified by the exact edit distance between item and text around the window.

Windows that cannot be within the distance of any item are not embedded: k edits leave n - k words of
the window in the items' vocabulary, and cut the item into k + 1 pieces of which one stands in the
window unchanged.  Where the text's start or end cuts a window short there is nothing to embed; an item
that shares a piece there, and whose own words make up n - k of the text around it, is verified at once,
so that no passage at an edge depends on the walks.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.tables import texts
from barloom.llm.textarrays import BASES, LOWER, concat_ranges, flat, mix, prefix, span_hash, word_names, words
from barloom.llm.tokens import byte_balanced

EDITS = 0.2
WALKS, SAMPLES = 24, 3
#: Shorter items are found as they stand only.
LEAST_WORDS = 5
#: Bytes of items in one broadcast; larger benchmarks take several passes.
SLICE_BYTES = 8 << 20
CHUNK = 2048
EDGE_CHUNK = 1 << 14
TABLE_BITS = 20
SCHEMA = "doc_id long, item_id long, item_words long, distance long, first_word long, end_word long"
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[c for c in range(33, 127) if not chr(c).isalnum()]] = True


def _lead(*ranges: tuple[int, int]) -> np.ndarray:
    """First two bytes (as one number) of the UTF-8 forms of the code points in the ranges, 64 to a pair."""
    out = np.zeros(1 << 16, bool)
    for a, b in ranges:
        for c in range(a, b, 64):
            x = chr(c).encode()
            out[x[0] << 8 | x[1]] = True
    return out


#: Scripts without spaces: Thai and Lao, Burmese, Khmer, kana, Han (with its extensions).
_SPACELESS = _lead((0x0E00, 0x0F00), (0x1000, 0x1080), (0x1780, 0x1800), (0x3040, 0x3100), (0x3400, 0xA000), (0x20000, 0x32000))


def apart(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with spaces around each character of a script without spaces, and their offsets."""
    at = np.flatnonzero(data[:-1] >= 0xE0)
    at = at[_SPACELESS[data[at].astype(np.int64) << 8 | data[at + 1]]]
    if not len(at):
        return data, offsets
    cuts = np.unique(np.concatenate([at, at + 3 + (data[at] >= 0xF0)]))
    return np.insert(data, cuts, 32), offsets + np.searchsorted(cuts, offsets)


def plain_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Names of all words, without case (A-Z) and ASCII punctuation, and the number of words before each text.

    In scripts without spaces each character is a word.
    """
    data, offsets = apart(*flat(column))
    data = LOWER[data]
    data[_PUNCTUATION[data]] = 32
    begin, end, before = words(data, offsets)
    return word_names(data, begin, end), before


def edits_allowed(n: int) -> int:
    return int(EDITS * n) if n >= LEAST_WORDS else 0


def piece_words(n: int) -> int:
    """Words of an unchanged piece that any passage within the distance must hold."""
    k = edits_allowed(n)
    return min(4, (n - k) // (k + 1))


def embed_keys(names: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """One key per walk (walks x windows)."""
    count, steps = len(starts), 2 * int(lengths.max())
    walk = np.arange(WALKS, dtype=np.uint64)[:, None]
    share = np.random.default_rng(29).random((WALKS, SAMPLES))
    wanted = (share[:, :, None] * 2 * lengths[None, None, :]).astype(np.int64)  # steps that are sampled
    at = np.zeros((WALKS, count), np.int64)
    keys = np.broadcast_to(mix(walk + np.uint64(1)) + lengths.astype(np.uint64), (WALKS, count)).copy()
    for step in range(steps):
        inside = at < lengths
        word = np.where(inside, names[starts + np.minimum(at, lengths - 1)], np.uint64(0))
        for s in range(SAMPLES):
            hit = wanted[:, s] == step
            if hit.any():
                keys[hit] = mix(keys[hit] * np.uint64(3) + word[hit] + np.uint64(s))
        salt = (walk * np.uint64(0x9E3779B97F4A7C15) + np.uint64(step)) * np.uint64(0xD6E8FEB86659FD93)
        at += ((word ^ salt) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(63)).astype(np.int64)
    return keys


def best_match(item: np.ndarray, region: np.ndarray) -> tuple[int, int, int]:
    """Least edit distance between the item and any part of the region, with that part's start and end."""
    size = len(region)
    unit = np.int64(1) << np.int64(32)
    along = np.arange(size + 1, dtype=np.int64)
    row = size - along  # distance in the upper half, the start (later ones first) in the lower
    for word in item:
        new = row + unit
        np.minimum(new[1:], row[:-1] + unit * (region != word), out=new[1:])
        row = np.minimum.accumulate(new - along * unit) + along * unit
    end = int(np.argmin(row >> np.int64(32)))
    return int(row[end] >> 32), size - int(row[end] & (unit - 1)), end


class Items:
    """A bounded slice of the benchmark, ready for lookups."""

    def __init__(self, rows: list[tuple[int, str]]):
        names, before = plain_words(pa.array([t for _, t in rows], pa.string()))
        self.words, self.ids = [], []
        for (item_id, _), a, b in zip(rows, before[:-1].tolist(), before[1:].tolist()):
            if b > a:
                self.words.append(names[a:b])
                self.ids.append(item_id)
        self.lengths = sorted({len(w) for w in self.words})
        self.vocabulary = np.zeros(1 << TABLE_BITS, bool)
        self.seen = {piece_words(n): np.zeros(1 << TABLE_BITS, bool) for n in self.lengths}
        pieces: dict[int, dict] = {q: defaultdict(list) for q in self.seen}
        self.own = np.zeros(1 << TABLE_BITS, bool)  # pairs of an item and a word of it
        found = defaultdict(list)
        shift = np.uint64(64 - TABLE_BITS)
        for k, own in enumerate(self.words):
            n = len(own)
            self.vocabulary[(mix(own) >> shift).astype(np.int64)] = True
            q = piece_words(n)
            starts = np.arange(n - q + 1)
            names = span_hash(prefix(own, BASES[0]), starts, starts + q, BASES[0])
            self.seen[q][(names >> shift).astype(np.int64)] = True
            for o, piece in enumerate(names.tolist()):
                pieces[q][piece, n, o].append(k)
            self.own[self._own_cells(own, np.full(n, k))] = True
            for key in embed_keys(own, np.array([0]), np.array([n]))[:, 0].tolist():
                found[key].append(k)
        #: Per piece size: sorted piece names with the item length and the offset at which they stand,
        #: and for each of them the items, from the first of ``bounds`` to the next.
        self.pieces, self.holders = {}, {}
        for q, rows_ in pieces.items():
            ranked = sorted(rows_)
            self.pieces[q] = (np.array([r[0] for r in ranked], np.uint64), np.array([r[1:] for r in ranked], np.int64).reshape(-1, 2))
            bounds = np.cumsum([0, *(len(rows_[r]) for r in ranked)])
            self.holders[q] = (bounds, np.array([k for r in ranked for k in rows_[r]], np.int64))
        self.keys = np.array(sorted(found), np.uint64)
        self.of_key = [found[k] for k in self.keys.tolist()]

    @staticmethod
    def _own_cells(names: np.ndarray, items: np.ndarray) -> np.ndarray:
        return (mix(names ^ mix(items.astype(np.uint64))) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)

    def _at_edge(self, names: np.ndarray, low: np.ndarray, high: np.ndarray, items: np.ndarray, least: np.ndarray) -> list[np.ndarray]:
        """Of the stretches [low, high) of the text, those in which ``least`` words or more may be the item's own."""
        out = []
        for a in range(0, len(low), EDGE_CHUNK):
            at, k = slice(a, a + EDGE_CHUNK), items[a:a + EDGE_CHUNK]
            size = high[at] - low[at]
            own = self.own[self._own_cells(names[concat_ranges(low[at], size)], np.repeat(k, size))]
            enough = np.add.reduceat(own, np.cumsum(size) - size, dtype=np.int64) >= least[at]
            out.append(np.stack([low[at], high[at], k])[:, enough])
        return out

    def windows(self, names: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and lengths of the windows that may lie within the distance of an item.

        Third, as columns: start, end and item of each stretch at the edge of a text that may hold the item.
        """
        shift = np.uint64(64 - TABLE_BITS)
        known = np.concatenate([[0], np.cumsum(self.vocabulary[(mix(names) >> shift).astype(np.int64)])])
        sums = prefix(names, BASES[0])
        total = len(names)
        start = np.repeat(before[:-1], np.diff(before))  # of each word's text
        stop = np.repeat(before[1:], np.diff(before))
        found, edges = [], []
        for q, table in self.seen.items():
            at = np.arange(max(0, total - q + 1))
            piece = span_hash(sums, at, at + q, BASES[0])
            at = np.flatnonzero(table[(piece >> shift).astype(np.int64)] & (at + q <= stop[:len(at)]))
            have, where = self.pieces[q]
            low, high = np.searchsorted(have, piece[at]), np.searchsorted(have, piece[at], "right")
            at = np.repeat(at, high - low)
            row = concat_ranges(low, high - low)
            n, offset = where[row].T
            spare = (EDITS * n).astype(np.int64)  # the piece may stand this much earlier or later in the window
            low, high = at - offset - spare, at - offset + n + spare
            a, b = np.maximum(low, start[at]), np.minimum(high, stop[at])
            cut = np.flatnonzero(((a > low) | (b < high)) & (b - a >= n - spare))
            bounds, items = self.holders[q]
            held = bounds[row[cut] + 1] - bounds[row[cut]]
            k, cut = items[concat_ranges(bounds[row[cut]], held)], np.repeat(cut, held)
            if len(cut):
                stretches = np.unique(np.stack([a[cut], b[cut], k, (n - spare)[cut]]), axis=1)
                edges += self._at_edge(names, *stretches)
            each = 2 * spare + 1
            begin = concat_ranges(at - offset - spare, each)
            at, n = np.repeat(at, each), np.repeat(n, each)
            ok = (begin >= start[at]) & (begin + n <= stop[at])
            begin, n = begin[ok], n[ok]
            ok = known[begin + n] - known[begin] >= n - (EDITS * n).astype(np.int64)
            found.append(begin[ok] << 20 | n[ok])
        windows = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        return windows >> 20, windows & (1 << 20) - 1, np.concatenate(edges, 1) if edges else np.zeros((3, 0), np.int64)

    def search(self, names: np.ndarray, before: np.ndarray) -> list[tuple[int, int, int, int, int, int]]:
        """(text, item_id, item_words, distance, first_word, end_word): the best match of each text and item."""
        if not self.words or not len(names):
            return []
        starts, lengths, edges = self.windows(names, before)
        candidates = set()
        for a in range(0, len(starts), CHUNK):
            s, n = starts[a:a + CHUNK], lengths[a:a + CHUNK]
            keys = embed_keys(names, s, n)
            place = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            for walk, window in zip(*np.nonzero(self.keys[place] == keys)):
                for k in self.of_key[place[walk, window]]:
                    if len(self.words[k]) == n[window]:
                        candidates.add((k, int(s[window])))
        around = [(a, b, k) for a, b, k in edges.T.tolist()]
        for k, p in candidates:
            text = int(np.searchsorted(before, p, "right")) - 1
            n, spare = len(self.words[k]), edits_allowed(len(self.words[k]))
            around.append((max(int(before[text]), p - spare), min(int(before[text + 1]), p + n + spare), k))
        regions = defaultdict(list)
        for a, b, k in sorted(around):
            own = regions[int(np.searchsorted(before, a, "right")) - 1, k]
            if own and a <= own[-1][1]:
                own[-1][1] = max(b, own[-1][1])
            else:
                own.append([a, b])
        out = []
        for (text, k), spans in regions.items():
            n = len(self.words[k])
            best = min((*best_match(self.words[k], names[a:b]), a) for a, b in spans)
            if best[0] <= edits_allowed(n):
                base = best[3] - int(before[text])
                out.append((text, self.ids[k], n, best[0], base + best[1], base + best[2]))
        return sorted(out)


def _slices(benchmark: DataFrame) -> list[Items]:
    rows: list[tuple[int, str]] = []
    size, out = 0, []
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    for row in items.orderBy("item_id", "text").toLocalIterator():
        rows.append((row.item_id, row.text))
        size += len(row.text)
        if size >= SLICE_BYTES:
            out.append(Items(rows))
            rows, size = [], 0
    return [*out, Items(rows)] if rows or not out else out


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each row of ``docs`` and item with a passage within the distance: the best such passage.

    doc_id, item_id, item_words, distance (word edits), first_word and end_word of the passage (words of
    the text, split as above).  Null and empty texts and items match
    nothing; items under ``LEAST_WORDS`` words match their exact sequence of words; of equally near passages the first counts; repeated rows are searched each; null ids
    stay null; other columns are ignored; empty tables give no rows.  The benchmark is sent to the tasks
    in slices of bounded size.  One pass over the texts per slice, without a shuffle.
    """
    spark = docs.sparkSession
    out = None
    for part in _slices(benchmark):
        items = spark.sparkContext.broadcast(part)

        def run(batches, items=items):
            for batch in batches:
                for piece in byte_balanced(batch, "text", 1 << 20):
                    found = items.value.search(*plain_words(piece.column("text")))
                    if found:
                        ids = piece.column("doc_id").to_pylist()
                        columns = list(zip(*((ids[t], *rest) for t, *rest in found)))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(c, pa.int64()) for c in columns], names=["doc_id", "item_id", "item_words", "distance", "first_word", "end_word"],
                        )

        found = texts(docs).mapInArrow(run, SCHEMA)
        out = found if out is None else out.unionByName(found)
    return out


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` without a leak, with all their columns (see ``leaks``)."""
    for part in _slices(benchmark):
        items = docs.sparkSession.sparkContext.broadcast(part)

        def keep(batches, items=items):
            for batch in batches:
                for piece in byte_balanced(batch, "text", 1 << 20):
                    mask = np.ones(piece.num_rows, bool)
                    mask[[row[0] for row in items.value.search(*plain_words(piece.column("text")))]] = False
                    yield piece.filter(pa.array(mask))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs
