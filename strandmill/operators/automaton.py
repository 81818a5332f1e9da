"""Words within an edit distance of given words, by walking the distance automaton of each.

The state after some bases of a word w is one row of the table of edit distances against x, written as bits: number e
has bit i where the first i bases of x are within e edits. All (x, prefix) pairs of a chunk advance together by
shifts, ANDs and ORs, and keep only bits from which the end of x can be reached, so every pair that is left leads to a
neighbour, and each neighbour of x comes once, however many scripts of edits make it.

Short words come again in read after read, so their neighbours are kept: a worker walks each of them once, and a read is then
a lookup of its words, whose neighbours are made distinct and counted many reads at a time.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.functions.sequence import BASES

PAIRS = 1 << 16  # pairs that advance at once
TOGETHER = 2048  # bases of reads that are walked together
LOOKED_UP = 1 << 16  # bases of reads whose words are looked up together
EXPANDED = 1 << 21  # neighbours of them that are held at once
CELLS = 1 << 21  # cells of reads and words that are marked at once; they stay in a core's cache
CELLS_EACH = 64  # cells for each neighbour up to which marking is cheaper than sorting
LONGEST_KEPT = 9  # bases of words whose neighbours are kept; there are 4 to the power of this of the longest
_ONE = np.uint64(1)


@functools.lru_cache(16)
def _useful(l: int, d: int) -> np.ndarray:  # noqa: E741
    """Bits from which the end of x can be reached, by depth, edits so far and length of x; none for lengths over l + d."""
    out = np.zeros((l + 1, d + 1, l + d + 2), np.uint64)
    for j in range(l + 1):
        for e in range(d + 1):
            for m in range(l + d + 1):
                out[j, e, m] = sum(1 << i for i in range(m + 1) if abs((m - i) - (l - j)) <= d - e)
    return out


def near(words: list[str], l: int, d: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:  # noqa: E741
    """(places in ``words``, codes of l bases within d edits of those); words have 1 to 62 bases."""
    size = np.array([len(w) for w in words], np.int64)
    said, ends = np.frombuffer("".join(words).encode("ascii", "replace"), np.uint8), np.cumsum(size)
    bits = _ONE << (np.arange(1, len(said) + 1) - np.repeat(ends - size, size)).astype(np.uint64)
    sums = np.zeros(len(said) + 1, np.uint64)
    masks = np.zeros((4, len(words)), np.uint64)
    for base, letter in enumerate(BASES.encode()):
        np.cumsum(np.where(said == letter, bits, 0), out=sums[1:])  # whatever overflows cancels out
        masks[base] = sums[ends] - sums[ends - size]
    useful = _useful(l, d)
    size = np.minimum(size, useful.shape[2] - 1)  # longer words have no neighbours
    start = np.array([(2 << e) - 1 for e in range(d + 1)], np.uint64)[:, None] & useful[0][:, size]
    alive = np.flatnonzero((start != 0).any(0))

    def down(at: np.ndarray, codes: np.ndarray, rows: np.ndarray, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if depth == l:
            yield at, codes
            return
        if len(at) > PAIRS:
            for s in range(0, len(at), PAIRS):
                yield from down(at[s : s + PAIRS], codes[s : s + PAIRS], rows[:, s : s + PAIRS], depth)
            return
        kids = []
        for base in range(4):
            mask, new = masks[base][at], np.empty_like(rows)
            new[0] = (rows[0] << _ONE) & mask
            for e in range(1, d + 1):
                new[e] = ((rows[e] << _ONE) & mask) | rows[e - 1] | ((rows[e - 1] | new[e - 1]) << _ONE)
            kept = np.zeros(len(at), bool)
            for e in range(d + 1):
                new[e] &= useful[depth + 1, e][size[at]]
                kept |= new[e] != 0
            kids.append((at[kept], codes[kept] * 4 + base, new[:, kept]))
        yield from down(*(np.concatenate(x, axis=-1) for x in zip(*kids)), depth + 1)

    for s in range(0, len(alive), PAIRS >> 4):
        some = alive[s : s + (PAIRS >> 4)]
        yield from down(some, np.zeros(len(some), np.int64), start[:, some], 0)


def neighbourhood(words: DataFrame, l: int, d: int) -> DataFrame:  # noqa: E741
    """(x, code): all words of length l within d edits of the words x, each once for each row of x; null and empty x have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, codes in near(b.column(0).to_pylist(), l, d):
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(codes)], names=["x", "code"])

    return words.where((F.length("x") > 0) & (F.abs(F.length("x") - l) <= d)).select("x").mapInArrow(run, "x string, code long")


class Kept:
    """Neighbours of words by their packed numbers (with a 1 before the first base), walked when a word is first met.

    Words of a length have rows of one width, the most neighbours that one of them has; shorter rows say their first neighbour again.
    """

    def __init__(self, l: int, d: int):  # noqa: E741
        self.l, self.d = l, d
        self.lengths = range(max(1, l - d), l + d + 1)
        self.known = np.zeros(2 * 4 ** (l + d), bool)
        self.rows = {k: np.empty((4**k, 0), np.int32) for k in self.lengths}

    def meet(self, words: np.ndarray) -> None:
        new = _distinct(words[~self.known[words]])
        for k, own in self._by_length(new):
            for s in range(0, len(own), PAIRS >> 4):
                self._walk(new[own[s : s + (PAIRS >> 4)]], k)
        self.known[new] = True

    def _by_length(self, words: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(length, places of the words of that length)"""
        for k in self.lengths:
            yield k, np.flatnonzero((words >= 4**k) & (words < 2 * 4**k))

    def _walk(self, words: np.ndarray, k: int) -> None:
        said = np.frombuffer(BASES.encode(), np.uint8)[(words[:, None] >> 2 * np.arange(k - 1, -1, -1)) & 3]
        found = list(near([bytes(w).decode() for w in said], self.l, self.d))
        at, codes = (np.concatenate([f[i] for f in found]) for i in range(2))
        count = np.bincount(at, minlength=len(words))
        ends, rows = np.cumsum(count), self.rows[k]
        if (more := int(count.max()) - rows.shape[1]) > 0:
            rows = self.rows[k] = np.concatenate((rows, np.repeat(rows[:, :1], more, 1) if rows.shape[1] else np.zeros((len(rows), more), np.int32)), 1)
        places = np.arange(rows.shape[1])
        places = np.where(places < count[:, None], places, 0) + (ends - count)[:, None]
        rows[words - 4**k] = codes[np.argsort(at, kind="stable")][places]

    def add(self, seqs: list[str], counts: np.ndarray) -> None:
        """Add to the counts of all words how many of the reads each is near."""
        owner, words = _own_words(seqs, self.l, self.d)
        self.meet(words)
        size = np.zeros(len(words), np.int64)
        for k, own in self._by_length(words):
            size[own] = self.rows[k].shape[1]
        before = np.cumsum(size) - size
        starts = np.flatnonzero(np.diff(owner, prepend=-1))
        ends = np.append(starts[1:], len(words))
        own = np.repeat(np.arange(len(starts)), ends - starts)
        marked = len(starts) * len(counts) <= CELLS_EACH * size.sum()
        parts = np.arange(len(starts)) // max(1, min(255, CELLS // len(counts))) if marked else before[starts] // EXPANDED
        for first in np.flatnonzero(np.diff(parts, prepend=-1)):
            last = np.searchsorted(parts, parts[first], "right") - 1
            some = slice(starts[first], ends[last])
            (self._mark if marked or first == last else self._sort)(own[some] - first, words[some], counts)

    def _mark(self, owner: np.ndarray, words: np.ndarray, counts: np.ndarray) -> None:
        """Of up to 255 reads, by a cell for each read and word."""
        seen = np.zeros((int(owner[-1]) + 1) * len(counts), bool)
        for k, own in self._by_length(words):
            for s in range(0, len(own), PAIRS >> 2):
                seen[self._keys(owner, words, own[s : s + (PAIRS >> 2)], k, len(counts))] = True
        counts += seen.view(np.uint8).reshape(-1, len(counts)).sum(0, dtype=np.uint8)

    def _keys(self, owner: np.ndarray, words: np.ndarray, own: np.ndarray, k: int, n: int) -> np.ndarray:
        """A number below n for each read and neighbour, after those of the reads before it."""
        keys = self.rows[k].take(words[own] - 4**k, 0).astype(np.int64)
        keys += (owner[own] * n)[:, None]
        return keys.ravel()

    def _sort(self, owner: np.ndarray, words: np.ndarray, counts: np.ndarray) -> None:
        """Of reads that are near few words each."""
        keys = _distinct(np.concatenate([self._keys(owner, words, own, k, len(counts)) for k, own in self._by_length(words)]))
        counts += np.bincount(keys & (len(counts) - 1), minlength=len(counts))


def _distinct(keys: np.ndarray) -> np.ndarray:
    """In order; plain sorting is several times faster here than ``np.unique``, which hashes."""
    keys = np.sort(keys)
    return keys[np.append(True, keys[1:] != keys[:-1])] if len(keys) else keys


def _own_words(seqs: list[str], l: int, d: int) -> tuple[np.ndarray, np.ndarray]:  # noqa: E741
    """(read, packed word) for the distinct substrings of l - d to l + d bases of each read, by read."""
    digits = np.searchsorted(np.frombuffer(BASES.encode(), np.uint8), np.frombuffer("".join(seqs).encode(), np.uint8))
    length = np.array([len(s) for s in seqs], np.int64)
    reads, left = np.repeat(np.arange(len(seqs)), length), np.repeat(np.cumsum(length), length) - np.arange(len(digits))
    keys, packed = [], np.ones(len(digits), np.int64)
    for k in range(1, l + d + 1):
        packed = packed[: len(digits) - k + 1] * 4 + digits[k - 1 :]
        if k >= l - d:
            inside = left[: len(packed)] >= k
            keys.append((reads[: len(packed)][inside] << 2 * (l + d) + 1) + packed[inside])
    found = _distinct(np.concatenate(keys))
    return found >> 2 * (l + d) + 1, found & ((1 << 2 * (l + d) + 1) - 1)


@functools.lru_cache(2)
def _kept(l: int, d: int) -> Kept:  # noqa: E741
    return Kept(l, d)


def read_counts(reads: DataFrame, l: int, d: int) -> DataFrame:  # noqa: E741
    """(code, n): in how many reads (seq) of a task each word of length l has a substring within d edits, for l + d up to ``LONGEST_KEPT``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, counts = _kept(l, d), np.zeros(4**l, np.int64)
        held, bases = [], 0
        for b in batches:
            for s in range(0, len(b), 256):
                for seq in b.column(0).slice(s, 256).to_pylist():
                    held.append(seq)
                    bases += len(seq)
                    if bases >= LOOKED_UP or len(held) >= LOOKED_UP:
                        kept.add(held, counts)
                        held, bases = [], 0
        kept.add(held, counts)
        codes = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(counts[codes])], names=["code", "n"])

    return reads.select("seq").mapInArrow(run, "code long, n long")


def read_words(reads: DataFrame, l: int, d: int) -> DataFrame:  # noqa: E741
    """(code) for each read (seq) and word of length l within d edits of one of its substrings, once for each read."""

    def own(seqs: list[str]) -> Iterator[np.ndarray]:
        """Of some reads together, told apart by what is added to the codes."""
        words = [(w, i) for i, seq in enumerate(seqs) for w in sorted({seq[s : s + k] for k in range(max(1, l - d), l + d + 1) for s in range(len(seq) - k + 1)})]
        owner, found, size = np.array([i for _, i in words], np.int64), [], 0
        for at, codes in near([w for w, _ in words], l, d):
            found.append(np.unique(codes + (owner[at] << 2 * l)))
            size += len(found[-1])
            if size > 1 << 22:
                found = [np.unique(np.concatenate(found))]
                size = len(found[0])
        if found:
            codes = np.unique(np.concatenate(found)) & ((1 << 2 * l) - 1)
            for s in range(0, len(codes), 1 << 16):
                yield codes[s : s + (1 << 16)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held, bases = [], 0
            for i, seq in enumerate(b.column(0)):
                held.append(seq.as_py())
                bases += len(held[-1])
                if bases >= TOGETHER or len(held) >= most or i == len(b) - 1:
                    for codes in own(held):
                        yield pa.RecordBatch.from_arrays([pa.array(codes)], names=["code"])
                    held, bases = [], 0

    most = 1 << min(10, max(0, 62 - 2 * l))  # reads whose numbers fit above a code
    return reads.select("seq").mapInArrow(run, "code long")
