"""Support counts by bitmaps over all 4^l words, for short motifs.

A task keeps one counter array of 4^l cells and adds each read's bitmap to it; only the counters are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.functions.sequence import BASES, unpack
from strandmill.operators.neighbours import prepared

MOST_BYTES = 256 << 20  # for each core


def size(l: int, d: int) -> int:  # noqa: E741
    """Bytes that a task holds at most: two layers of cells with a temporary, and the counters."""
    layers = sum(4**k for k in range(max(1, l - d + 1), l + max(1, d)))
    return 2 * layers + 4 ** (l + max(0, d - 1)) + 4 * 4**l


def fits(l: int, d: int) -> bool:  # noqa: E741
    return size(l, d) <= MOST_BYTES


def seconds(l: int, d: int) -> float:  # noqa: E741
    """About how long one read takes, however short: every layer passes over its cells some 3 k times."""
    return 1e-4 + 1e-9 * sum(3 * k * 4**k for left in range(d) for k in range(max(1, l - left), l + left + 1))


def _codes(codes: np.ndarray, k: int) -> np.ndarray:
    """The words of k bases of a read, as numbers."""
    n = len(codes) - k + 1
    value = np.zeros(max(0, n), np.int64)
    for i in range(k if n > 0 else 0):
        value = value * 4 + codes[i : i + n]
    return value


def _dense(value: np.ndarray, k: int) -> np.ndarray:
    cells = np.zeros(4**k, bool)
    cells[value] = True
    return cells.reshape((4,) * k)


def _shorter(value: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """Words of k - 1 bases: those of k without one base, for each place."""
    for i in range(k):
        yield (value >> (2 * i + 2) << (2 * i)) | (value & ((1 << 2 * i) - 1))


def _layer(sets: dict[int, np.ndarray], wanted: range) -> dict[int, np.ndarray]:
    """One more edit: sets of the wanted lengths from sets of one more and one less."""
    out = {}
    for k in wanted:
        cells = sets[k].copy() if k in sets else np.zeros((4,) * k, bool)
        if k in sets:
            for axis in range(k):
                cells |= sets[k].any(axis=axis, keepdims=True)
        if k + 1 in sets:
            for axis in range(k + 1):
                cells |= sets[k + 1].any(axis=axis)
        if k - 1 in sets:
            for axis in range(k):
                cells |= np.expand_dims(sets[k - 1], axis)
        out[k] = cells
    return out


def bitmap(seq: str, l: int, d: int) -> np.ndarray:  # noqa: E741
    """Boolean array over the words of length l in order: within d edits of a substring of the read."""
    codes = np.searchsorted(np.frombuffer(BASES.encode(), np.uint8), np.frombuffer(seq.encode(), np.uint8))
    if not d:
        return _dense(_codes(codes, l), l).reshape(-1)
    sets = {k: _dense(_codes(codes, k), k) for k in range(max(1, l - d), l + d) if k <= len(codes)}
    # The longest words only lose a base: they stay a list, as their bitmap would be the largest.
    longest = _codes(codes, l + d)
    for left in range(d - 1, -1, -1):
        sets = _layer(sets, range(max(1, l - left), l + left + 1))
        if left == d - 1:
            for shorter in _shorter(longest, l + d):
                sets[l + left].reshape(-1)[shorter] = True
    return sets[l].reshape(-1)


def supports(reads: DataFrame, l: int, d: int) -> DataFrame:  # noqa: E741
    """(w, n_reads), as the row operator gives it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(4**l, np.uint32)
        for b in batches:
            for seq in b.column(0).to_pylist():
                total += bitmap(seq, l, d)
        at = np.flatnonzero(total)
        for s in range(0, len(at), 1 << 16):
            part = at[s : s + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(total[part].astype(np.int64))], names=["code", "n"])

    counts = prepared(reads).mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n_reads"))
    return counts.select(unpack(F.col("code"), F.lit(l)).alias("w"), "n_reads")
