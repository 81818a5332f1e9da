"""64-bit hashes of the words of texts, in numpy; the same in every task.

A word is a run of bytes other than space and \\x09-\\x0D. Hashes are multilinear: each place of a word has a random
64-bit key of its own, and a word is the sum of its bytes times their keys. Two given words that differ collide with
probability 2^-56 at most over the keys (their difference times an unstructured key must be 0 modulo 2^64), whatever
their form; sums over powers of one base would not do, as words exist that collide for every base. ``seed`` draws the
keys, so two seeds give independent hashes, 112 bits together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

CHUNK = 1 << 21  # bytes that are hashed at once
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_KEYS: dict[int, np.ndarray] = {}
WORDS, RUNS, SECOND = 0, 1, 2  # seeds: bytes of words, words of runs, and an independent pair of both


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (splitmix64's finish)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def keys(n: int, seed: int) -> np.ndarray:
    """``n`` odd random keys, one for each place; longer requests keep the keys of shorter ones."""
    held = _KEYS.get(seed, np.empty(0, np.uint64))
    if len(held) < n:
        places = np.arange(max(2 * n, 1024), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        held = _KEYS[seed] = mix(places + mix(np.full(1, seed + 1, np.uint64))) | np.uint64(1)
    return held[:n]


def _hash_words(blob: bytes, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and starts of the words of one stretch."""
    a = np.frombuffer(blob, np.uint8)
    gap = np.concatenate(([True], _SPACE[a], [True]))
    starts = np.flatnonzero(gap[:-1] & ~gap[1:])
    if not len(starts):
        return np.empty(0, np.uint64), starts
    lengths = np.flatnonzero(~gap[:-1] & gap[1:]) - starts
    inside = np.flatnonzero(~gap[1:-1])
    first = np.cumsum(lengths) - lengths
    place = np.arange(len(inside)) - np.repeat(first, lengths)
    value = (a[inside].astype(np.uint64) + np.uint64(1)) * keys(int(lengths.max()), seed)[place]
    return mix(np.add.reduceat(value, first) + lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), starts


def hash_words(texts: list[bytes], seed: int = WORDS) -> Iterator[np.ndarray]:
    """The word hashes of each text, in order; memory is bounded by CHUNK or the longest word."""
    at = 0
    while at < len(texts):
        if len(texts[at]) > CHUNK:
            yield np.concatenate([_hash_words(part, seed)[0] for part in _parts(texts[at])])
            at += 1
            continue
        end, size = at, 0
        while end < len(texts) and size + len(texts[end]) <= CHUNK:
            size += len(texts[end]) + 1
            end += 1
        hashes, starts = _hash_words(b" ".join(texts[at:end]), seed)
        offsets = np.cumsum([len(t) + 1 for t in texts[at:end]])
        yield from np.split(hashes, np.searchsorted(starts, offsets[:-1]))
        at = end


def _parts(text: bytes) -> Iterator[bytes]:
    """A long text cut at white space."""
    at = 0
    while at < len(text):
        end = min(len(text), at + CHUNK)
        while end < len(text) and not _SPACE[text[end]]:
            end += 1
        yield text[at:end]
        at = end


def runs(hashes: np.ndarray, width: int, seed: int = RUNS) -> np.ndarray:
    """Hashes of all ``width`` consecutive words."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    own, total = keys(width, seed), np.zeros(n, np.uint64)
    for i in range(width):
        total += hashes[i : i + n] * own[i]
    return mix(total + np.uint64(width))
