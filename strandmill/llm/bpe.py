"""Byte-level BPE encoding and decoding on padded matrices.

A text is cut by the vocabulary's pattern into parts, and each part is merged by itself. The distinct parts of a slice
of rows that the task hasn't met are put into matrices, one for each class of lengths (up to 2, 4, 8, ... bytes), with
-1 behind a shorter part. In each round every row finds its leftmost pair of least rank, merges it, and closes the gap;
so a round takes one column off the matrix, and rows without a pair left leave it. Only the two pairs beside a merged
one are looked up again, for all rows together, in a hash table of pairs (open addressing, numpy arrays). Decoding
joins the bytes of all ids of a slice by one gather.

A part that is a token as a whole is that token, whatever its merges give, as the library does it. A matrix takes n * n
steps for a part of n bytes; parts over ``LONG`` bytes (a text without a space or a change between letters, digits and
signs) are merged in the same order from a heap of their pairs, in n log n.

Defined cases: null text and the empty text have no ids; an id that the vocabulary lacks fails the job, null ids
decode to no bytes; control strings in a text are plain text; repeated rows stay; an empty table gives no rows;
columns to keep stay under their own names, and a result column whose name is taken gets underscores behind it.
Texts of any length are one value; a task holds at most ``SLICE`` of them and the parts of one slice.
"""

from __future__ import annotations

import base64
import functools
import heapq
from collections.abc import Iterator, Sequence

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandmill.llm import common
from strandmill.llm.bytestrings import Strings, lists, numbers
from strandmill.llm.tokens import splitter

RANKS_50K = public_tokenizers.path("byte_bpe_50k.tiktoken")
NONE = np.iinfo(np.int32).max
LONG, CELLS, SLICE, CACHED_PARTS = 1024, 1 << 21, 64, 500_000


class Pairs:
    """Pair of ids -> id of the merged token, for arrays of pairs; NONE where there is no such token."""

    def __init__(self, pairs: np.ndarray, merged: np.ndarray):
        self.bits = max(4, int(4 * len(pairs)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, NONE, np.int32)
        left, at = np.arange(len(pairs)), self._slots(pairs)
        while len(left):
            free = left[self.keys[at] < 0]
            slots, first = np.unique(at[self.keys[at] < 0], return_index=True)
            self.keys[slots], self.values[slots] = pairs[free[first]], merged[free[first]]
            out = self.keys[at] != pairs[left]
            left, at = left[out], (at[out] + 1) & (len(self.keys) - 1)

    def _slots(self, pairs: np.ndarray) -> np.ndarray:
        return ((pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """a and b of one shape; a negative id has no pair."""
        shape, pairs = a.shape, ((a.astype(np.int64) << 32) | b.astype(np.int64)).ravel()
        found = np.full(pairs.shape, NONE, np.int32)
        left = np.flatnonzero((a.ravel() >= 0) & (b.ravel() >= 0))
        at = self._slots(pairs[left])
        while len(left):
            keys = self.keys[at]
            same = keys == pairs[left]
            found[left[same]] = self.values[at[same]]
            out = ~same & (keys >= 0)
            left, at = left[out], (at[out] + 1) & (len(self.keys) - 1)
        return found.reshape(shape)


class Vocabulary:
    def __init__(self, path: str):
        with open(path, "rb") as file:
            self.ids = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        tokens = {i: t for t, i in self.ids.items()}
        self.size = max(tokens) + 1
        self.held = np.array([i in tokens for i in range(self.size)])
        self.strings = Strings(tokens.get(i, b"") for i in range(self.size))
        self.single = np.array([self.ids[bytes([b])] for b in range(256)], np.int32)
        get, found = self.ids.get, []
        for token, i in self.ids.items():
            for cut in range(1, len(token)):
                a, b = get(token[:cut]), get(token[cut:])
                if a is not None and b is not None:
                    found.append((a << 32 | b, i))
        self.pairs = Pairs(*np.array(found, np.int64).reshape(-1, 2).T)

    def decoded(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(ids) and not (ids.min() >= 0 and ids.max() < self.size and self.held[ids].all()):
            raise ValueError("an id is not in the vocabulary")
        return self.strings.joined(ids)

    def merged(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, one after the other, and how many each has; rows are padded with -1."""
        done, who = np.full(rows.shape, -1, np.int32), np.arange(len(rows))
        ranks = self.pairs(rows[:, :-1], rows[:, 1:])
        while len(who):
            width, each = rows.shape[1], np.arange(len(who))
            at = ranks.argmin(1) if width > 1 else np.zeros(len(who), np.int64)  # the leftmost of the least
            best = ranks[each, at] if width > 1 else np.full(len(who), NONE, np.int32)
            going = best < NONE
            if not going.all():
                done[who[~going], :width] = rows[~going]
                rows, ranks, who, at, best = rows[going], ranks[going], who[going], at[going], best[going]
                each = np.arange(len(who))
                if not len(who):
                    break
            columns, here = np.arange(width - 1), at[:, None]
            rows = np.take_along_axis(rows, columns + (columns > here), 1)
            rows[each, at] = best
            ranks = np.take_along_axis(ranks, columns[:-1] + (columns[:-1] >= here), 1)
            before, after = np.flatnonzero(at > 0), np.flatnonzero(at < width - 2)
            i = at[before]
            ranks[before, i - 1] = self.pairs(rows[before, i - 1], rows[before, i])
            i = at[after]
            ranks[after, i] = self.pairs(rows[after, i], rows[after, i + 1])
        return done[done >= 0], (done >= 0).sum(1)

    def merged_long(self, part: bytes) -> np.ndarray:
        """As ``merged``, for one long part, by a heap of its pairs."""
        ids = self.single[np.frombuffer(part, np.uint8)]
        ranks = self.pairs(ids[:-1], ids[1:])
        here = np.flatnonzero(ranks < NONE)
        heap = list(zip(ranks[here].tolist(), here.tolist(), (here + 1).tolist()))
        heapq.heapify(heap)
        ids, n, get, token = ids.tolist(), len(part), self.ids.get, lambda a, b: part[a:b]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            rank, a, b = heapq.heappop(heap)
            # A symbol of which one end moved since has another id or is gone.
            if ids[a] < 0 or after[a] != b or get(token(a, after[b])) != rank:
                continue
            ids[a], ids[b], after[a] = rank, -1, after[b]
            if after[b] < n:
                before[after[b]] = a
                if (new := get(token(a, after[after[b]]))) is not None:
                    heapq.heappush(heap, (new, a, after[b]))
            if before[a] >= 0 and (new := get(token(before[a], after[a]))) is not None:
                heapq.heappush(heap, (new, before[a], a))
        return np.array([i for i in ids if i >= 0], np.int32)

    def encoded_parts(self, parts: Sequence[bytes]) -> list[bytes]:
        """The ids of each part, packed."""
        out, by_class = [b""] * len(parts), {}
        for i, part in enumerate(parts):
            whole = self.ids.get(part)
            if whole is not None:
                out[i] = whole.to_bytes(4, "little")
            elif len(part) > LONG:
                out[i] = self.merged_long(part).astype("<i4").tobytes()
            elif part:
                by_class.setdefault((len(part) - 1).bit_length(), []).append(i)
        for k, members in by_class.items():
            step = max(1, CELLS >> k)
            for s in range(0, len(members), step):
                some = members[s : s + step]
                length = np.array([len(parts[i]) for i in some])
                rows = np.full((len(some), length.max()), -1, np.int32)
                rows[np.arange(rows.shape[1]) < length[:, None]] = self.single[np.frombuffer(b"".join(parts[i] for i in some), np.uint8)]
                ids, count = self.merged(rows)
                packed, ends = ids.astype("<i4").tobytes(), (4 * count.cumsum()).tolist()
                for i, a, b in zip(some, [0, *ends], ends):
                    out[i] = packed[a:b]
        return out


@functools.lru_cache(maxsize=2)
def vocabulary(path: str = RANKS_50K) -> Vocabulary:
    return Vocabulary(path)


class Encoder:
    """Texts -> packed ids; keeps the ids of the parts it has met, in a table that is emptied at a fixed size."""

    def __init__(self, path: str, pattern: str):
        self.vocabulary, self.split, self.known = vocabulary(path), splitter(pattern), {}

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        parts = [self.split(t) if t else [] for t in texts]
        wanted = set().union(*parts)
        if len(self.known) + len(wanted) > CACHED_PARTS:
            self.known = {}
        new = [p for p in wanted if p not in self.known]
        self.known.update(zip(new, self.vocabulary.encoded_parts([p.encode() for p in new])))
        return [b"".join(map(self.known.__getitem__, p)) for p in parts]


@functools.lru_cache(maxsize=2)
def encoder(path: str = RANKS_50K, pattern: str = public_tokenizers.PATTERN) -> Encoder:
    return Encoder(path, pattern)


def _extended(rows: DataFrame, column: str, keep: Sequence[str] | None, name: str, kind: T.DataType, make) -> DataFrame:
    """The columns to keep (all others by default) and a new one made of arrays of ``column``."""
    keep = [c for c in rows.columns if c != column] if keep is None else list(keep)
    own = rows.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{column}`"))
    names = [*keep, common.fresh(keep, name)]
    schema = T.StructType([*own.schema.fields[:-1], T.StructField(names[-1], kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches, SLICE):
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], make(b.column(len(names) - 1))], names=names)

    return own.mapInArrow(run, schema)


def encode(rows: DataFrame, text_col: str = "text", keep: Sequence[str] | None = None, path: str = RANKS_50K, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """The columns to keep and ``ids``, an array of ints."""
    return _extended(rows, text_col, keep, "ids", T.ArrayType(T.IntegerType()), lambda texts: lists(encoder(path, pattern)(texts.to_pylist())))


def decode(rows: DataFrame, ids_col: str = "ids", keep: Sequence[str] | None = None, path: str = RANKS_50K) -> DataFrame:
    """The columns to keep and ``decoded``, the bytes of the ids."""

    def made(column: pa.ListArray) -> pa.Array:
        ids, count = numbers(column)
        data, ends = vocabulary(path).decoded(ids)
        cuts = np.concatenate(([0], ends))[np.concatenate(([0], count.cumsum()))].astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(count), [None, pa.py_buffer(cuts), pa.py_buffer(np.ascontiguousarray(data))])

    return _extended(rows, ids_col, keep, "decoded", T.BinaryType(), made)


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = encode(common.table(spark, sf_dir, "documents"), keep=("doc_id",))
    said = F.array_join(F.col("ids").cast("array<string>"), " ")
    ids = ids.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(said.cast("binary"), 256).alias("ids_sha256"), "ids")
    return decode(ids).withColumn("decoded_sha256", F.sha2("decoded", 256)).drop("decoded")
