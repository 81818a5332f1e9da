"""Motif search by one walk over prefixes of words, compared with all reads at once.

A read is cut into segments of up to 63 bases that overlap by the longest substring a word can match, so that each
segment is one 64-bit number. For a prefix of a word and e edits, bit i of a segment's number tells whether the prefix
is within e edits of a substring that ends at base i. One more base changes these numbers by shifts, ANDs and ORs
only; they are numpy arrays over prefixes x segments. The walk goes down from prefixes to words, some hundreds of
prefixes at a time, and leaves a prefix as soon as it is near no substring, or misses more reads than a motif may
miss. So each word is met once, however many ways of editing lead to it; no neighbourhood is written out; and memory
is that of one chunk for each depth, whatever the length of words.

The words walked over are all words of length l, or given ones (as sorted numbers). A cell of the grid read blocks x
prefix shards is one unit of Spark's work: with few reads many shards keep all cores busy, with many reads there is one
shard and reads stay where they are. Only counts by word are shuffled, added up before.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandmill.functions.sequence import BASES, encoded, pack, unpack
from strandmill.operators.neighbours import LONGEST, prepared
from strandmill.sources.reads import stored

SPAN = 63  # bases of a segment; bit 0 stands before the first
BLOCK = 1024  # segments of a block of reads
CHUNK_BYTES = 1 << 20  # of the numbers of one chunk of prefixes
SHARD_WORDS = 1 << 16  # given words that a shard has about at most
FIRST_GROUP, GROWTH = 64, 16  # reads of the first round of a search, and how much more each later one has
GROUPS = 1024  # blocks that a task fills at once
DRAWS = 1 << 40
ANY = np.iinfo(np.int64).max
_ONE = np.uint64(1)


def fits(l: int, d: int) -> bool:  # noqa: E741
    return l <= LONGEST and l + d <= 48


def seconds(l: int, d: int, bases: float) -> float:  # noqa: E741
    """About how long one read of so many bases takes."""
    prefixes = sum(min(4**k, max(1.0, bases) * min(4**k, (8 * (k + d) + 5) ** d)) for k in range(1, l + 1))
    return 1e-9 * prefixes * segments(bases, l, d) * (2 + 7 * d)


def segments(bases: float, l: int, d: int) -> int:  # noqa: E741
    return 1 + max(0, math.ceil((bases - SPAN) / (SPAN + 1 - l - d)))


class Block:
    """Reads as numbers: for each base, the places of a segment that hold it."""

    def __init__(self, seqs: list[str], l: int, d: int):  # noqa: E741
        step, text = SPAN + 1 - l - d, np.frombuffer("".join(seqs).encode(), np.uint8)
        length = np.array([len(s) for s in seqs], np.int64)
        count = np.where(length > 0, 1 + np.maximum(0, -(-(length - SPAN) // step)), 0)
        self.owner = np.repeat(np.arange(len(seqs)), count)
        self.offset = (np.arange(len(self.owner)) - np.repeat(count.cumsum() - count, count)) * step
        places = (np.repeat(length.cumsum() - length, count) + self.offset)[:, None] + np.arange(SPAN)
        inside = np.arange(SPAN) < (length[self.owner] - self.offset)[:, None]
        codes = np.append(np.searchsorted(np.frombuffer(BASES.encode(), np.uint8), text), 4)
        cells = np.where(inside, codes[np.minimum(places, len(text))], 4)
        self.masks = np.stack([self._numbers(cells == c) for c in range(4)])
        self.valid = self._numbers(cells < 4)
        self.starts = np.flatnonzero(np.diff(self.owner, prepend=-1))
        self.reads, self.n = self.owner[self.starts], len(self.starts)  # without those that have no bases

    @staticmethod
    def _numbers(bits: np.ndarray) -> np.ndarray:
        wide = np.zeros((len(bits), 64), bool)
        wide[:, 1:] = bits
        return np.packbits(wide, axis=1, bitorder="little").view(np.uint64).reshape(-1)

    def root(self, d: int) -> np.ndarray:
        return np.broadcast_to(self.valid | _ONE, (d + 1, 1, len(self.valid))).copy()

    def extended(self, near: np.ndarray, base: int, part: slice = slice(None)) -> np.ndarray:
        """The numbers (edits, prefixes, segments) of the prefixes with one more base."""
        out, mask = np.empty_like(near), self.masks[base][part]
        np.left_shift(near[0], _ONE, out=out[0])
        out[0] &= mask
        for e in range(1, len(near)):
            other = near[e - 1] | out[e - 1]
            other <<= _ONE
            other |= near[e - 1]
            np.left_shift(near[e], _ONE, out=out[e])
            out[e] &= mask
            out[e] |= other
        return out

    def hits(self, near: np.ndarray, part: slice = slice(None)) -> np.ndarray:
        """(prefixes, reads): whether some substring is near; of the segments of some reads in a row, if so asked."""
        found, owner = near & self.valid[part], self.owner[part]
        if len(owner) and (owner[1:] == owner[:-1]).any():
            found = np.bitwise_or.reduceat(found, np.flatnonzero(np.diff(owner, prepend=-1)), axis=1)
        return found != 0

    def groups(self) -> list[slice]:
        """Segments by reads: the first two, the next six, all others."""
        ends = [int(self.starts[n]) if n < self.n else len(self.valid) for n in (2, 8, self.n)]
        return [slice(s, e) for s, e in zip([0, *ends], ends) if s < e]


def _levels(words: np.ndarray | None, l: int) -> list[np.ndarray] | None:  # noqa: E741
    return None if words is None else [np.unique(words >> (2 * (l - k))) for k in range(l + 1)]


def walk(block: Block, l: int, d: int, misses: int = ANY, prefix: int = 0, depth: int = 0, words: np.ndarray | None = None, near_too: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | None]]:  # noqa: E741
    """(codes, numbers of reads, near numbers if asked for) of words under a prefix that are near all reads of the block but ``misses``, and near one at least.

    Once nearly all prefixes of a chunk fall out, reads are looked at in groups, and a prefix that one group rules out
    meets no later one.
    """
    most = max(8, CHUNK_BYTES // max(1, 8 * (d + 1) * len(block.valid)))
    levels, groups = _levels(words, l), block.groups()
    Found = tuple[np.ndarray, np.ndarray, np.ndarray | None]

    def child(near: np.ndarray, codes: np.ndarray, depth: int, base: int, sparse: bool) -> Found:
        wanted = near_too or depth + 1 < l
        new, at = codes * 4 + base, np.arange(len(codes))
        if levels is not None:
            known = levels[depth + 1]
            at = at[known[np.minimum(np.searchsorted(known, new), len(known) - 1)] == new]
        if not sparse:
            made = block.extended(near if len(at) == len(codes) else near[:, at], base)
            found = block.hits(made[-1]).sum(1)
            kept = found >= max(1, block.n - misses)
            if kept.all():
                return new[at], found, made
            return new[at[kept]], found[kept], made[:, kept] if wanted else None
        found, seen, parts = np.zeros(len(at), np.int64), 0, []
        for part in groups:
            made = block.extended(near[:, at, part], base, part)
            hits = block.hits(made[-1], part)
            found, seen = found + hits.sum(1), seen + hits.shape[1]
            kept = found >= max(seen == block.n, seen - misses)
            at, found, parts = at[kept], found[kept], [x[:, kept] for x in (*parts, made)] if wanted else []
            if not len(at):
                break
        return new[at], found, np.concatenate(parts, axis=2) if parts else None

    def down(near: np.ndarray, codes: np.ndarray, depth: int, sparse: bool) -> Iterator[Found]:
        held, size, kept = [], 0, 0
        for base in range(4):
            new, found, made = child(near, codes, depth, base, sparse)
            kept += len(new)
            if not len(new):
                continue
            if depth + 1 == l:
                yield new, found, made
                continue
            if held and size + len(new) > most:
                yield from down(*_together(held), depth + 1, misses < block.n and 8 * kept < (base + 1) * len(codes))
                held, size = [], 0
            held.append((made, new))
            size += len(new)
        if held:
            yield from down(*_together(held), depth + 1, misses < block.n and 2 * kept < len(codes))

    if not block.n or (words is not None and not len(words)):
        return
    near, codes, found = block.root(d), np.zeros(1, np.int64), None
    for k in range(depth):  # to the prefix itself
        codes, found, near = child(near, codes, k, prefix >> (2 * (depth - 1 - k)) & 3, False)
        if not len(codes):
            return
    if depth == l:
        yield codes, found, near
    else:
        yield from down(near, codes, depth, False)


def _together(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if len(parts) == 1:
        return parts[0]
    return np.concatenate([near for near, _ in parts], axis=1), np.concatenate([codes for _, codes in parts])


def blocks(reads: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, l, d, seqs): blocks of up to about ``BLOCK`` segments of reads (by, l, d, seq) that share the columns before, made where the reads are."""
    names = [*by, "l", "d", "seqs"]
    own = reads.select(*by, "l", "d", "seq")
    schema = T.StructType([*own.schema.fields[:-1], T.StructField("seqs", T.ArrayType(T.StringType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}
        sizes: dict[tuple, int] = {}
        kinds = []

        def row(key: tuple) -> pa.RecordBatch:
            sizes.pop(key)
            return pa.RecordBatch.from_arrays([*(pa.array([k], t) for k, t in zip(key, kinds)), pa.array([held.pop(key)], pa.list_(pa.string()))], names=names)

        for b in batches:
            kinds = [f.type for f in list(b.schema)[:-1]]
            for s in range(0, len(b), 256):
                for *key, seq in zip(*(c.to_pylist() for c in b.slice(s, 256).columns)):
                    key = tuple(key)
                    held.setdefault(key, []).append(seq)
                    sizes[key] = sizes.get(key, 0) + segments(len(seq), *key[-2:])
                    if sizes[key] >= BLOCK:
                        yield row(key)
                    elif len(held) > GROUPS:
                        yield row(max(sizes, key=sizes.get))
        for key in list(held):
            yield row(key)

    return own.mapInArrow(run, schema)


def _sharded(made: DataFrame, depth: int, cores: int, tasks: int) -> DataFrame:
    """Each block for each prefix of ``depth`` bases (of all but one base of a shorter word); dealt evenly, unless the reads' own tasks are enough."""
    made = made.withColumn("depth", F.least(F.lit(depth), F.col("l") - 1))
    if not depth and tasks >= cores:
        return made.withColumn("shard", F.lit(0).cast("long"))
    last = F.expr("shiftleft(1L, 2 * depth)") - 1
    return made.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), last))).repartition(max(4 * cores, tasks))


def letters(codes: np.ndarray, l: int) -> pa.Array:  # noqa: E741
    """Words of l bases from their codes."""
    data = np.frombuffer(BASES.encode(), np.uint8)[(codes[:, None] >> 2 * np.arange(l - 1, -1, -1)) & 3]
    return pa.Array.from_buffers(pa.string(), len(codes), [None, pa.py_buffer(np.arange(0, (len(codes) + 1) * l, l, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def _counts(cells: DataFrame, by: tuple[str, ...] = (), misses: int = ANY, once: bool = False) -> DataFrame:
    """(by, l, code, n_reads) of cells (by, l, d, seqs, depth, shard, words); words is null where all are asked for.

    A word that misses more than ``misses`` reads of one block (or what its column ``misses`` says) is out; its count of
    the other blocks can't reach all reads but so many. ``once``: there is one block, so each word comes once, and is
    given as (by, w, n_reads) without a shuffle.
    """
    own = cells.select(*by, "l", "d", "seqs", "depth", "shard", "words" if "words" in cells.columns else F.lit(None).cast("array<long>").alias("words"))
    word = T.StructField("w", T.StringType()) if once else T.StructField("code", T.LongType())
    schema = T.StructType([*own.schema.fields[: len(by) + 1], word, T.StructField("n", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(len(b)):
                l, d, seqs, depth, shard = (b.column(len(by) + k)[i].as_py() for k in range(5))  # noqa: E741
                words = b.column(len(by) + 5)[i]
                most = b.column(by.index("misses"))[i].as_py() if "misses" in by else misses
                if (empty := seqs.count("")) > most:
                    continue
                held, size = [], 0
                for codes, found, _ in walk(Block(seqs, l, d), l, d, most - empty, shard, depth, words.values.to_numpy() if words.is_valid else None):
                    held.append((codes, found))
                    size += len(codes)
                    if size > 1 << 16:
                        yield told(b, i, held)
                        held, size = [], 0
                if held:
                    yield told(b, i, held)

    def told(b: pa.RecordBatch, i: int, held: list) -> pa.RecordBatch:
        codes, found = (np.concatenate(x) for x in zip(*held))
        keys = b.slice(i, 1).take(pa.array(np.zeros(len(codes), np.int64)))
        said = letters(codes, keys.column(len(by))[0].as_py()) if once else pa.array(codes)
        return pa.RecordBatch.from_arrays([*keys.columns[: len(by) + 1], said, pa.array(found)], names=schema.names)

    if once:
        return own.mapInArrow(run, schema).select(*by, "w", F.col("n").alias("n_reads"))
    return own.mapInArrow(run, schema).groupBy(*by, "l", "code").agg(F.sum("n").alias("n_reads"))


@dataclass(frozen=True)
class Size:
    reads: int
    bases: int
    tasks: int

    def segments(self, l: int, d: int) -> int:  # noqa: E741
        return self.reads * segments(self.bases / max(1, self.reads), l, d)

    def depth(self, l: int, d: int, cores: int) -> int:  # noqa: E741
        """How many bases the prefixes of shards have, so that all cores have some cells of the grid."""
        cells = max(1, -(-self.segments(l, d) // BLOCK))
        return min(l - 1, next(k for k in range(32) if cells * 4**k >= 4 * cores))


def measured(reads: DataFrame, lengths: bool = True) -> Size:
    """Without ``lengths`` no bases are told, and reads that are made on the way are not made for it."""
    seen = reads.select(F.spark_partition_id().alias("task"), (F.length("seq") if lengths else F.lit(0)).alias("bases"))
    n, bases, last = seen.agg(F.count(F.lit(1)), F.sum("bases"), F.max("task")).first()
    return Size(n, bases or 0, (last or 0) + 1)


def _numbers(n: int):
    return F.lit(n).cast("int")


def _reads(reads: DataFrame, l: int, d: int) -> DataFrame:  # noqa: E741
    return prepared(reads).select(_numbers(l).alias("l"), _numbers(d).alias("d"), "seq")


def _words(found: DataFrame, *by: str) -> DataFrame:
    return found.select(*by, unpack(F.col("code"), F.col("l")).alias("w"), "n_reads")


def supports(reads: DataFrame, l: int, d: int, size: Size | None = None) -> DataFrame:  # noqa: E741
    """(w, n_reads): in how many reads each word of length l has a substring within d edits."""
    size, cores = size or measured(reads), reads.sparkSession.sparkContext.defaultParallelism
    return _words(_counts(_sharded(blocks(_reads(reads, l, d)), size.depth(l, d, cores), cores, size.tasks)))


def supports_by(reads: DataFrame, by: str) -> DataFrame:
    """(by, w, n_reads) of reads (by, l, d, misses, seq): supports within each group, which has its own l and d.

    Words that miss more than ``misses`` reads of their group may be left out or counted short. Groups may share tasks,
    and a group may lie in many.
    """
    cores = reads.sparkSession.sparkContext.defaultParallelism
    small = lambda c: F.col(c).cast("int").alias(c)
    own = reads.select(by, F.col("misses").cast("long").alias("misses"), small("l"), small("d"), encoded(F.coalesce("seq", F.lit(""))).alias("seq"))
    size = measured(own)
    cells = _sharded(blocks(own, (by, "misses")), size.depth(LONGEST, 0, cores), cores, size.tasks)
    return _words(_counts(cells, (by, "misses")), by)


def given_supports(words: DataFrame, reads: DataFrame, l: int, d: int) -> DataFrame:  # noqa: E741
    """(w, n_reads) of the words (w) of A, C, G and T and of length l that are near some read."""
    codes = stored(words.where((F.length("w") == l) & F.col("w").rlike("^[ACGT]*$")).select(pack(F.col("w")).alias("code")).distinct(), "words")
    return _words(_given(codes, codes.count(), _reads(reads, l, d), l, d, measured(reads)))


def _given(codes: DataFrame, n: int, own: DataFrame, l: int, d: int, size: Size, misses: int = ANY) -> DataFrame:  # noqa: E741
    """(l, code, n_reads) of given words; blocks of reads meet shards of words by the shard's number."""
    cores = own.sparkSession.sparkContext.defaultParallelism
    wanted = max(n / SHARD_WORDS, min(4 ** size.depth(l, d, cores), n / 64))
    depth = min(l - 1, next(k for k in range(32) if 4**k >= wanted))
    shard = F.call_function("shiftrightunsigned", F.col("code"), F.lit(2 * (l - depth)))
    shards = codes.groupBy(shard.alias("shard")).agg(F.sort_array(F.collect_list("code")).alias("words"))
    return _counts(_sharded(blocks(own), depth, cores, size.tasks).join(shards, "shard"), (), misses)


def frontier(reads: DataFrame, l: int, d: int, least: int, size: Size | None = None) -> DataFrame:  # noqa: E741
    """(w, n_reads) of words of length l near ``least`` reads or more.

    Where few reads may be missed they are taken in rounds, each with ``GROWTH`` times the reads of the one before. The first
    walks over all words, sharded by prefix; a later one only confirms what is left, and none follows once nothing is. A
    read's round is told by the hash of its bases, so it is the same whenever a task runs again. A round's words are
    written to the shared folder. Where more reads may be missed than the first round has, no round could rule out a
    word: all are counted at once.
    """
    size, cores = size or measured(reads), reads.sparkSession.sparkContext.defaultParallelism
    misses = size.reads - least
    if size.segments(l, d) <= BLOCK:  # one block: the walk itself drops what misses too many
        cells = _sharded(blocks(_reads(reads, l, d).coalesce(1)), size.depth(l, d, cores), cores, 1)
        return _counts(cells, (), misses, once=True).where(F.col("n_reads") >= least)
    if misses >= FIRST_GROUP:
        return supports(reads, l, d, size).where(F.col("n_reads") >= least)
    own = _reads(reads, l, d).withColumn("draw", F.pmod(F.xxhash64("seq"), F.lit(DRAWS)))
    left, total, taken, until = None, 0, 0, DRAWS * FIRST_GROUP // size.reads
    while True:
        part = own.where((F.col("draw") >= taken) & (F.col("draw") < min(until, DRAWS)))
        total += part.count()
        if left is None:
            found = _counts(_sharded(blocks(part.coalesce(1)), Size(FIRST_GROUP, 0, 1).depth(l, d, cores), cores, 1), (), misses)
        else:
            more = _given(left.select("code"), n, part, l, d, size, misses).select("code", F.col("n_reads").alias("more"))
            found = left.join(more, "code", "left").select("l", "code", (F.col("n_reads") + F.coalesce("more", F.lit(0))).alias("n_reads"))
        left = stored(found.where(F.col("n_reads") >= total - misses), "frontier")
        n = left.count()
        if until >= DRAWS or not n:
            return _words(left.where(F.col("n_reads") >= least))
        taken, until = until, until * GROWTH


def best_distances(reads: DataFrame, words: list[str], d: int, by: tuple[str, ...] = ("sid",), every: bool = False) -> DataFrame:
    """(by, word, distance, end) for every read and given word of A, C, G and T within d edits of a substring: the least distance, and the first
    place, counted from 1, at which a substring of that distance ends. With ``every``, pairs that are further apart are there too, with
    nulls. A read is passed over once for all words of a length."""
    lengths: dict[int, list[int]] = {}
    for w in sorted(set(words)):
        lengths.setdefault(len(w), []).append(int(w.translate(str.maketrans(BASES, "0123")), 4))
    own = reads.select(*by, encoded(F.coalesce("seq", F.lit(""))).alias("seq"))
    fields = [T.StructField("l", T.IntegerType()), *(T.StructField(c, T.LongType()) for c in ("code", "distance", "end"))]
    schema = T.StructType([*own.schema.fields[:-1], *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, len(b), 256):
                part = b.slice(s, 256)
                seqs = part.column(len(by)).to_pylist()
                for l, codes in lengths.items():  # noqa: E741
                    block, given = Block(seqs, l, d), np.array(codes)
                    far = np.ones((len(seqs), len(given)), bool)
                    for code, _, near in walk(block, l, d, words=given, near_too=True):
                        at, read, distance, end = _nearest(near, block)
                        far[block.reads[read], np.searchsorted(given, code[at])] = False
                        yield told(part, block.reads[read], l, code[at], pa.array(distance), pa.array(end))
                    if every:
                        read, at = np.nonzero(far)
                        yield told(part, read, l, given[at], *[pa.nulls(len(at), pa.int64())] * 2)

    def told(part: pa.RecordBatch, read: np.ndarray, l: int, code: np.ndarray, *found: pa.Array) -> pa.RecordBatch:  # noqa: E741
        keys = part.take(pa.array(read)).columns[: len(by)]
        return pa.RecordBatch.from_arrays([*keys, pa.array(np.full(len(read), l, np.int32)), pa.array(code), *found], names=schema.names)

    return own.mapInArrow(run, schema).select(*by, unpack(F.col("code"), F.col("l")).alias("word"), "distance", "end")


def _nearest(near: np.ndarray, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Prefix, read, distance and end for each pair that is near."""
    hit = np.stack([block.hits(x) for x in near])
    at, read = np.nonzero(hit[-1])
    distance = hit[:, at, read].argmax(0).astype(np.int64)
    end = np.full(hit[-1].shape, ANY)
    for e in range(len(near)):
        bits = near[e] & block.valid
        first = np.where(bits != 0, block.offset + np.bitwise_count((bits & (~bits + _ONE)) - _ONE), ANY)
        first = np.minimum.reduceat(first, block.starts, axis=1)
        end = np.where(hit[e] & ~hit[:e].any(0), first, end)
    return at, read, distance, end[at, read]
