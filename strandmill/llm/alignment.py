"""Alignment of two tokenizers: where their tokens end together, and how often each pair of ids does so.

Each text is encoded by both vocabularies. Offsets at which a token of each ends cut both lists into groups, and each
such offset links the two tokens that end there (every token has a byte at least, so there is one of each).

Documents are numbered within their task, in blocks of up to ``BLOCK``. A block is an inverted index: for every pair of
ids, the compressed bitmap of the documents that link it (a sorted list of 16-bit places, or the plain bitmap from
``BLOCK`` / 16 documents on), and for documents that link it more than once the bit planes of how often more. Documents
of different blocks are different, so the OR of a pair's bitmaps over blocks lies side by side and is never built:
popcounts add up, partly in each task, to the pair's number of documents, and popcounts of the planes times their
weights to its number of links. ``id_documents`` joins the bitmaps of several pairs, which do overlap, by OR.
Counts go back to the postings by pair; a task then reads one block after the other and adds each pair's count to
the places in its bitmaps. What is shuffled are bitmaps, 2 bytes or less for a document and pair, never links; a
pair that all documents share has one row for each block.

Pieces never hold a space behind another character, so the second vocabulary's merges don't cross one: texts are encoded
by stretches from space to space, which repeat, and the ids are those of the whole text. A vocabulary of which that
isn't true encodes whole texts.

Defined cases: texts that are null or empty, or that a vocabulary doesn't give back byte for byte (it normalises them),
have no tokens and all zeros; control strings in a text are plain text; repeated rows count each; an empty table gives
no rows; a text of any length is one value; other columns are ignored, whatever their names; equal counts of
a pair's second id are all its highest.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from strandmill.llm import common, tokens
from strandmill.llm.bytestrings import Strings

PIECES_32K = public_tokenizers.path("piece_bpe_32k.model")
BLOCK, ENTRIES, SLICE, CACHED = 1 << 15, 1 << 22, 64, 500_000
DENSE = BLOCK // 16  # from so many documents on, a bitmap takes no more bytes than a list
PRESENCE = -1  # the plane of documents that have the pair; plane k >= 0: bit k of how often more than once


class Bytes:
    """Ids of the first vocabulary (byte-level BPE), and the bytes of each."""

    def __init__(self, path: str):
        self.encode, tokenizer = tokens.encoder(path), Tokenizer.from_file(path)
        byte = {c: b for b, c in tokens._byte_letters().items()}
        names = {i: t for t, i in tokenizer.get_vocab().items()}
        added = {i: t.content.encode() for i, t in tokenizer.get_added_tokens_decoder().items()}
        self.strings = Strings(added[i] if i in added else bytes(byte[c] for c in names.get(i, "")) for i in range(max(names) + 1))

    def __call__(self, texts: list[str]) -> list[bytes]:
        return [self.encode(" " + t) if t else b"" for t in texts]


class Pieces:
    """Ids of the second vocabulary, which puts the space before a text itself, and the bytes of each."""

    def __init__(self, path: str):
        self.model, self.known = sentencepiece.SentencePieceProcessor(model_file=path), {}
        size = self.model.get_piece_size()
        names = [self.model.id_to_piece(i) for i in range(size)]
        self.strings = Strings(bytes([int(n[3:5], 16)]) if self.model.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names))
        spaced = any(re.search("[^▁]▁", n) for i, n in enumerate(names) if not self.model.is_control(i))
        self.apart = not spaced and self.strings.joined(np.array(self.model.encode(" a  b ")))[0].tobytes() == b"  a  b "
        self.stretches = re.compile(r" +[^ ]+(?: +\Z)?| +\Z").findall

    def __call__(self, texts: list[str]) -> list[bytes]:
        cut = [(self.stretches(" " + t) if self.apart else [" " + t]) if t else [] for t in texts]
        wanted = set().union(*cut)
        if len(self.known) + len(wanted) > CACHED or not self.apart:
            self.known = {}
        new = [s for s in wanted if s not in self.known]
        for stretch, ids in zip(new, self.model.encode([s[1:] for s in new], num_threads=1)):
            self.known[stretch] = np.array(ids, "<i4").tobytes()
        return [b"".join(map(self.known.__getitem__, stretches)) for stretches in cut]


class Aligner:
    def __init__(self, first: str, second: str):
        self.sides = (Bytes(first), Pieces(second))
        self.size = max(len(s.strings.length) for s in self.sides)
        self.said = Strings(str(i).encode() + mark for mark in (b",", b"|", b";") for i in range(self.size))

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, list[bytes], np.ndarray]:
        """Counts (first ids, second ids, links) of each text, its groups as they are written, and all links (row, first id, second id)."""
        raw, held = [b" " + t.encode() if t else b"" for t in texts], []
        good = np.array([bool(r) for r in raw], bool)
        for side in self.sides:
            packed = side([t or "" for t in texts])
            ids, count = np.frombuffer(b"".join(packed), "<i4"), np.array([len(p) // 4 for p in packed], np.int64)
            data, ends = side.strings.joined(ids)
            cuts = np.concatenate(([0], ends))[np.concatenate(([0], count.cumsum()))].tolist()
            data = data.tobytes()
            good &= [data[s:e] == r for s, e, r in zip(cuts, cuts[1:], raw)]
            held.append((ids, count))
        counts, groups = np.zeros((len(texts), 3), np.int64), [b""] * len(texts)
        (a, n_a), (b, n_b) = [(ids[np.repeat(good, count)], np.where(good, count, 0)) for ids, count in held]
        counts[:, 0], counts[:, 1] = n_a, n_b
        if not len(a):
            return counts, groups, np.zeros((3, 0), np.int64)
        end_a, end_b = (side.strings.length[ids].cumsum() for side, ids in zip(self.sides, (a, b)))
        at_a, at_b = (np.zeros(end_a[-1] + 1, bool) for _ in range(2))
        at_a[end_a], at_b[end_b] = True, True
        last_a, last_b = np.flatnonzero(at_b[end_a]), np.flatnonzero(at_a[end_b])
        row = np.repeat(np.arange(len(texts)), n_a)[last_a]
        counts[:, 2] = np.bincount(row, minlength=len(texts))
        # Both lists as one, by group: a token's place is its own and that of the other side's tokens before it.
        group_a, group_b = (np.searchsorted(last, np.arange(len(ids))) for last, ids in ((last_a, a), (last_b, b)))
        entry = np.empty(len(a) + len(b), np.int64)
        entry[np.arange(len(a)) + np.concatenate(([0], last_b + 1))[group_a]] = a + self.size * at_b[end_a]
        entry[np.arange(len(b)) + last_a[group_b] + 1] = b + 2 * self.size * at_a[end_b]
        said, ends = self.said.joined(entry)
        cuts = np.concatenate(([0], ends))[np.concatenate(([0], (n_a + n_b).cumsum()))].tolist()
        said = said.tobytes()
        groups = [said[s : max(s, e - 1)] for s, e in zip(cuts, cuts[1:])]
        return counts, groups, np.stack((row, a[last_a], b[last_b]))


@functools.lru_cache(maxsize=1)
def aligner(first: str = tokens.BYTE_BPE_50K, second: str = PIECES_32K) -> Aligner:
    return Aligner(first, second)


def _bitmap(places: np.ndarray) -> bytes:
    bits = np.zeros(BLOCK, bool)
    bits[places] = True
    return np.packbits(bits, bitorder="little").tobytes()


def _postings(keys: np.ndarray, times: np.ndarray) -> Iterator[tuple[np.ndarray, int, pa.Array]]:
    """(pairs, plane, bitmaps) of a block, from pair * BLOCK + place and how often, each key once."""
    order = keys.argsort()
    pair, place, more = keys[order] // BLOCK, (keys[order] % BLOCK).astype("<u2"), times[order] - 1
    for plane in range(PRESENCE, int(more.max()).bit_length()):
        has = np.ones(len(more), bool) if plane == PRESENCE else (more >> plane & 1).astype(bool)
        own, places = pair[has], place[has]
        starts = np.flatnonzero(np.diff(own, prepend=-1))
        sizes = np.diff(starts, append=len(own))
        sparse = sizes < DENSE
        if sparse.any():
            offsets = np.concatenate(([0], 2 * sizes[sparse].cumsum())).astype(np.int32)
            data = places[np.repeat(sparse, sizes)].tobytes()
            yield own[starts[sparse]], plane, pa.Array.from_buffers(pa.binary(), int(sparse.sum()), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        if not sparse.all():
            dense = [_bitmap(places[s : s + n]) for s, n in zip(starts[~sparse], sizes[~sparse])]
            yield own[starts[~sparse]], plane, pa.array(dense, pa.binary())


@dataclass
class Index:
    docs: DataFrame  # (key, place, n_a, n_b, n_links, groups): place is block * BLOCK + the place in it
    postings: DataFrame  # (block, pair, plane, bitmap): pair is first id * 2 ** 16 + second id


def index(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text", first: str = tokens.BYTE_BPE_50K, second: str = PIECES_32K, digest: bool = False) -> Index:
    """Encode and align all rows; with ``digest``, groups are kept as the SHA-256 of their bytes only."""
    own = rows.select(F.col(f"`{id_col}`").alias("key"), F.col(f"`{text_col}`").alias("text"))
    long, binary = T.LongType(), T.BinaryType()
    fields = {"key": own.schema["key"].dataType, "place": long, "n_a": long, "n_b": long, "n_links": long, "groups": binary, "pair": long, "plane": T.IntegerType(), "bitmap": binary, "posting": T.BooleanType()}
    schema = T.StructType([T.StructField(k, v) for k, v in fields.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, at, held, entries = TaskContext.get().partitionId() << 24, 0, [], 0
        align = aligner(first, second)

        def batch(n: int, kind: pa.DataType, **columns) -> pa.RecordBatch:
            kinds = {"key": kind, "groups": pa.binary(), "bitmap": pa.binary(), "plane": pa.int32()}
            of = lambda c: columns[c] if isinstance(columns.get(c), pa.Array) else pa.array(columns[c], kinds.get(c, pa.int64())) if c in columns else pa.nulls(n, kinds.get(c, pa.int64()))
            return pa.RecordBatch.from_arrays([*map(of, list(fields)[:-1]), pa.array([columns.get("pair") is not None] * n)], names=list(fields))

        def flushed(kind: pa.DataType) -> Iterator[pa.RecordBatch]:
            if held:
                keys, times = (np.concatenate(x) for x in zip(*held))
                for pair, plane, bitmaps in _postings(keys, times):
                    for s in range(0, len(pair), 1 << 16):
                        part = pair[s : s + (1 << 16)]
                        yield batch(len(part), kind, place=np.full(len(part), block * BLOCK), pair=part, plane=np.full(len(part), plane, np.int32), bitmap=bitmaps.slice(s, len(part)))

        kind = pa.int64()
        for b in common.slices(batches, SLICE):
            kind = b.column(0).type
            if at + len(b) > BLOCK or entries > ENTRIES:
                yield from flushed(kind)
                block, at, held, entries = block + 1, 0, [], 0
            counts, groups, (row, a, c) = align(b.column(1).to_pylist())
            if digest:
                groups = [hashlib.sha256(g).digest() if n else b"" for g, n in zip(groups, counts[:, 0])]
            yield batch(len(b), kind, key=b.column(0), place=block * BLOCK + at + np.arange(len(b)), n_a=counts[:, 0], n_b=counts[:, 1], n_links=counts[:, 2], groups=pa.array(groups, pa.binary()))
            keys, times = np.unique((a << 16 | c) * BLOCK + at + row, return_counts=True)
            if len(keys):
                held.append((keys, times))
            at, entries = at + len(b), entries + len(keys)
        yield from flushed(kind)

    found = common.stored(own.mapInArrow(run, schema), "alignment", by=("posting",))
    docs = found.where(~F.col("posting")).select("key", "place", "n_a", "n_b", "n_links", "groups")
    return Index(docs, found.where("posting").select((F.col("place") / BLOCK).cast("long").alias("block"), "pair", "plane", "bitmap"))


def popcount(bitmap: Column) -> Column:
    return F.when(F.octet_length(bitmap) == BLOCK // 8, F.bitmap_count(bitmap)).otherwise((F.octet_length(bitmap) / 2).cast("long"))


def pair_counts(postings: DataFrame) -> DataFrame:
    """(pair, n_docs, n_links, best): documents and links of each pair; best where no pair of the same second id has more links."""
    n = popcount(F.col("bitmap"))
    docs, links = F.when(F.col("plane") == PRESENCE, n).otherwise(0), n * F.expr("shiftleft(1L, greatest(plane, 0))")
    counts = postings.groupBy("pair").agg(F.sum(docs).alias("n_docs"), F.sum(links).alias("n_links")).withColumn("second", F.col("pair") % (1 << 16))
    counts = common.stored(counts, "pairs")
    most = counts.groupBy("second").agg(F.max("n_links").alias("most"))
    return counts.join(most, "second").select("pair", "n_docs", "n_links", (F.col("n_links") == F.col("most")).alias("best"))


def _places(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All places in a column of bitmaps, and how many each has."""
    size = pa.compute.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    if (size < BLOCK // 8).all():
        data = np.frombuffer(b"".join(column.to_pylist()), "<u2")
        return data, size // 2
    each = [np.flatnonzero(np.unpackbits(np.frombuffer(x, np.uint8), bitorder="little")) if len(x) == BLOCK // 8 else np.frombuffer(x, "<u2") for x in column.to_pylist()]
    return np.concatenate(each), np.array([len(x) for x in each])


def scores(postings: DataFrame, pairs: DataFrame) -> DataFrame:
    """(place, n_best, count_sum) of documents with links, read back from the postings."""
    n = int(postings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known = postings.join(pairs.select("pair", "n_links", "best"), "pair").select("block", "plane", "bitmap", "n_links", "best")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, total = None, np.zeros((2, BLOCK), np.int64)

        def told() -> pa.RecordBatch:
            at = np.flatnonzero(total[1])
            return pa.RecordBatch.from_arrays([pa.array(block * BLOCK + at), *(pa.array(t[at]) for t in total)], names=["place", "n_best", "count_sum"])

        for b in batches:
            blocks = b.column(0).to_numpy()
            for s, e in zip(cut := [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist()], [*cut[1:], len(b)]):
                if s == e:
                    continue
                if blocks[s] != block:
                    if block is not None:
                        yield told()
                    block, total = int(blocks[s]), np.zeros((2, BLOCK), np.int64)
                part = b.slice(s, e - s)
                places, n = _places(part.column(2))
                times = 1 << np.maximum(part.column(1).to_numpy().astype(np.int64), 0)
                np.add.at(total[0], places, np.repeat(times * part.column(4).to_numpy(zero_copy_only=False), n))
                np.add.at(total[1], places, np.repeat(times * part.column(3).to_numpy(), n))
        if block is not None:
            yield told()

    return known.repartition(n, "block").sortWithinPartitions("block").mapInArrow(run, "place long, n_best long, count_sum long")


def id_documents(postings: DataFrame) -> DataFrame:
    """(second, n_docs): in how many documents a second id is linked with any first one, by OR of its pairs' bitmaps."""
    n = int(postings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = postings.where(F.col("plane") == PRESENCE).select("block", (F.col("pair") % (1 << 16)).alias("second"), "bitmap")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, bits = None, np.zeros(BLOCK, bool)
        for b in batches:
            out = []
            for key, bitmap in zip(zip(b.column(0).to_pylist(), b.column(1).to_pylist()), b.column(2)):
                if key != held:
                    if held is not None:
                        out.append((held[1], int(bits.sum())))
                    held, bits = key, np.zeros(BLOCK, bool)
                bits[_places(pa.array([bitmap.as_py()], pa.binary()))[0]] = True
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)] if out else [pa.array([], pa.int64())] * 2, names=["second", "n"])
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([held[1]]), pa.array([int(bits.sum())])], names=["second", "n"])

    return own.repartition(n, "block", "second").sortWithinPartitions("block", "second").mapInArrow(run, "second long, n long").groupBy("second").agg(F.sum("n").alias("n_docs"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = index(common.table(spark, sf_dir, "documents"), digest=True)
    scored = found.docs.join(scores(found.postings, pair_counts(found.postings)), "place", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return scored.select(F.col("key").alias("doc_id"), "n_a", "n_b", F.col("n_links").alias("n_groups"), "n_links", zero("n_best"), zero("count_sum"), F.lower(F.hex("groups")).alias("groups_sha256"))
