"""Substring dedup by repeated-phrase automata.

Words are runs of bytes other than space and \\x09-\\x0D. Words covered by a window of ``WINDOW`` consecutive words
that also starts in a document of smaller id are removed; the first document of a passage keeps it.

1. Marks. The least of the hashes of a window's ``GRAM``-word runs is the window's anchor; consecutive windows of one
   anchor form a segment. Anchors depend on a window's own words only, so equal windows have equal anchors, and there
   is about one anchor for 20 words. Whole copies (equal SHA-256 of the words) collapse here: the first of them goes on
   for all.
2. Recurring passages. Anchors in two documents or more are kept; only their segments' texts are cut out. Equal
   segments collapse to one, with the first document that has it; they are grouped by their texts. Where an anchor has
   several different segments their windows are counted one by one, by two independent 64-bit hashes of their words.
   This gives the phrases: maximal runs of windows with one first document.
3. Automata. Phrases are dealt to shards by anchor. A shard over ``SHARD_PHRASES`` phrases, which one anchor may fill, is
   split by phrase, and one over ``TASK_BYTES`` of segments by segment; each task compiles its part to one Aho-Corasick
   automaton and streams its segments through it. The automaton compares the words themselves, so a phrase is only
   found where its words stand.
4. Spans of phrases whose first document is smaller are merged for each document and cut from its text.

An anchor's equality decides nothing by itself. What is decided without comparing all words again: whole copies by
SHA-256 (its first 128 bits), and which document is the first of a window by the pair of hashes (112 bits).

Keys that one passage or one group of copies may fill (copies' digests, anchors, segments) are split in joins.

Defined cases: null and empty texts have no words and lose none; texts under WINDOW words lose none; repeats within
one document, and between rows of one id, remove nothing; rows with null id neither lose words nor make others lose
them; an empty table gives no rows; a text of any length is one row, of which a task holds ``SLICE`` at once; other columns
pass through ``deduplicate`` untouched, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandmill.llm import common
from strandmill.llm.wordhash import SECOND, hash_words, runs

WINDOW, GRAM = 50, 10
SHARD_PHRASES, TASK_BYTES, BROADCAST_BYTES, SLICE = 1000, 8 << 20, 32 << 20, 256
NOBODY = np.iinfo(np.int64).max  # not the first of any passage: a first document has a smaller id than another


def segments(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors, first windows and numbers of windows of a document's segments."""
    least = runs(hashes, GRAM)
    span, reach = WINDOW - GRAM + 1, 1
    if len(least) < span:
        return (np.empty(0, np.uint64), *(np.empty(0, np.int64),) * 2)
    n = len(least) - span + 1
    while 2 * reach <= span:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    least = np.minimum(least[:n], least[span - reach : span - reach + n])
    at = np.concatenate(([0], np.flatnonzero(least[1:] != least[:-1]) + 1))
    return least[at], at, np.diff(at, append=n)


def _digest(phrase: bytes) -> bytes:
    return hashlib.sha256(phrase).digest()[:16]


def _encoded(texts: pa.Array) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in texts.to_pylist()]


def marks(own: DataFrame) -> DataFrame:
    """(doc_id, h, n_words, print, anchors) for rows (doc_id, h, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches, SLICE):
            n, prints, anchors = [], [], []
            texts = _encoded(b.column(2))
            for text, hashes in zip(texts, hash_words(texts)):
                n.append(len(hashes))
                prints.append(_digest(b" ".join(text.split())))
                anchors.append(segments(hashes)[0].view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(prints, pa.binary()), pa.array(anchors, pa.list_(pa.int64()))], names=["doc_id", "h", "n_words", "print", "anchors"])

    return own.mapInArrow(run, "doc_id long, h long, n_words long, print binary, anchors array<long>")


def cut_segments(rows: DataFrame) -> DataFrame:
    """(doc_id, h, at, anchor, segment, phrase): the wanted segments of rows (doc_id, h, text, wanted)."""
    names = ["doc_id", "h", "at", "anchor", "segment", "phrase"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches, SLICE):
            texts, out = _encoded(b.column(2)), []
            for key, h, text, wanted, hashes in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), texts, b.column(3).to_pylist(), hash_words(texts)):
                words = text.split()
                anchors, starts, counts = segments(hashes)
                for i in wanted:
                    at = int(starts[i])
                    phrase = b" ".join(words[at : at + int(counts[i]) - 1 + WINDOW])
                    out.append((key, h, at, int(anchors[i].view(np.int64)), _digest(phrase), phrase.decode("utf-8", "surrogatepass")))
                if len(out) >= 4096:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    return rows.mapInArrow(run, "doc_id long, h long, at long, anchor long, segment binary, phrase string")


def window_keys(rows: DataFrame) -> DataFrame:
    """(segment, first, last, at, w1, w2): two hashes of each segment's windows, for rows (segment, first, last, phrase)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches, SLICE):
            texts = _encoded(b.column(3))
            one = [runs(h, WINDOW) for h in hash_words(texts)]
            two = [runs(h, WINDOW, SECOND) for h in hash_words(texts, SECOND)]
            each = np.array([len(g) for g in one])
            take = pa.array(np.repeat(np.arange(len(one)), each))
            at = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
            windows = (pa.array(np.concatenate(w).view(np.int64)) for w in (one, two))
            yield pa.RecordBatch.from_arrays([*(b.column(i).take(take) for i in range(3)), pa.array(at, pa.int64()), *windows], names=["segment", "first", "last", "at", "w1", "w2"])

    return rows.mapInArrow(run, "segment binary, first long, last long, at long, w1 long, w2 long")


def _runs_of(rows: DataFrame) -> DataFrame:
    """(anchor, phrase, first): runs of windows with one first document, for rows (anchor, phrase, firsts(at, first))."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches, SLICE):
            out = []
            for anchor, phrase, firsts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                words = phrase.split(" ")
                firsts.sort(key=lambda f: f["at"])
                start = 0
                for i in range(1, len(firsts) + 1):
                    if i == len(firsts) or firsts[i]["at"] != firsts[i - 1]["at"] + 1 or firsts[i]["first"] != firsts[start]["first"]:
                        out.append((anchor, " ".join(words[firsts[start]["at"] : firsts[i - 1]["at"] + WINDOW]), firsts[start]["first"]))
                        start = i
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.string(), pa.int64()))], names=["anchor", "phrase", "first"])

    return rows.mapInArrow(run, "anchor long, phrase string, first long")


def phrases(distinct: DataFrame) -> DataFrame:
    """(anchor, phrase, first) of recurring passages, from distinct segments (anchor, segment, phrase, first, last)."""
    ways = common.stored(distinct.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "ways")
    alone = distinct.where("first < last").join(ways, "anchor", "left_anti").select("anchor", "phrase", "first")
    several = common.stored(common.spread_join(distinct, ways.select("anchor"), "anchor", ways, "left_semi"), "several")
    # A window takes more room than its share of the text, so tasks are sized by texts, not by files.
    size = several.agg(F.sum(F.octet_length("phrase"))).first()[0] or 0
    partitions = max(int(several.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // TASK_BYTES)
    texts = several.select("segment", "first", "last", "phrase").repartition(partitions, "segment")
    windows = common.stored(window_keys(texts), "windows")
    known = common.stored(windows.groupBy("w1", "w2").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.count(F.lit(1)).alias("n")).where("first < last").select("w1", "w2", "first"), "recurring")
    firsts = windows.select("segment", "at", "w1", "w2").join(known, ["w1", "w2"]).groupBy("segment").agg(F.collect_list(F.struct("at", "first")).alias("firsts"))
    split = _runs_of(several.select("segment", "anchor", "phrase").join(firsts, "segment").select("anchor", "phrase", "firsts"))
    return alone.unionByName(split.groupBy("anchor", "phrase").agg(F.min("first").alias("first")))


def lowest(n: int, spans: list[tuple[int, int, int]]) -> list[dict]:
    """The smallest first document over each of n words that spans (at, length, first) cover, as runs that don't overlap."""
    low = np.full(n + 2, NOBODY)
    for at, length, first in sorted(spans, key=lambda s: -s[2]):
        low[at + 1 : at + 1 + length] = first
    turns = np.flatnonzero(low[1:] != low[:-1])
    return [{"at": int(a), "length": int(b - a), "first": int(low[a + 1])} for a, b in zip(turns, turns[1:]) if low[a + 1] != NOBODY]


def merge_spans(rows: DataFrame) -> DataFrame:
    """Rows (doc_id, h, spans(at, length)) with overlapping and adjoining spans made one."""
    span = pa.struct([("at", pa.int64()), ("length", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for spans in b.column(2).to_pylist():
                own = np.array(sorted((s["at"], s["at"] + s["length"]) for s in spans), np.int64).reshape(-1, 2)
                reach = np.maximum.accumulate(own[:, 1])
                new = np.flatnonzero(np.concatenate(([True], own[1:, 0] > reach[:-1])))
                out.append([{"at": int(a), "length": int(e - a)} for a, e in zip(own[new, 0], reach[np.append(new[1:], len(own)) - 1])])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.list_(span))], names=["doc_id", "h", "spans"])

    return rows.mapInArrow(run, "doc_id long, h long, spans array<struct<at: long, length: long>>")


def locate(found: DataFrame, distinct: DataFrame) -> DataFrame:
    """(segment, spans(at, length, first)): where the phrases of its shard occur in each segment, a row for each part.

    Where occurrences overlap, a word has the smallest of their first documents: that one decides whether it goes.
    """
    spark = found.sparkSession
    shards = max(1, -(-found.count() // SHARD_PHRASES))
    shard = F.pmod(F.xxhash64("anchor"), F.lit(shards)).alias("shard")
    most = found.groupBy(shard).agg(F.ceil(F.count(F.lit(1)) / SHARD_PHRASES).alias("parts"))
    bytes_ = distinct.groupBy(shard).agg(F.ceil(F.sum(F.octet_length("phrase")) / TASK_BYTES).alias("tasks"))
    loads = common.stored(most.join(bytes_, "shard"), "loads")
    dealt_to = loads.agg(F.sum(F.col("parts") * F.col("tasks"))).first()[0] or 1
    if shards * 32 <= BROADCAST_BYTES:
        loads = F.broadcast(loads)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    keys = found.select(shard, "phrase", "first").join(loads, "shard").withColumn("part", F.pmod(F.xxhash64("phrase"), F.col("parts")))
    keys = keys.select("shard", "part", every("tasks").alias("task"), F.lit(0).alias("kind"), "phrase", "first", F.lit(None).cast("binary").alias("segment"))
    streams = distinct.select(shard, "segment", "phrase").join(loads, "shard").withColumn("task", F.pmod(F.xxhash64("segment"), F.col("tasks")))
    streams = streams.select("shard", every("parts").alias("part"), "task", F.lit(1).alias("kind"), "phrase", F.lit(None).cast("long").alias("first"), "segment")
    # Fewer partitions than shares of work, so that hashing them to partitions evens out.
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(int(dealt_to) // 4, 100_000))
    dealt = keys.unionByName(streams).repartition(partitions, "shard", "part", "task").sortWithinPartitions("shard", "part", "task", "kind")
    span = pa.struct([("at", pa.int64()), ("length", pa.int64()), ("first", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, automaton, ready = None, None, False
        for b in common.slices(batches, SLICE):
            ids, out = [], []
            for *share, kind, phrase, first, segment in zip(*(b.column(i).to_pylist() for i in range(7))):
                if share != own:
                    own, automaton, ready = share, ahocorasick.Automaton(), False
                spaced = f" {phrase} "
                if kind == 0:
                    automaton.add_word(spaced, (len(spaced), phrase.count(" ") + 1, first))
                    continue
                if not ready:
                    automaton.make_automaton()
                    ready = True
                hits = [(end - size + 1, n, first) for end, (size, n, first) in automaton.iter(spaced)] if len(automaton) else []
                if hits:
                    gaps = np.cumsum(np.frombuffer(spaced.encode("utf-32-le", "surrogatepass"), np.uint32) == 32)
                    ids.append(segment)
                    out.append(lowest(int(gaps[-1]) - 1, [(int(gaps[start]) - 1, n, first) for start, n, first in hits]))
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array(out, pa.list_(span))], names=["segment", "spans"])

    return dealt.mapInArrow(run, "segment binary, spans array<struct<at: long, length: long, first: long>>")


def removals(own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What rows (doc_id, h, text) lose: (doc_id, h, spans(at, length)), null spans meaning all; and the marks."""
    made = common.stored(marks(own), "marks")
    long = made.where(f"n_words >= {WINDOW} AND doc_id IS NOT NULL")
    firsts = long.groupBy("print").agg(F.min(F.struct("doc_id", "h", "anchors")).alias("f"), F.count(F.lit(1)).alias("n")).select("print", "n", "f.*")
    firsts = common.stored(firsts, "firsts")
    heads = firsts.where("n > 1").select("print", F.col("doc_id").alias("head"))
    copies = common.spread_join(long.select("doc_id", "h", "print"), heads, "print", firsts).where("doc_id > head").select("doc_id", "h").distinct()

    each = firsts.select("doc_id", "h", F.posexplode("anchors").alias("i", "anchor"))
    again = each.groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count(F.lit(1)).alias("n")).where("low < high").select("anchor", "n")
    again = common.stored(again, "anchors")
    wanted = common.spread_join(each, again.select("anchor"), "anchor", again).groupBy("doc_id", "h").agg(F.sort_array(F.collect_list("i")).alias("wanted"))
    wanted = common.stored(wanted, "wanted")
    cut = own.join(wanted, ["doc_id", "h"]).select("doc_id", "h", "text", "wanted")
    cut = common.stored(cut_segments(cut), "segments")
    distinct = common.stored(cut.groupBy("anchor", "segment", "phrase").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("n")), "distinct")
    located = common.stored(locate(common.stored(phrases(distinct), "phrases"), distinct), "located")
    met = common.spread_join(cut.select("doc_id", "h", "at", "segment"), located, "segment", distinct)
    earlier = F.filter("spans", lambda s: s["first"] < F.col("doc_id"))
    moved = F.transform(earlier, lambda s: F.struct((F.col("at") + s["at"]).alias("at"), s["length"].alias("length")))
    each = met.select("doc_id", "h", moved.alias("spans")).where(F.size("spans") > 0)
    spans = merge_spans(each.groupBy("doc_id", "h").agg(F.flatten(F.collect_list("spans")).alias("spans")))
    copies = copies.withColumn("spans", F.lit(None).cast(spans.schema["spans"].dataType))
    return common.stored(spans.unionByName(copies), "removals"), made


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with repeated passages cut from the text, and n_words and n_removed (n_words_ or n_removed_ where taken).

    Kept words are joined by one space where something was removed; other texts stay as they are.
    """
    key, h, text = F.col(f"`{id_col}`").cast("long"), F.xxhash64(F.col(f"`{text_col}`").cast("string")), F.col(f"`{text_col}`").cast("string")
    rest = [f for f in docs.schema.fields if f.name != text_col]
    counts = [common.fresh(docs.columns, c) for c in ("n_words", "n_removed")]
    held = docs.select(key.alias("doc_id"), h.alias("h"), text.alias("text"), *(F.col(f"`{f.name}`").alias(f"c{i}") for i, f in enumerate(rest)))
    held = common.dealt(held, "held", ("doc_id", "h"))
    lost, _ = removals(held.select("doc_id", "h", "text"))
    state = F.when(~F.col("hit"), F.lit(0)).when(F.col("spans").isNull(), F.lit(2)).otherwise(F.lit(1))
    joined = held.join(lost.withColumn("hit", F.lit(True)), ["doc_id", "h"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    joined = joined.select(*(f"c{i}" for i in range(len(rest))), state.alias("state"), "spans", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches, SLICE):
            kept, n_words, n_removed = [], [], []
            for state, spans, text in zip(*(b.column(len(rest) + i).to_pylist() for i in range(3))):
                words = (text or "").encode("utf-8", "surrogatepass").split()
                n = len(words)
                if state:
                    gone = np.full(n, state == 2)
                    for s in spans or ():
                        gone[s["at"] : s["at"] + s["length"]] = True
                    words = [words[i] for i in np.flatnonzero(~gone)]
                    text = b" ".join(words).decode("utf-8", "surrogatepass")
                kept.append(text)
                n_words.append(n)
                n_removed.append(n - len(words))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(rest)], pa.array(kept, pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())], names=[*(f.name for f in rest), text_col, *counts])

    made = [T.StructField(text_col, T.StringType()), *(T.StructField(c, T.LongType()) for c in counts)]
    return joined.mapInArrow(run, T.StructType([*rest, *made]))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    out = deduplicate(docs)
    found = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.array_join(found, " ").cast("binary"), 256).alias("kept_sha256"))
