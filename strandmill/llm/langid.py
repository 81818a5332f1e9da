"""Language ID by rank-order profiles (out-of-place distance).

A language's profile is its ``size`` most frequent n-grams of 1 to 3 characters, in order. A text's own n-grams
are ranked the same way and compared to each profile: every n-gram of the text costs the difference of its two
ranks, or ``size`` where the profile lacks it; the language of least cost wins. The score is 1 - (least cost / the
most it could be), from 0 to 1.

Texts count by lower-cased letters only; everything else is one word break. Tasks add up n-grams of their rows by
language before anything is shuffled, and a profile is cut from counts over all rows that are learned from.
What reaches the driver is ``size`` n-grams for each language.

Defined cases: a text that is null, empty or without letters is ``und`` with score 0; ties of counts are broken by
n-gram and ties of cost by language; rows without language are not learned from; if nothing can be learned every
row is ``und``; rows with null id are not learned from and not held out; repeated rows count each; an empty table gives
no rows; a long text is read whole, in pieces of about ``PIECE`` characters cut between words; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandmill.llm import common

SIZE, PIECE, SLICE = 300, 1 << 20, 256
UNKNOWN = "und"
_BREAK = 0x20
_TABLE: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Code point -> its lower-case letter, or a break; built once in a process."""
    if not _TABLE:
        t = np.full(0x110000, _BREAK, np.int64)
        for cp in range(len(t)):
            ch = chr(cp)
            if ch.isalpha():
                low = ch.lower()
                t[cp] = ord(low) if len(low) == 1 else cp
        _TABLE.append(t)
    return _TABLE[0]


_SPACE = re.compile(r"\s")


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """A text cut at white space; n-grams never reach over a break, so those of the pieces are those of the text."""
    at = 0
    while len(text) - at > size and (cut := _SPACE.search(text, at + size)):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def grams(text: str, size: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the n-grams of a text (21 bits a character) and their counts; none without letters."""
    if len(text) <= size:
        return _grams(text)
    parts = [_grams(p) for p in pieces(text, size)]
    codes, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return codes, np.bincount(at, np.concatenate([p[1] for p in parts]), len(codes)).astype(np.int64)


def _grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    cps = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    s = _letters()[cps]
    s = np.concatenate(([_BREAK], s, [_BREAK]))
    s = s[np.concatenate(([True], (s[1:] != _BREAK) | (s[:-1] != _BREAK)))]  # runs of breaks become one
    if len(s) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    two = (s[:-1] << 21) | s[1:]
    three = (two[:-1] << 21) | s[2:]
    inner = s[1:-1] != _BREAK  # a trigram's middle break joins two words
    codes = np.concatenate((s[s != _BREAK], two, three[inner]))
    return np.unique(codes, return_counts=True)


def ranked(codes: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` most frequent codes in order; ``codes`` must be sorted."""
    return codes[np.argsort(-counts, kind="stable")[:size]]


def profiles(docs: DataFrame, lang: Column, text: Column, size: int = SIZE) -> dict[str, list[int]]:
    """Language -> codes of its most frequent n-grams, in order."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, dict[int, int]] = {}

        def emit() -> Iterator[pa.RecordBatch]:
            for lang, sums in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(sums), pa.string()), pa.array(sums.keys(), pa.int64()), pa.array(sums.values(), pa.int64())], names=["lang", "gram", "n"])
            held.clear()

        for batch in common.slices(batches, SLICE):
            by: dict[str, list[str]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                by.setdefault(lang, []).append(text)
            for lang, texts in by.items():
                sums = held.setdefault(lang, {})
                for joined in pieces(" ".join(texts), PIECE // 4):  # a break keeps the texts of a slice apart
                    for g, n in zip(*(a.tolist() for a in grams(joined))):
                        sums[g] = sums.get(g, 0) + n
            if sum(map(len, held.values())) > 500_000:
                yield from emit()
        yield from emit()

    learned = docs.select(lang.alias("lang"), text.alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    counts = learned.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size).orderBy("lang", "rank").select("lang", "gram")
    out: dict[str, list[int]] = {}
    for row in top.collect():
        out.setdefault(row["lang"], []).append(row["gram"])
    return out


def identify(docs: DataFrame, known: dict[str, list[int]], id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, keep: tuple[str, ...] = ()) -> DataFrame:
    """The id, the columns in ``keep``, lang_pred and score of each row; a result column whose name is taken gets underscores behind it."""
    langs = sorted(known)
    vocabulary = np.unique(np.concatenate([np.asarray(known[k], np.int64) for k in langs])) if langs else np.empty(0, np.int64)
    places = np.full((len(langs), len(vocabulary)), -1, np.int64)
    for i, k in enumerate(langs):
        places[i, np.searchsorted(vocabulary, known[k])] = np.arange(len(known[k]))

    def nearest(text: str | None) -> tuple[str, float]:
        codes = ranked(*grams(text), size) if text else ()
        if not len(codes) or not langs:
            return UNKNOWN, 0.0
        at = np.minimum(np.searchsorted(vocabulary, codes), len(vocabulary) - 1)
        there = vocabulary[at] == codes
        theirs = np.where(there, places[:, at], -1)
        cost = np.where(theirs >= 0, np.abs(theirs - np.arange(len(codes))), size).sum(axis=1)
        best = int(np.argmin(cost))
        return langs[best], float(1 - cost[best] / (size * len(codes)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches, SLICE):
            found = [nearest(t) for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=[*b.schema.names[:-1], *made])

    made = [common.fresh([id_col, *keep], name) for name in ("lang_pred", "score")]
    own = docs.select(*(F.col(f"`{c}`") for c in (id_col, *keep)), F.col(f"`{text_col}`").cast("string").alias(common.fresh([id_col, *keep], "text")))
    kinds = (T.StringType(), T.DoubleType())
    return own.mapInArrow(run, T.StructType([*own.schema.fields[:-1], *map(T.StructField, made, kinds)]))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang", F.coalesce(common.fold(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"))
    known = profiles(docs.where("NOT held_out AND doc_id IS NOT NULL"), F.col("lang"), F.col("text"))
    return identify(docs, known, keep=("held_out",))
