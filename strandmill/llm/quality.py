"""Quality classifier: random Fourier features, ridge by partition-summed normal equations, isotonic calibration.

Each whole text becomes a few statistics (lengths, shares of character classes, repetition, shape of words and
lines). Standardised, they are mapped to ``width`` random cosines whose inner products approximate a Gaussian
kernel. Ridge regression on these needs only the sums Z'Z and Z'y: tasks add them up over their rows, a second
round adds up the tasks' sums in as many parts as the root of the shuffle partitions, and the driver solves one system of fixed size. Raw scores are
turned into probabilities by isotonic regression over ``bins`` counted bins, fitted on labelled rows that the
ridge has not seen; a higher raw score never gets a lower probability.

All labelled rows are used; nothing is sampled. Statistics are computed once for every row, in place; only the
statistics are joined to the labels.

Defined cases: null and empty texts have statistics of zeros and are scored as such; several labels of one id
each count as a row; null labels are left out; without any label (or with one class only) every score is the
share of label 1, or 0.5; rows with null id are scored, never learned from and not held out; repeated rows are
scored each; an empty table gives no rows; a text of any length is read whole, and a task holds 256 texts at once;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandmill.llm import common

WIDTH, GAMMA, RIDGE, BINS, THRESHOLD, SEED = 256, 0.01, 0.1, 512, 0.3, 20240229
N_STATS = 24
_LETTER_RUN = re.compile(r"[^\W\d_]+")


def statistics(text: str | None) -> list[float]:
    """Statistics of one text; each is finite and zero for an empty text."""
    words = (text or "").split()
    if not words:
        return [0.0] * N_STATS
    n, m = len(text), len(words)
    lines = text.split("\n")
    lengths = np.fromiter(map(len, words), np.int64, m)
    counts = Counter(words)
    bare = Counter(w.strip("#$%&*!|.,;:").lower() for w in words)
    ends = Counter(w[-1] for w in words)
    pairs = len(set(zip(words, words[1:])))
    top = max(counts.values())
    upper = sum(map(str.isupper, words))
    alpha = sum(map(str.isalpha, words))
    letters = sum(map(len, _LETTER_RUN.findall(text)))
    digits = sum(map(text.count, "0123456789"))
    marks = [text.count(c) / m for c in "#$%&*!|"]
    line_lengths = np.fromiter(map(len, lines), np.int64, len(lines))
    return [
        np.log1p(n), np.log1p(m), lengths.mean(), lengths.std(), np.log1p(lengths.max()),
        len(counts) / m, len(bare) / m, top / m, pairs / m, upper / m, alpha / m, letters / n, digits / n,
        *np.log1p(marks), sum(ends[c] for c in ".!?") / m, np.log1p(line_lengths.mean()), len(set(lines)) / len(lines), ends[","] / m,
    ]


def with_statistics(docs: DataFrame, text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """The rows with their statistics as the last column; in place of the text, or after it with ``keep_text``.

    The column is called ``stats``, or ``stats_`` (and so on) where that name is taken.
    """
    made = common.fresh(docs.columns, "stats")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [statistics(t) for t in common.values(b.column(b.num_columns - 1))]
            rest = b.num_columns - (not keep_text)
            yield pa.RecordBatch.from_arrays([*b.columns[:rest], pa.array(found, pa.list_(pa.float64()))], names=[*b.schema.names[:rest], made])

    name = text_col if keep_text else common.fresh(docs.columns, "text")
    own = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c != text_col), F.col(f"`{text_col}`").cast("string").alias(name))
    passed = own.schema.fields if keep_text else own.schema.fields[:-1]
    return own.mapInArrow(run, T.StructType([*passed, T.StructField(made, T.ArrayType(T.DoubleType()))]))


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    edges: np.ndarray
    levels: np.ndarray
    prior: float

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return cosines((stats - self.mean) / self.scale) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        if not len(self.weights):
            return np.full(len(stats), self.prior)
        return np.interp(self.raw(stats), self.edges, self.levels)


def cosines(x: np.ndarray) -> np.ndarray:
    """Random Fourier features of standardised rows, with a constant column."""
    rng = np.random.default_rng(SEED)
    w = rng.normal(scale=np.sqrt(2 * GAMMA), size=(x.shape[1], WIDTH))
    phase = rng.uniform(0, 2 * np.pi, WIDTH)
    return np.hstack([np.sqrt(2 / WIDTH) * np.cos(np.clip(x, -6, 6) @ w + phase), np.ones((len(x), 1))])


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), N_STATS)


def _normal_equations(rows: DataFrame, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Sums of z'z and z'y over all rows (stats, y), as one matrix of WIDTH + 1 by WIDTH + 2."""
    shape = (WIDTH + 1, WIDTH + 2)

    def add_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for b in batches:
            z = cosines((_matrix(b.column(0)) - mean) / scale)
            total += z.T @ np.hstack([z, b.column(1).to_numpy(zero_copy_only=False)[:, None]])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    def add_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for b in batches:
            for x in b.column(0).to_pylist():
                total += np.frombuffer(x).reshape(shape)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    sums = max(4, math.isqrt(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    parts = rows.select("stats", "y").mapInArrow(add_rows, "sums binary").repartition(sums).mapInArrow(add_sums, "sums binary").collect()
    return sum((np.frombuffer(r["sums"]).reshape(shape) for r in parts), np.zeros(shape))


def isotonic(scores: np.ndarray, ones: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over ordered bins; gives the pools' mean scores and levels."""
    pools: list[list[float]] = []
    for s, k, n in zip(scores, ones, counts):
        pools.append([s * n, k, n])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    return np.array([p[0] / p[2] for p in pools]), np.array([p[1] / p[2] for p in pools])


def fit(labelled: DataFrame, calibrate: Column) -> Model:
    """``labelled``: stats, y (0 or 1). Rows where ``calibrate`` holds are kept from the ridge."""
    rows = common.stored(labelled.select("stats", F.col("y").cast("double").alias("y"), calibrate.alias("later")), "labelled")
    each = [F.element_at("stats", i + 1) for i in range(N_STATS)]
    sums = rows.where("NOT later").agg(F.count("y"), F.sum("y"), *(f(c) for c in each for f in (F.avg, F.stddev_pop))).first()
    n, ones = sums[0], sums[1] or 0.0
    blank = np.zeros(N_STATS)
    if not n or ones in (0, n):
        return Model(blank, blank + 1, np.empty(0), np.empty(0), np.empty(0), ones / n if n else 0.5)
    mean, scale = np.array(sums[2::2], float), np.array(sums[3::2], float)
    scale[scale < 1e-9] = 1
    total = _normal_equations(rows.where("NOT later"), mean, scale)
    a = total[:, :-1] + RIDGE * np.diag([1.0] * WIDTH + [0.0])
    model = Model(mean, scale, np.linalg.solve(a, total[:, -1]), np.array([0.0, 1.0]), np.array([0.0, 1.0]), ones / n)

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = np.clip(model.raw(_matrix(b.column(0))), -1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(((raw + 1) / 3 * BINS).astype(np.int64)), pa.array(raw), b.column(1)], names=["bin", "raw", "y"])

    counted = rows.where("later").select("stats", "y").mapInArrow(bins, "bin long, raw double, y double")
    found = counted.groupBy("bin").agg(F.avg("raw"), F.sum("y"), F.count("y")).orderBy("bin").collect()
    if found:
        model.edges, model.levels = isotonic(*(np.array([r[i] for r in found], float) for i in (1, 2, 3)))
    else:
        model.levels = np.array([0.0, 1.0])
    return model


def score(rows: DataFrame, model: Model) -> DataFrame:
    """Rows with statistics as their last column; gives the other columns and ``score`` (``score_`` where taken)."""
    made = common.fresh(rows.columns, "score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = model.score(_matrix(b.column(b.num_columns - 1)))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(got, pa.float64())], names=[*b.schema.names[:-1], made])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[:-1], T.StructField(made, T.DoubleType())]))


def learn(stats: DataFrame, labels: DataFrame) -> Model:
    """Fit on labelled ids outside the held-out fold; a quarter of them is kept for calibration."""
    part = common.fold(F.col("doc_id"), 5)
    known = labels.select("doc_id", F.col("quality").alias("y")).where((part != 0) & F.col("y").isin(0, 1))
    return fit(stats.select("doc_id", "stats").join(known, "doc_id").withColumn("part", part), F.col("part") == 4)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    stats = common.stored(with_statistics(docs), "stats")
    model = learn(stats, common.table(spark, sf_dir, "labels"))
    scored = score(stats, model)
    return scored.select("doc_id", F.coalesce(common.fold(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
