"""The motif query: words of length l that occur within d edits in all reads, or in a quorum of them."""

from __future__ import annotations

import math
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.functions.sequence import distance_to
from strandmill.operators import bitmap, neighbours, verify, walk
from strandmill.sources import reads as R

#: Fixed value: how a file's name states its parameters, as in planted_l11_d3.txt.
NAMED = r"_l(\d+)_d(\d+)"
ROW_SECONDS = 1e-7  # one word near one word of a read, by rows
CHEAP_SECONDS = 1e-3  # bitmaps that take no longer are taken without measuring the reads


@dataclass(frozen=True)
class MotifQuery:
    """``quorum`` is a share of the reads, exact as it is written (0.55 of 100 reads are 55); 1 asks for all.

    Every row of the reads is one read. ``strategy``: walk, bitmap, rows, or auto, which takes what costs least for reads of
    the given length: the walk for words of any length up to 31, bitmaps for long reads and short words where they fit in
    memory, rows for the longest words. All give the same rows.
    """

    l: int  # noqa: E741
    d: int
    quorum: float | Decimal = 1
    strategy: str = "auto"

    def __post_init__(self):
        if self.l <= 0 or self.d < 0 or not 0 < self.quorum <= 1 or self.strategy not in ("auto", "walk", "bitmap", "rows"):
            raise ValueError(f"bad parameters: {self}")

    def least(self, n_reads: int) -> int:
        return max(1, math.ceil(Decimal(str(self.quorum)) * n_reads))

    def by_walk(self, bases: float) -> bool:
        """Whether the walk is the best way for reads of so many bases."""
        if self.strategy != "auto":
            return self.strategy == "walk"
        cheaper = not bitmap.fits(self.l, self.d) or walk.seconds(self.l, self.d, bases) < bitmap.seconds(self.l, self.d)
        return walk.fits(self.l, self.d) and cheaper

    def by_bitmap(self, bases: float) -> bool:
        """Whether bitmaps are a better way than rows for reads of so many bases."""
        if self.strategy != "auto":
            return self.strategy == "bitmap"
        words = sum(min(bases, 4**k) for k in range(max(1, self.l - self.d), self.l + self.d + 1))
        by_rows = ROW_SECONDS * words * neighbours.most_near(self.l, self.d)
        return bitmap.fits(self.l, self.d) and bitmap.seconds(self.l, self.d) <= max(by_rows, CHEAP_SECONDS)

    def run(self, reads: DataFrame, consensus: str = "") -> DataFrame:
        """(motif, n_reads, distance) for reads (sid, seq)."""
        size = walk.measured(reads, self.strategy != "rows")
        bases = size.bases / max(1, size.reads)
        if self.by_walk(bases):
            return self._kept(walk.frontier(reads, self.l, self.d, self.least(size.reads), size), size.reads, consensus)
        if not self.by_bitmap(bases):
            return self._kept(neighbours.supports(reads, self.l, self.d, size.tasks), size.reads, consensus)
        cores = reads.sparkSession.sparkContext.defaultParallelism
        if size.tasks < cores:  # a small source in few splits; larger ones stay where they are
            reads = reads.select("seq").repartition(cores)
        return self._kept(bitmap.supports(reads, self.l, self.d), size.reads, consensus)

    def verify(self, candidates: DataFrame, reads: DataFrame, consensus: str = "") -> DataFrame:
        """What ``run`` gives of the candidates (w); for words that are too long to enumerate."""
        return self._kept(verify.supports(candidates, reads, self.l, self.d), reads.count(), consensus)

    def _kept(self, supports: DataFrame, n_reads: int, consensus: str) -> DataFrame:
        kept = supports.where(F.col("n_reads") >= self.least(n_reads))
        return kept.select(F.col("w").alias("motif"), "n_reads", distance_to(F.col("w"), F.lit(consensus)).alias("distance"))


def search_files(lines: DataFrame, quorum: float | Decimal = 1, l: int = 11, d: int = 3, header_mode: str = "strict") -> DataFrame:  # noqa: E741
    """(file, l, d, reads, motif, n_reads, distance): the motifs of each file (file, line_no, raw), all files in one plan.

    A file's name states its l and d; those given hold for names that don't. Each file has its own number of reads, quorum and
    consensus. Files without a read, and l of 0 or over 31, give no motifs.
    """
    named = lambda part, other: F.coalesce(F.try_to_number(F.nullif(F.regexp_extract("file", NAMED, part), F.lit("")), F.lit("999")).cast("int"), F.lit(other))
    own = R.reads(lines, header_mode).select("file", "seq", named(1, l).alias("l"), named(2, d).alias("d")).where((F.col("l") > 0) & (F.col("l") <= neighbours.LONGEST) & (F.col("l") + F.col("d") <= 48))
    share = F.lit(Decimal(str(quorum))) * F.count(F.lit(1)).cast("decimal(18,0)")
    totals = own.groupBy("file", "l", "d").agg(F.count(F.lit(1)).alias("reads"), F.greatest(F.ceil(share), F.lit(1)).cast("long").alias("least"))
    totals = R.stored(totals, "files")
    limits = totals.select("file", (F.col("reads") - F.col("least")).alias("misses"))
    found = walk.supports_by(own.join(limits, "file"), "file").join(totals, "file").where(F.col("n_reads") >= F.col("least"))
    stated = R.consensus(lines)
    known = found.join(stated, "file", "left").withColumn("consensus", F.coalesce("consensus", F.lit("")))
    return known.select("file", "l", "d", "reads", F.col("w").alias("motif"), "n_reads", distance_to(F.col("w"), F.col("consensus")).alias("distance"))
