"""Extension: k-mer counts of reads that arrive as text files, kept by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.functions.sequence import encoded, normalised
from strandmill.operators.neighbours import kmers


def read_stream(spark: SparkSession, folder: str) -> DataFrame:
    """(sid, seq): each line of a new file is a read; header lines with ``>`` and empty lines are left out."""
    seq = normalised(F.col("value"))
    lines = spark.readStream.text(folder).where((seq != "") & ~seq.startswith(">"))
    return lines.select(F.xxhash64("value").alias("sid"), encoded(seq).alias("seq"))


def kmer_stream(reads: DataFrame, l: int) -> DataFrame:  # noqa: E741
    """(x, n) of all reads so far; the state is at most 4^l rows."""
    return kmers(reads, l).groupBy("x").agg(F.count(F.lit(1)).alias("n"))
