"""Seeded planted test data, the same in Spark and in SQL."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.functions.sequence import BASES
from strandmill.sources.reads import write_file

HEX, AS_BASES = "0123456789abcdef", "ACGTACGTACGTACGT"


def random_bases(seed: Column, length: int = 32) -> Column:
    """Bases from the MD5 of a text; beyond 32 from those of the text with a number after it."""
    blocks = [seed.cast("string"), *(F.concat(seed.cast("string"), F.lit(f"/{i}")) for i in range(1, -(-length // 32)))]
    return F.substring(F.translate(F.concat(*(F.md5(b.cast("binary")) for b in blocks)), HEX, AS_BASES), 1, length)


def small_number(seed: Column, below: Column | int) -> Column:
    """0 to below - 1 from the MD5 of a text; 0 where ``below`` is less than 1."""
    most = F.greatest(below if isinstance(below, Column) else F.lit(below), F.lit(1))
    return F.pmod(F.conv(F.substring(F.md5(seed.cast("binary")), 1, 8), 16, 10).cast("long"), most).cast("int")


def random_motif(seed: int | str, l: int) -> str:  # noqa: E741
    rng = random.Random(f"motif {seed}")
    return "".join(rng.choices(BASES, k=l))


def planted(rows: DataFrame, key: Column, motif: str, d: int, length: int = 32, seed: str = "") -> DataFrame:
    """(sid, edited, pos, seq): a read for each key with an edited motif written over it; pos counts from 0.

    ``d`` edits: 0 to d deletions, then 0 to d - deletions insertions, the rest substitutions by another base, each at
    any place of the word so far. All draws are hashes of ``seed`` and key. An edited motif longer than the read is not planted; its pos is 0.
    """
    text = F.concat(F.lit(seed), F.col("sid").cast("string"))
    draw = lambda name, below: small_number(F.concat(text, F.lit(name)), below)
    out = rows.select(key.alias("sid")).withColumn("edited", F.lit(motif)).withColumn("deletions", draw("deletions", d + 1))
    out = out.withColumn("insertions", draw("insertions", d + 1 - F.col("deletions")))
    edited, size = F.col("edited"), F.length("edited")
    for i in range(d):
        inserts = (F.lit(i) >= F.col("deletions")) & (F.lit(i) < F.col("deletions") + F.col("insertions"))
        out = out.withColumn("at", draw(f"at{i}", size + inserts.cast("int")) + 1)
        at = F.col("at")
        head, tail = F.substring(edited, F.lit(1), at - 1), F.substring(edited, at + 1, size)
        added = F.concat(head, F.substring(F.lit(BASES), draw(f"i{i}", 4) + 1, F.lit(1)), F.substring(edited, at, size))
        other = (F.instr(F.lit(BASES), F.substring(edited, at, F.lit(1))) + draw(f"s{i}", 3)) % 4 + 1
        changed = F.when(size > 0, F.concat(head, F.substring(F.lit(BASES), other, F.lit(1)), tail)).otherwise(edited)
        out = out.withColumn("edited", F.when(F.lit(i) < F.col("deletions"), F.concat(head, tail)).when(inserts, added).otherwise(changed))
    out = out.withColumn("read", random_bases(text, length)).withColumn("pos", draw("pos", F.length("read") - size + 1).cast("long"))
    seq = F.when(size > F.length("read"), F.col("read")).otherwise(F.overlay("read", "edited", F.col("pos").cast("int") + 1, size))
    return out.select("sid", "edited", "pos", seq.alias("seq"))


def generate(spark: SparkSession, n: int, length: int, l: int, d: int, seed: int | str) -> DataFrame:  # noqa: E741
    """(sid, motif, edited, pos, seq): n planted reads with a random motif of l bases."""
    motif = random_motif(seed, l)
    return planted(spark.range(n), F.col("id"), motif, d, length, f"{seed}:").withColumn("motif", F.lit(motif))


def write_planted(rows: DataFrame, path: str) -> None:
    """Two lines for each read, what was planted and the read, as one text file in order."""
    said = F.concat(F.col("sid").cast("string"), F.lit(" Motif "), "motif", F.lit(" planted as "), "edited", F.lit(" at position "), F.col("pos").cast("string"))
    write_file(rows.orderBy("sid").select(F.concat(said, F.lit("\n"), "seq").alias("value")), path)
