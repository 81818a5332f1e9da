"""K-mers, edits and edit neighbourhoods as DataFrame operators.

Neighbourhoods of words of up to 31 bases come from the distance automaton of each word. For longer words they are made
in layers, once for each distinct k-mer: a layer adds one edit and is made distinct before the next; words that can no
longer reach the wanted length are dropped before they are expanded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandmill.functions.sequence import BASES, encoded, substrings, unpack
from strandmill.operators import automaton

LONGEST = 31  # bases that a BIGINT holds with their number
TASK_BASES = 1 << 21  # bases of the reads whose words a task makes distinct
BROADCAST_ROWS = 1 << 25  # pairs of a word and a neighbour that a worker may keep, 4 bytes each


def kmers(reads: DataFrame, l: int, d: int = 0) -> DataFrame:  # noqa: E741
    """(sid, x): every substring of l - d to l + d bases, repeats included."""
    return reads.select("sid", F.explode(substrings(F.col("seq"), l - d, l + d)).alias("x"))


def _bases() -> Column:
    return F.array(*map(F.lit, BASES))


def deletions(x: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, F.length(x))))


def substitutions(x: Column) -> Column:
    """The unchanged word is among them."""
    return F.flatten(F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: F.transform(_bases(), lambda b: F.concat(F.substring(x, F.lit(1), i - 1), b, F.substring(x, i + 1, F.length(x))))))


def insertions(x: Column) -> Column:
    return F.flatten(F.transform(F.sequence(F.lit(0), F.length(x)), lambda i: F.transform(_bases(), lambda b: F.concat(F.substring(x, F.lit(1), i), b, F.substring(x, i + 1, F.length(x))))))


def edits(words: DataFrame, make, column: str = "x") -> DataFrame:
    return words.select(column, F.explode(make(F.col(column))).alias("w"))


def neighbourhood(words: DataFrame, l: int, d: int) -> DataFrame:  # noqa: E741
    """(x, w): all words w of length l within d edits of the distinct words x."""
    if l + d > LONGEST:
        return _neighbourhood_of_text(words, l, d)
    return automaton.neighbourhood(words, l, d).select("x", unpack(F.col("code"), F.lit(l)).alias("w"))


def _neighbourhood_of_text(words: DataFrame, l: int, d: int) -> DataFrame:  # noqa: E741
    layer = words.select("x", F.col("x").alias("w")).where(F.abs(F.length("w") - l) <= d)
    for left in range(d - 1, -1, -1):
        near = [F.when(F.length("w") > 1, deletions(F.col("w"))).otherwise(F.array().cast("array<string>")), substitutions(F.col("w")), insertions(F.col("w"))]
        grown = layer.select("x", F.explode(F.concat(F.array("w"), *near)).alias("w"))
        layer = grown.where(F.abs(F.length("w") - l) <= left).distinct()
    return layer


def numbered(reads: DataFrame) -> DataFrame:
    """(read, seq): prepared reads with a number each, which follows the order in which the source is scanned."""
    return prepared(reads).withColumn("read", F.monotonically_increasing_id())


def distinct_kmers(reads: DataFrame, l: int) -> DataFrame:  # noqa: E741
    """(x): the distinct substrings of l bases.

    Reads are dealt before they grow, as many tasks as keep each below about ``TASK_BASES`` bases: what a task makes
    distinct before the shuffle is bounded, however few splits the source has and however many reads.
    """
    own = numbered(reads)
    bases = own.agg(F.sum(F.length("seq"))).first()[0] or 0
    n = max(int(reads.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-bases // TASK_BASES))
    return own.repartition(n, "read").select(F.explode(substrings(F.col("seq"), l, l)).alias("x")).distinct()


def dealt(reads: DataFrame) -> DataFrame:
    """Numbered reads by number: they will grow a hundredfold, so all tasks get some, and what is made of a read stays in its task."""
    return numbered(reads).repartition(int(reads.sparkSession.conf.get("spark.sql.shuffle.partitions")), "read")


def spread(rows: DataFrame, tasks: int = 0) -> DataFrame:
    """Rows that will grow, over all tasks, unless they are in that many ``tasks`` already; Spark deals the same rows the same way when a task runs again."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows if tasks >= n else rows.repartition(n)


def own_words(numbered: DataFrame, l: int, d: int = 0) -> DataFrame:  # noqa: E741
    """(read, x): the distinct substrings of each read; they are made distinct where the read stands, without a shuffle."""
    return numbered.select("read", F.explode(F.array_distinct(substrings(F.col("seq"), l - d, l + d))).alias("x"))


def prepared(reads: DataFrame) -> DataFrame:
    """(seq): every row is one read, whatever its sid; null is a read without bases, other letters than ACGT count as A."""
    return reads.select(encoded(F.coalesce("seq", F.lit(""))).alias("seq"))


def supports(reads: DataFrame, l: int, d: int, tasks: int = 0) -> DataFrame:  # noqa: E741
    """(w, n_reads): in how many reads each word of length l has a substring within d edits.

    Reads are dealt before they grow, unless they are known to be in enough ``tasks``, so whatever is made distinct for a
    read needs no shuffle; only counts by word are shuffled, added up before. Where all words there can be and their
    neighbourhoods are few (short words, that many reads share), a worker keeps the neighbours of the words it has met;
    otherwise each read's words are walked in place.
    """
    if l + d > LONGEST:
        own = own_words(dealt(reads), l, d)
        near = neighbourhood(own.select("x").distinct(), l, d)
        return own.join(near, "x").select("read", "w").distinct().groupBy("w").agg(F.count(F.lit(1)).alias("n_reads"))
    if l + d <= automaton.LONGEST_KEPT and _most_words(l, d) * most_near(l, d) <= BROADCAST_ROWS:
        counts = automaton.read_counts(spread(prepared(reads), tasks), l, d).groupBy("code").agg(F.sum("n").alias("n_reads"))
    else:
        counts = automaton.read_words(spread(prepared(reads), tasks), l, d).groupBy("code").agg(F.count(F.lit(1)).alias("n_reads"))
    return counts.select(unpack(F.col("code"), F.lit(l)).alias("w"), "n_reads")


def _most_words(l: int, d: int) -> int:  # noqa: E741
    return sum(4**k for k in range(max(1, l - d), l + d + 1))


def most_near(l: int, d: int) -> int:  # noqa: E741
    """A bound of the words of length l within d edits of one word: each edit has less than 8 l + 8 d + 4 ways."""
    return min(4**l, (8 * (l + d) + 5) ** d)


def intersection(parts: list[DataFrame]) -> DataFrame:
    """Words in all parts, by one shuffle."""
    tagged = [p.select("w", F.lit(i).alias("part")) for i, p in enumerate(parts)]
    both = tagged[0]
    for t in tagged[1:]:
        both = both.unionAll(t)
    return both.groupBy("w").agg(F.count_distinct("part").alias("n")).where(F.col("n") == len(parts)).select("w")


def merged(parts: list[DataFrame]) -> DataFrame:
    """Words in any part, each once."""
    out = parts[0].select("w")
    for p in parts[1:]:
        out = out.unionAll(p.select("w"))
    return out.distinct()


def plans(l: int, d: int) -> list[tuple[int, int, int, int]]:  # noqa: E741
    """(q, deletions, substitutions, insertions) that turn a word of l + q into one of l with d edits."""
    return [(q, p, d - p - (p - q), p - q) for q in range(-d, d + 1) if l + q > 0 for p in range(max(0, q), (d + q) // 2 + 1)]
