"""Supports of given candidates.

Words of up to 31 bases are compared with all reads in one walk over their common prefixes. Longer words, and those with
other letters, are met by pieces: a substring within d edits of a word holds one of the word's d + 1 pieces unchanged,
near the piece's own place, so reads meet candidates in an equality join on pieces, and only the substrings around a met
piece are compared.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.functions.sequence import substrings
from strandmill.operators import walk
from strandmill.operators.neighbours import dealt

BROADCAST_BYTES = 16 << 20


def _pieces(l: int, d: int) -> list[tuple[int, int]]:  # noqa: E741
    """(start, length) of d + 1 pieces, as even as may be."""
    cuts = [l * i // (d + 1) for i in range(d + 2)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def supports(candidates: DataFrame, reads: DataFrame, l: int, d: int) -> DataFrame:  # noqa: E741
    """(w, n_reads) of the candidates (w), all of length l, that are within d edits of a substring of some read.

    Every row of reads is one read. Where l <= d the empty substring is within d edits of any word.
    """
    words = candidates.select("w").where(F.length("w") == l).distinct()
    if l <= d:
        return words.crossJoin(dealt(reads).agg(F.count(F.lit(1)).alias("n_reads"))).where("n_reads > 0")
    if not walk.fits(l, d):
        return _by_pieces(words, reads, l, d)
    plain = F.col("w").rlike("^[ACGT]*$")
    odd, found = words.where(~plain), walk.given_supports(words.where(plain), reads, l, d)
    return found if odd.isEmpty() else found.unionByName(_by_pieces(odd, reads, l, d))


def _by_pieces(words: DataFrame, reads: DataFrame, l: int, d: int) -> DataFrame:  # noqa: E741
    own = dealt(reads)
    pieces = F.array(*(F.struct(F.lit(a).alias("start"), F.substring("w", a + 1, n).alias("piece")) for a, n in _pieces(l, d)))
    known = words.select("w", F.explode(pieces).alias("p")).select("w", "p.start", "p.piece")
    if words.count() * (d + 1) * (2 * l + 64) <= BROADCAST_BYTES:
        known = F.broadcast(known)
    sizes = {n for _, n in _pieces(l, d)}
    at = F.posexplode(F.concat(*(F.transform(substrings(F.col("seq"), n, n), lambda x, i: F.struct(i.alias("at"), x.alias("piece"))) for n in sorted(sizes))))
    met = own.select("read", "seq", at.alias("i", "p")).select("read", "seq", "p.at", "p.piece").join(known, "piece")
    # A substring within d edits that keeps the piece starts within d places of where the word would start.
    start = F.greatest(F.lit(0), F.col("at") - F.col("start") - d)
    around = F.substring("seq", start + 1, F.col("at") - F.col("start") + l + d - start)
    met = met.select("read", "w", around.alias("around")).distinct()
    near = F.exists(substrings(F.col("around"), l - d, l + d), lambda x: F.levenshtein(x, F.col("w"), d) >= 0)
    return met.where(near).select("read", "w").distinct().groupBy("w").agg(F.count(F.lit(1)).alias("n_reads"))
