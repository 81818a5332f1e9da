"""Column functions over sequences of A, C, G and T."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BASES = "ACGT"


def normalised(raw: Column) -> Column:
    """A line as a read: without white space around it, upper case, U as T."""
    return F.translate(F.upper(F.regexp_replace(raw, r"^\s+|\s+$", "")), "U", "T")


def encoded(seq: Column) -> Column:
    """Every character other than A, C, G and T becomes A."""
    return F.regexp_replace(seq, "[^ACGT]", "A")


def text_as_read(text: Column) -> Column:
    """Any text as a read; non-letters go first, so case folding sees ASCII only and no white space is left around it."""
    return encoded(F.translate(F.upper(F.regexp_replace(F.coalesce(text, F.lit("")), "[^A-Za-z]", "A")), "U", "T"))


def decoded(digits: Column) -> Column:
    """Codes as letters: 0 to 3 are bases, 4 and whatever is no digit the wildcard ``*``, other digits ``?``."""
    return F.translate(F.regexp_replace(F.regexp_replace(digits, "(?s)[^0-9]", "*"), "[5-9]", "?"), "01234", "ACGT*")


def pack(seq: Column) -> Column:
    """2 bits a base, the first base highest; at most 31 bases fit a BIGINT in order. Empty is 0."""
    return F.when(seq == "", F.lit(0)).otherwise(F.conv(F.translate(seq, BASES, "0123"), 4, 10)).cast("long")


def unpack(code: Column, length: Column) -> Column:
    return F.translate(F.lpad(F.conv(code.cast("string"), 10, 4), length, F.lit("0")), "0123", BASES)


def two_bits(code: Column, place: Column) -> Column:
    """The 2 bits at a place counted from the last base."""
    return F.call_function("shiftrightunsigned", code, (2 * place).cast("int")).bitwiseAND(F.lit(3))


def bit(mask: Column, place: Column) -> Column:
    """The bit of a mask at a place counted from the last character."""
    return F.call_function("shiftrightunsigned", mask, place.cast("int")).bitwiseAND(F.lit(1))


def wildcard_mask(pattern: Column) -> Column:
    """1 bit a character, set where the pattern has ``*``; the first character highest."""
    chars = F.filter(F.split(pattern, ""), lambda c: c != "")
    return F.aggregate(chars, F.lit(0).cast("long"), lambda acc, c: F.shiftleft(acc, 1).bitwiseOR(F.when(c == "*", F.lit(1).cast("long")).otherwise(F.lit(0).cast("long"))))


def substrings(seq: Column, least: int, most: int) -> Column:
    """Array of all substrings of ``least`` to ``most`` characters (at least 1), repeats included.

    A look-ahead matches at every place, so the text is walked once for each length.
    """
    parts = [F.regexp_extract_all(seq, F.lit(f"(?s)(?=(.{{{k}}}))"), F.lit(1)) for k in range(max(1, least), most + 1)]
    return F.concat(*parts) if parts else F.array().cast("array<string>")


def found_within(seq: Column, word: str, d: int) -> Column:
    """Whether a substring of the read is within edit distance d of the word."""
    n = len(word)
    return F.exists(substrings(seq, n - d, n + d), lambda x: F.levenshtein(x, F.lit(word), d) >= 0)


def distance_to(motif: Column, consensus: Column) -> Column:
    """Edit distance where the consensus is known and as long as the motif, else null."""
    same = (F.length(consensus) > 0) & (F.length(motif) == F.length(consensus))
    return F.when(same, F.levenshtein(motif, consensus).cast("long"))
