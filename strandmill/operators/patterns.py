"""Edit neighbourhoods as wildcard patterns: sets of words written as one number each.

A pattern has 4 bits a place, one for each base that may stand there, and a 1 before the first place. A substituted or
inserted base is a place with all bits, so a pattern stands for up to 4^d words, and each edit makes a quarter of the
rows or less. Two patterns have the words in common that the AND of their bits has; there are none if a place is left
without a bit. Patterns are written out as words only at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandmill.functions.sequence import BASES, unpack

LONGEST = 15  # places that a BIGINT holds with the 1 before them
ALL = 15


def _shifted(c: Column, places: int) -> Column:
    return F.shiftleft(c, 4 * places) if places >= 0 else F.shiftright(c, -4 * places)


def from_word(x: Column) -> Column:
    """A word of up to 15 bases as a pattern."""
    return F.conv(F.concat(F.lit("1"), F.translate(x, BASES, "1248")), 16, 10).cast("long")


def to_text(p: Column) -> Column:
    """A pattern in letters: bases, ``*`` for any base; other sets of bases as a hexadecimal digit."""
    return F.translate(F.substring(F.conv(p.cast("string"), 10, 16), 2, LONGEST), "1248F", BASES + "*")


def _longer(n: int) -> Column:
    return F.lit(1 << 4 * n).cast("long")


def _edited(p: Column, l: int, left: int) -> Column:  # noqa: E741
    """Patterns one edit from p, of lengths from which l places can be reached with ``left`` edits more; a base changed to any base includes itself."""
    low = lambda i: p.bitwiseAND(F.lit((1 << 4 * i) - 1).cast("long"))
    every = lambda i: F.lit(ALL << 4 * i).cast("long")
    made = F.array().cast("array<bigint>")
    for n in range(max(1, l - left - 1), l + left + 2):
        out = []
        if abs(n - l) <= left:
            out += [p.bitwiseOR(every(i)) for i in range(n)]
        if abs(n - 1 - l) <= left and n > 1:
            out += [_shifted(_shifted(p, -i - 1), i).bitwiseOR(low(i)) for i in range(n)]
        if abs(n + 1 - l) <= left:
            out += [_shifted(_shifted(p, -i), i + 1).bitwiseOR(low(i)).bitwiseOR(every(i)) for i in range(n + 1)]
        made = F.when((p >= _longer(n)) & (p < _longer(n + 1)), F.array(*out)).otherwise(made)
    return F.array_distinct(made)


def neighbourhood(words: DataFrame, l: int, d: int) -> DataFrame:  # noqa: E741
    """(x, p): patterns of l places whose words are those within d edits of x, for distinct words x; l + d is at most 15."""
    if l + d > LONGEST:
        raise ValueError(f"patterns hold {LONGEST} places; l + d is {l + d}")
    layer = words.where((F.length("x") > 0) & (F.abs(F.length("x") - l) <= d)).select("x", from_word(F.col("x")).alias("p"))
    for left in range(d - 1, -1, -1):
        layer = layer.select("x", F.explode(_edited(F.col("p"), l, left)).alias("p")).distinct()
    return layer


def _choices(p: Column, l: int, places: range) -> Column:  # noqa: E741
    """Codes, 2 bits a base, of all words that a pattern of l places allows at some places in a row."""
    codes = F.array(F.lit(0).cast("long"))
    for i in places:
        codes = F.flatten(F.transform(codes, _with_base(F.shiftright(p, 4 * (l - 1 - i)))))
    return codes


def _with_base(nibble: Column):
    allowed = [nibble.bitwiseAND(F.lit(1 << b)) != 0 for b in range(4)]
    return lambda code: F.filter(F.array(*(F.when(a, 4 * code + b) for b, a in enumerate(allowed))), lambda x: x.isNotNull())


def expanded(patterns: DataFrame, l: int, *keep: str) -> DataFrame:  # noqa: E741
    """(keep, w), each once: the words of patterns (keep, p)."""
    return patterns.select(*keep, F.explode(_choices(F.col("p"), l, range(l))).alias("code")).distinct().select(*keep, unpack(F.col("code"), F.lit(l)).alias("w"))


def intersection(a: DataFrame, b: DataFrame, l: int, d: int) -> DataFrame:  # noqa: E741
    """(p): patterns of the words in some pattern of a and some pattern of b, both of l places.

    Patterns meet where their first l - d - 1 places can be the same bases: those are written out (a wildcard there
    makes four rows) as the key of an equality join, and stay fixed in what is found; only the places behind it are compared.
    """
    first = max(1, l - d - 1)
    rest = (1 << 4 * (l - first)) - 1

    def keyed(patterns: DataFrame, name: str) -> DataFrame:
        tail = F.col("p").bitwiseAND(F.lit(rest).cast("long")).alias(name)
        return patterns.select(F.explode(_choices(F.col("p"), l, range(first))).alias("key"), tail).distinct()

    both = F.col("a").bitwiseAND(F.col("b"))
    met = keyed(a, "a").join(keyed(b, "b"), "key").select("key", both.alias("tail")).distinct()
    whole = F.lit(True)
    for i in range(l - first):
        whole &= F.shiftright("tail", 4 * i).bitwiseAND(F.lit(ALL)) != 0
    head = F.lit(1).cast("long")
    for i in range(first):
        base = F.shiftright("key", 2 * (first - 1 - i)).bitwiseAND(F.lit(3)).cast("int")
        head = F.shiftleft(head, 4).bitwiseOR(F.element_at(F.array(*(F.lit(1 << b).cast("long") for b in range(4))), base + 1))
    return met.where(whole).select(F.shiftleft(head, 4 * (l - first)).bitwiseOR(F.col("tail")).alias("p"))
