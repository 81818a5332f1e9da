"""The ``ems2p`` variant: a narrower query, kept apart from the exact engine.

Wildcards count as A and only prefixes are deleted. A read's candidates have a closed form: for each k-mer and plan,
drop a prefix, set up to the planned number of places (one at least, if any) to A, insert As anywhere. Reads are
folded in order: the running set is intersected with a read's candidates unless nothing would be left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandmill.functions.sequence import encoded, substrings
from strandmill.sources import reads as R

SEGMENT = 64  # bases of a read whose candidates are one array


def _plans(l: int, d: int) -> list[tuple[int, int, int, int]]:  # noqa: E741
    out = []
    for q in range(-d, d + 1):
        if l + q <= 0:
            continue
        if q > 0:
            out.append((q, q, d - q, 0))
        else:
            out.append((q, 0, d + q, -q))
            if d + q >= 2:
                out.append((q, 1, d - 2 + q, 1 - q))
    return out


def _with_a(x: Column, insert: bool) -> Column:
    first = 0 if insert else 1
    places = F.sequence(F.lit(first), F.length(x))
    return F.transform(places, lambda i: F.concat(F.substring(x, F.lit(1), i if insert else i - 1), F.lit("A"), F.substring(x, i + 1, F.length(x))))


def _tagged(plan: int):
    return lambda x: F.struct(F.lit(plan).alias("plan"), x.alias("word"))


def _without(drop: int):
    return lambda x: F.substring(x, F.lit(drop + 1), F.length(x))


def _each_with_a(insert: bool):
    return lambda w: F.when(F.length(w) > 0, _with_a(w, insert)).otherwise(F.array(F.lit("A")) if insert else F.array().cast("array<string>"))


def _ordered(reads: DataFrame, by: str | None) -> DataFrame:
    """(group, read, sid, seq): every row is one read; reads are ordered by sid (null first), those of one sid as the source is scanned."""
    group = (F.col(by) if by else F.lit(0)).alias("group")
    seq = encoded(F.coalesce("seq", F.lit("")))
    return reads.select(group, F.struct("sid", F.monotonically_increasing_id().alias("at")).alias("read"), "sid", seq.alias("seq"))


def candidates(reads: DataFrame, l: int, d: int, by: str | None = None) -> DataFrame:  # noqa: E741
    """(group, read, sid, w), each w once for each read; the group is the column ``by``.

    Reads are dealt once, before they grow. A word's candidates are one array, made where the word stands; what is made
    distinct for a read stays in its task.
    """
    n = int(reads.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    plans, words, made = _plans(l, d), [], F.array().cast("array<string>")
    for i, (q, drop, subs, adds) in enumerate(plans):
        own = F.array_distinct(F.transform(substrings(F.col("seq"), l + q, l + q), _without(drop)))
        words.append(F.transform(own, _tagged(i)))
        made = F.when(F.col("x.plan") == i, _made(F.col("x.word"), subs, adds)).otherwise(made)
    own = _ordered(reads, by).repartition(n, "read").select("group", "read", "sid", F.explode(F.concat(*words)).alias("x"))
    return own.select("group", "read", "sid", F.explode(made).alias("w")).distinct()


def _made(x: Column, subs: int, adds: int) -> Column:
    """All words of one word: up to ``subs`` places set to A, one at least if any (setting a place twice is allowed), and ``adds`` As put in."""
    words = F.array(x)
    for insert in [False] * subs + [True] * adds:
        words = F.array_distinct(F.flatten(F.transform(words, _each_with_a(insert))))
    return words


def fold(found: DataFrame, reads: DataFrame, by: str | None = None) -> DataFrame:
    """(w), or (group, w) of each value of ``by`` (not null): the running set after all reads, in order; ``found`` are the candidates of ``reads``.

    ``folded`` gives the same from the reads alone, without a row for each candidate.
    """
    at = _ordered(reads, by).groupBy("group").agg(F.min("read").alias("at"))
    own = found.select("group", "read", "w")
    first = R.stored(own.join(F.broadcast(at), "group").where(F.col("read") == F.col("at")).select("group", "read", "w"), "first")
    held = own.join(first.select("group", "w"), ["group", "w"]).groupBy("group", "read").agg(F.collect_list("w").alias("ws"))
    return _rounds(first.groupBy("group", "read").agg(F.collect_list("w").alias("ws")), held, by)


def folded(reads: DataFrame, l: int, d: int, by: str | None = None) -> DataFrame:  # noqa: E741
    """As ``fold`` of the candidates of ``reads``.

    A first read's candidates are all that can be left of its group, so of every other read only what it shares with
    these is kept, told where the read stands. Reads are cut into overlapping segments, so no array holds more than
    the candidates of one segment.
    """
    ordered = _ordered(reads, by).where("group IS NOT NULL")
    first = ordered.groupBy("group").agg(F.min(F.struct("read", "seq")).alias("first")).select("group", "first.read", "first.seq")
    first = _gathered(_segments(first, l, d).select("group", "read", _candidates(l, d).alias("ws")))
    first = R.stored(first.where(F.size("ws") > 0), "first")
    n = int(reads.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = _segments(ordered.repartition(n, "read"), l, d).select("group", "read", _candidates(l, d).alias("ws"))
    shared = own.join(first.select("group", F.col("ws").alias("firsts")), "group").select("group", "read", F.array_intersect("ws", "firsts").alias("ws"))
    return _rounds(first, _gathered(shared.where(F.size("ws") > 0)), by)


def _candidates(l: int, d: int) -> Column:  # noqa: E741
    """The distinct candidates of ``seq``."""
    made = []
    for q, drop, subs, adds in _plans(l, d):
        own = F.array_distinct(F.transform(substrings(F.col("seq"), l + q, l + q), _without(drop)))
        made.append(F.flatten(F.transform(own, _each_made(subs, adds))))
    return F.array_distinct(F.concat(*made))


def _each_made(subs: int, adds: int):
    return lambda x: _made(x, subs, adds)


def _segments(ordered: DataFrame, l: int, d: int) -> DataFrame:  # noqa: E741
    """(group, read, seq): reads in segments that start every ``SEGMENT`` bases and overlap by the longest substring less one base."""
    last = F.floor(F.greatest(F.length("seq") - 1, F.lit(0)) / SEGMENT).cast("int")
    rows = ordered.select("group", "read", "seq", F.explode(F.sequence(F.lit(0), last)).alias("i"))
    return rows.select("group", "read", F.substring("seq", F.col("i") * SEGMENT + 1, F.lit(SEGMENT + l + d - 1)).alias("seq"))


def _gathered(parts: DataFrame) -> DataFrame:
    """(group, read, ws): what a read's segments hold, each word once."""
    return parts.groupBy("group", "read").agg(F.array_distinct(F.flatten(F.collect_list("ws"))).alias("ws"))


def _rounds(first: DataFrame, held: DataFrame, by: str | None) -> DataFrame:
    """The running sets after all reads: ``first`` (group, read, ws) are those of the first reads, ``held`` what each read shares with its group's.

    A round finds the next read that would change a group's set and intersects with it; reads that hold all of the set or
    none of it are passed over together. The set only shrinks, so there are fewer rounds than a first read has
    candidates, however many reads there are. Rounds come one after the other, as the variant's order of reads asks; all
    reads of all groups take part in each at once, and a group without a next read is done. Tables are stored, so that
    joins are planned by what they hold.
    """
    held = R.stored(held, "held")
    running = R.stored(first.select("group", F.col("read").alias("at"), F.col("ws").alias("running"), F.lit(True).alias("open")), "running")
    while True:
        met = held.join(running.where("open"), "group").where(F.col("read") > F.col("at"))
        met = met.select("group", "read", F.array_intersect("running", "ws").alias("ws"), F.size("running").alias("size"))
        met = met.where((F.size("ws") > 0) & (F.size("ws") < F.col("size")))
        found = R.stored(met.groupBy("group").agg(F.min(F.struct("read", "ws")).alias("next")), "next")
        if found.isEmpty():
            out = running.select("group", F.explode("running").alias("w"))
            return out if by else out.select("w")
        other = running.join(found, "group", "left")
        at, ws = F.coalesce("next.read", "at").alias("at"), F.coalesce("next.ws", "running").alias("running")
        running = R.stored(other.select("group", at, ws, F.col("next").isNotNull().alias("open")), "running")
