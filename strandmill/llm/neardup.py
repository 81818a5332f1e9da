"""MinHash near-dedup with min-max hashing.

A document's set is its distinct ``width``-word shingles (64-bit hashes with independent keys for each place, see
``wordhash``: two sets of a million shingles hold a false match with probability 2^-15); shorter texts are one shingle. Each of
``PERMS`` permutations of the hashes is evaluated once and gives two signature values, its minimum and its
maximum. Bands of ``ROWS`` values are bucket keys; equal keys make candidates, and every candidate is confirmed on
the full sets before it counts.

Groups of copies may be large, so no bucket is expanded into all pairs:

1. Equal sets collapse: one representative goes on, the others follow it.
2. Members of a bucket over ``SMALL`` rows are compared with the bucket's hub only, the member that stands in the
   largest buckets. Confirmed links are joined into components.
3. Families around the threshold stay in many components then. In rounds, members outside the largest component of a
   bucket are compared with ``SEATS`` of its members, and confirmed links join components. A round's pairs are linear in the
   rows; as fewer members are left outside, each meets more seats. Rounds end when the exact join, where it is cheap to tell (``LOOKS``), leaves no more
   pairs to compare than the next round, when the members left outside could meet all others of their buckets within the same budget, or when a round joins less
   than a twentieth of the components.
4. Members of buckets over ``SMALL`` rows that still hold several components are joined with each other by prefix:
   shingles in order of rarity, of which two sets at the threshold must share one near their beginnings. Length and
   position bounds are exact, so no link among these members is lost, and what copies have in common comes late in
   the order. Of each shingle's rows, those of its largest component are only met by the others.
5. Buckets of at most ``SMALL`` rows give the remaining pairs of members that are not in one component yet.

A pair at similarity 0.85 shares at least one of 28 bands of 6 with probability 1 - 2e-6, at 0.8 with 1 - 2e-4.

Components come from confirmed links by repeated joins (smallest label, then jumps along labels). All stages
write their tables to the shared folder; nothing but counts and the keys of the largest groups reaches the driver.
Buckets, copies, labels and shingles that hold many rows are split in every join on them.

Defined cases: null and empty texts have empty sets and are linked with nothing, not even each other; rows of one
id are one document, its set the union of theirs where their texts differ; rows with null id are their own component (null) and kept; an empty
table gives no rows; a text of any length is one row, of which a task holds ``SLICE`` at once; other columns pass
through ``deduplicate`` untouched, whatever their names, and are ignored elsewhere.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.llm import common
from strandmill.llm.wordhash import hash_words, mix, runs

WIDTH, PERMS, ROWS, SMALL, SEED = 5, 84, 6, 16, 31
VALUES = 2 * PERMS
BANDS = VALUES // ROWS
SEATS, MOST_SEATS, GAIN = 16, 1024, 0.95
LOOKS = 256  # shared prefix shingles for each row in large buckets, up to which a round tells how many pairs the exact join leaves
BROADCAST_ROWS = 1 << 20
SLICE = 512  # texts that a task holds as Python values at once
_FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, (2, PERMS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(hashes: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """The distinct shingle hashes of a text, sorted; of shorter texts one for all words."""
    if not len(hashes):
        return hashes
    return np.unique(runs(hashes, min(width, len(hashes))))


def signature(found: np.ndarray) -> np.ndarray:
    """PERMS minima, then PERMS maxima: upper 32 bits of (hash ^ a) * b, hashes evaluated once."""
    low, high = np.full(PERMS, ~np.uint64(0)), np.zeros(PERMS, np.uint64)
    for at in range(0, len(found), 4096):
        x = (found[at : at + 4096, None] ^ _FACTORS[0]) * _FACTORS[1]
        low, high = np.minimum(low, x.min(axis=0)), np.maximum(high, x.max(axis=0))
    return (np.concatenate((low, high)) >> np.uint64(32)).astype(np.uint32)


def _sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    for at in range(0, len(texts), SLICE):
        lowered = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts.slice(at, SLICE).to_pylist()]
        yield from (shingles(h, width) for h in hash_words(lowered))


def signatures(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, n, print, keys) for rows (doc_id, text): set size, 128 bits of the set, the bucket key of each band (of an empty set none)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, prints, sigs = [], [], []
            for s in _sets(b.column(1), width):
                n.append(len(s))
                prints.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                if len(s):
                    sigs.append(signature(s))
            keys = pa.array(_band_keys(np.array(sigs, np.uint32).reshape(-1, VALUES)).ravel().view(np.int64))
            ends = np.cumsum([0, *(BANDS * (k > 0) for k in n)], dtype=np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(prints, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), keys)], names=["doc_id", "n", "print", "keys"])

    return docs.mapInArrow(run, "doc_id long, n long, print binary, keys array<long>")


def full_sets(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(at, SLICE) for whole in batches for at in range(0, len(whole), SLICE)):
            got = list(_sets(b.column(1), width))
            ends = np.cumsum([0, *map(len, got)], dtype=np.int32)
            flat = np.concatenate(got).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["doc_id", "found"])

    return docs.mapInArrow(run, "doc_id long, found array<long>")


def _fold(values: np.ndarray, start: np.ndarray) -> np.ndarray:
    """One 64-bit key for each row of values."""
    key = start
    for i in range(values.shape[1]):
        key = mix(key * np.uint64(0xD1342543DE82EF95) + values[:, i].astype(np.uint64) + np.uint64(1))
    return key


def _band_keys(sigs: np.ndarray) -> np.ndarray:
    """A bucket key for each band of each signature."""
    keys = np.empty((len(sigs), BANDS), np.uint64)
    for band in range(BANDS):
        start = np.full(len(sigs), band, np.uint64)
        keys[:, band] = _fold(sigs[:, band * ROWS : (band + 1) * ROWS], mix(start + np.uint64(1)))
    return keys


def band_keys(reps: DataFrame) -> DataFrame:
    """(bucket, doc_id): a row for each band of each (doc_id, keys)."""
    return reps.select(F.explode("keys").alias("bucket"), "doc_id")


def _sizes(rows: DataFrame, key: str) -> DataFrame:
    """(key, n) of the keys that are worth splitting, for ``spread_join``."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > common.HOT_ROWS)


def components(links: DataFrame) -> DataFrame:
    """(doc_id, label) for every id in (a, b): the smallest id it can reach."""
    both = common.stored(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    degrees = common.stored(_sizes(both, "b"), "degrees")
    labels = common.stored(both.groupBy(F.col("a").alias("doc_id")).agg(F.least(F.min("b"), F.col("a")).alias("label")), "labels")
    while True:
        near = common.spread_join(both, labels.withColumnRenamed("doc_id", "b"), "b", degrees).groupBy(F.col("a").alias("doc_id")).agg(F.min("label").alias("near"))
        new = common.stored(labels.join(near, "doc_id").select("doc_id", "label", F.least("label", "near").alias("new")), "lowered")
        jump = labels.select(F.col("doc_id").alias("new"), F.col("label").alias("far"))
        new = common.spread_join(new, jump, "new", _sizes(new, "new")).select("doc_id", F.least("new", "far").alias("label"), (F.least("new", "far") < F.col("label")).alias("moved"))
        new = common.stored(new, "labels")
        if new.where("moved").isEmpty():
            return new.select("doc_id", "label")
        labels = new.select("doc_id", "label")


def _labelled(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return rows.withColumn("label", F.col("doc_id"))
    return rows.join(labels, "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id"))


def _needed(sets: DataFrame, pairs: DataFrame, side: str) -> DataFrame:
    """The sets that stored pairs ask for on one side, so that no others are shuffled; all of them where too many are asked for."""
    ids = pairs.select(F.col(side).alias("doc_id")).distinct()
    return sets.join(F.broadcast(ids), "doc_id", "left_semi") if ids.count() <= BROADCAST_ROWS else sets


def _matches(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Stored pairs (a, b, ...) whose full sets have 100 * intersection >= percent * union; a hub's set meets its pairs in parts.

    Sets of which one is too small to hold so much of the other are told by their sizes, before any set is moved.
    """
    columns = pairs.columns
    for side in "ab":
        pairs = common.spread_join(pairs, sets.select(F.col("doc_id").alias(side), F.col("n").alias("n" + side)), side, _sizes(pairs, side))
    pairs = common.stored(pairs.where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")).select(columns), "sized")
    left, right = (_needed(sets, pairs, side).select(F.col("doc_id").alias(side), F.col("found").alias("f" + side)) for side in "ab")
    met = common.spread_join(common.spread_join(pairs, left, "a", _sizes(pairs, "a")), right, "b", _sizes(pairs, "b"))
    met = met.withColumn("both", F.size(F.array_intersect("fa", "fb")))
    return met.where(100 * F.col("both") >= percent * (F.size("fa") + F.size("fb") - F.col("both"))).select(pairs.columns)


def _one_set(sets: DataFrame, reps: DataFrame) -> DataFrame:
    """One set for each id: as they are, or their union where ids have several texts."""
    if reps.groupBy("doc_id").count().where("count > 1").isEmpty():
        return sets
    return sets.groupBy("doc_id").agg(F.array_distinct(F.flatten(F.collect_list("found"))).alias("found"))


def _prefixes(ids: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(doc_id, n, token, at): the beginnings of the sets of ``ids`` in order of rarity, without shingles that one of them has alone.

    Two sets at the threshold share a shingle of their beginnings, also where only some of ``ids`` are compared.
    """
    own = common.stored(sets.join(ids, "doc_id").select("doc_id", F.size("found").alias("n"), F.explode("found").alias("token")), "tokens")
    rarity = common.stored(own.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "rarity")
    # Shingles of one document only come first in the order; they meet nothing, so only their number counts.
    ranked = common.spread_join(own, rarity, "token", rarity.withColumnRenamed("df", "n")).groupBy("doc_id", "n").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("order"))
    alone = F.col("n") - F.size("order")
    prefix = F.col("n") - F.ceil(F.lit(percent) * F.col("n") / 100).cast("int") + 1
    ranked = ranked.select("doc_id", "n", alone.alias("alone"), F.slice("order", F.lit(1), F.greatest(F.lit(0), prefix - alone)).alias("order"))
    rows = ranked.select("doc_id", "n", "alone", F.posexplode("order").alias("at", "o")).select("doc_id", "n", F.col("o.token").alias("token"), (F.col("alone") + F.col("at")).alias("at"))
    return common.stored(rows, "prefixes")


def _mixed(rows: DataFrame) -> DataFrame:
    """(token, labels, most, n) of the shingles that rows of several labels begin with: their number, the largest of them, the rows."""
    shares = rows.groupBy("token", "label").agg(F.count(F.lit(1)).alias("rows"))
    most = shares.groupBy("token").agg(F.count(F.lit(1)).alias("labels"), F.max(F.struct("rows", "label")).alias("most"), F.sum("rows").alias("n"))
    return most.where("labels > 1")


def _by_prefix(rows: DataFrame, most: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different labels that prefix, length and position let through; ``rows`` are labelled prefixes, ``most`` is their ``_mixed``."""
    rows = common.stored(common.spread_join(rows, most.select("token", F.col("most.label").alias("main")), "token", most), "mixed")
    few = rows.where("label <> main").select("token", F.col("doc_id").alias("x"), F.col("label").alias("lx"), F.col("n").alias("nx"), F.col("at").alias("ix"))
    every = rows.select("token", "main", F.col("doc_id").alias("y"), F.col("label").alias("ly"), F.col("n").alias("ny"), F.col("at").alias("iy"))
    bound = F.least(F.col("nx") - F.col("ix"), F.col("ny") - F.col("iy"))
    near = (F.col("lx") != F.col("ly")) & ((F.col("ly") == F.col("main")) | (F.col("x") < F.col("y"))) & ((100 + percent) * bound >= percent * (F.col("nx") + F.col("ny")))
    return common.spread_join(every, few, "token", most).where(near).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def _in_rounds(large: DataFrame, sizes: DataFrame, labels: DataFrame | None, sets: DataFrame, percent: int) -> tuple[list[DataFrame], DataFrame | None, DataFrame | None]:
    """Confirmed links that join components of the buckets ``large`` (bucket, doc_id, rows), the labels they lead to, and candidates (a, b) of the exact join under these.

    Pairs that no round compares are left to the exact join, so a round decides how much work is left, not the result.
    """
    found, prefixes, budget, last = [], None, None, None
    for turn in itertools.count():
        rows = common.stored(_labelled(large, labels), "labelled")
        shares = rows.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("n"))
        mains = common.stored(shares.groupBy("bucket").agg(F.max(F.struct("n", "label")).alias("most"), F.count(F.lit(1)).alias("labels")).where("labels > 1").select("bucket", F.col("most.label").alias("main")), "mains")
        rows = common.stored(common.spread_join(rows, mains, "bucket", sizes), "unsettled")
        others = rows.where("label <> main")
        apart = F.col("label") != F.col("main")
        total, outside, work, parts = rows.agg(F.count(F.lit(1)), F.count_if(apart), F.sum(F.when(apart, F.col("rows"))), F.count_distinct("label")).first()
        budget = SEATS * total if budget is None else budget
        if not outside:
            return found, labels, None
        members = rows.select("doc_id", "label").distinct()
        if prefixes is None:
            prefixes = _prefixes(members.select("doc_id"), sets, percent)
        begun = common.stored(prefixes.join(members, "doc_id"), "begun")
        most = common.stored(_mixed(begun), "most")
        if work <= budget or (last is not None and parts > GAIN * last):
            return found, labels, _by_prefix(begun, most, percent)
        last, seats = parts, max(SEATS, min(MOST_SEATS, budget // outside))
        drawn = F.xxhash64("doc_id", F.lit(turn))
        chosen = rows.groupBy("bucket", F.pmod(drawn, F.lit(seats)).alias("seat")).agg(F.min(F.struct(drawn.alias("drawn"), "doc_id", "label")).alias("s"))
        chosen = chosen.select("bucket", F.col("s.doc_id").alias("y"), F.col("s.label").alias("ly"))
        one = F.max(F.struct(F.xxhash64("bucket", F.lit(turn)), "bucket"))["bucket"].alias("bucket")
        asks = common.stored(others.groupBy(F.col("doc_id").alias("x"), F.col("label").alias("lx")).agg(one), "asks")
        met = common.spread_join(asks, chosen, "bucket", _sizes(asks, "bucket")).where("lx <> ly")
        met = met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.least("lx", "ly").alias("la"), F.greatest("lx", "ly").alias("lb")).distinct()
        met = common.stored(met, "met")
        looks = most.agg(F.sum((F.col("n") - F.col("most.rows")).cast("double") * F.col("n"))).first()[0] or 0
        if looks <= LOOKS * total:
            exact = common.stored(_by_prefix(begun, most, percent).distinct(), "exact")
            if exact.count() <= met.count():
                return found, labels, exact
        # Of the links between two components one is enough.
        near = _matches(met, sets, percent).groupBy("la", "lb").agg(F.min(F.struct("a", "b")).alias("link"))
        near = common.stored(near.select("la", "lb", "link.a", "link.b"), "near")
        if near.isEmpty():
            return found, labels, _by_prefix(begun, most, percent)
        found.append(near.select("a", "b"))
        tops = components(near.select(F.col("la").alias("a"), F.col("lb").alias("b"))).select(F.col("doc_id").alias("label"), F.col("label").alias("top"))
        own = common.stored(_labelled(large.select("doc_id").distinct(), labels), "own")
        labels = common.stored(common.spread_join(own, tops, "label", _sizes(own, "label"), "left").select("doc_id", F.coalesce("top", "label").alias("label")), "labels")


def links(reps: DataFrame, docs: DataFrame, width: int = WIDTH, percent: int = 85) -> DataFrame:
    """Confirmed links (a, b) that join all linked representatives (doc_id, n, keys); ``docs`` is (doc_id, text)."""
    keys = band_keys(reps)
    counts = common.stored(keys.groupBy("bucket").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1"), "buckets")
    sizes = counts.withColumnRenamed("rows", "n")
    shared = common.stored(common.spread_join(keys, counts, "bucket", sizes), "shared")
    ids = common.stored(shared.select("doc_id").distinct(), "candidates")
    if ids.count() <= BROADCAST_ROWS:
        ids = F.broadcast(ids)
    sets = _one_set(full_sets(docs.join(ids, "doc_id", "left_semi"), width), reps)
    sets = common.stored(sets.withColumn("n", F.size("found").cast("long")), "sets")

    large = shared.where(F.col("rows") > SMALL)
    central = large.groupBy("doc_id").agg(F.sum("rows").alias("weight"))
    hub = F.max(F.struct("weight", -F.col("doc_id"))).alias("hub")
    hubs = large.join(central, "doc_id").groupBy("bucket").agg(hub).select("bucket", (-F.col("hub.col2")).alias("b"))
    stars = common.spread_join(large, hubs, "bucket", sizes).where("doc_id <> b").select(F.col("doc_id").alias("a"), "b").distinct()
    found = common.stored(_matches(common.stored(stars, "rays"), sets, percent), "stars")
    labels = None if found.isEmpty() else components(found)
    more, labels, exact = _in_rounds(large, sizes, labels, sets, percent)
    found = functools.reduce(DataFrame.unionByName, more, found)

    rows = common.stored(_labelled(shared, labels), "labelled")
    open_ = rows.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("bucket")
    rows = common.stored(common.spread_join(rows, open_, "bucket", sizes), "open")
    members = common.stored(rows.where(F.col("rows") > SMALL).select("doc_id", "label").distinct(), "members")
    inner = members.select("doc_id", F.lit(True).alias("inner"))
    small = rows.where(F.col("rows") <= SMALL).join(inner, "doc_id", "left").join(reps.select("doc_id", "n"), "doc_id")
    small = common.stored(small.select("bucket", "doc_id", "label", "n", F.coalesce("inner", F.lit(False)).alias("inner")), "small")
    left, right = (small.select("bucket", F.col("doc_id").alias(k), F.col("label").alias("l" + k), F.col("n").alias("n" + k), F.col("inner").alias("i" + k)) for k in "ab")
    close = (F.col("a") < F.col("b")) & (F.col("la") != F.col("lb")) & ~(F.col("ia") & F.col("ib")) & (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    pairs = left.join(right, "bucket").where(close).select("a", "b")
    if exact is not None:
        pairs = pairs.unionByName(exact)
    pairs = common.stored(pairs.distinct(), "pairs")
    return found.unionByName(common.stored(_matches(pairs, sets, percent), "confirmed"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id), a row for each input row."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sigs = common.stored(signatures(own, width), "signatures")
    named = sigs.where("doc_id IS NOT NULL")
    groups = common.stored(named.where("n > 0").groupBy("print").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("rows")).where("rows > 1"), "groups")
    copies = groups.select("print", F.col("rows").alias("n"))
    members = common.spread_join(sigs.select("doc_id", F.col("n").alias("n_own"), "print"), groups.select("print", "rep"), "print", copies, "left")
    members = common.stored(members.select("doc_id", F.col("n_own").alias("n"), F.coalesce("rep", "doc_id").alias("rep")), "members")
    reps = common.spread_join(named.where("n > 0").withColumnRenamed("n", "n_own"), groups.select("print", "rep"), "print", copies, "left")
    reps = common.stored(reps.where("rep IS NULL OR rep = doc_id").select("doc_id", F.col("n_own").alias("n"), "rep", "keys"), "representatives")
    # A print without a group has one row, so only rows of groups may repeat.
    again = common.stored(reps.where("rep IS NOT NULL").drop("rep").dropDuplicates(["doc_id", "n", "keys"]), "firsts")
    reps = reps.where("rep IS NULL").drop("rep").unionByName(again)
    # One id with several texts: its sets are one document, so its representatives are linked too.
    same = members.where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    same = same.join(reps.select(F.col("doc_id").alias("a")).distinct(), "a", "left_semi")
    found = links(reps, own.where("doc_id IS NOT NULL"), width, percent)
    labels = components(found.unionByName(same))
    followers = common.stored(groups.groupBy("rep").agg(F.sum("rows").alias("n")), "followers")
    out = common.spread_join(members.withColumnRenamed("n", "n_own"), labels.select(F.col("doc_id").alias("rep"), "label"), "rep", followers, "left").withColumnRenamed("n_own", "n")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("label", "rep").alias("component_id"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each group: the one of smallest id; columns stay."""
    found, name = near_duplicates(docs, id_col, text_col, width, percent), common.fresh(docs.columns, "gone")
    gone = common.stored(found.where("component_id <> doc_id").select(F.col("doc_id").alias(name)).distinct(), "gone")
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    return docs.join(gone, F.col(f"`{id_col}`") == F.col(name), "left_anti")


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(common.table(spark, sf_dir, "documents"), percent=85)
    return found.withColumn("kept", F.col("component_id").eqNullSafe(F.col("doc_id")))
