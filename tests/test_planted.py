"""Planted reads and the queries over them against a plain version."""

import hashlib
import random

from pyspark.sql import functions as F

from strandmill.operators import planted
from strandmill.plans import queries
from strandmill.plans.motif import MotifQuery

BASES = "ACGT"


def read(key):
    return "".join(BASES[int(c, 16) % 4] for c in hashlib.md5(str(key).encode()).hexdigest())


def plant(key, motif, d):
    """(edited, pos, seq) as the reference edits and plants, with each draw taken from a hash of the key."""
    draw = lambda name, below: int(hashlib.md5(f"{key}{name}".encode()).hexdigest()[:8], 16) % below
    word = list(motif)
    deletions = draw("deletions", d + 1)
    insertions = draw("insertions", d + 1 - deletions)
    for i in range(d):
        if i < deletions:
            if word:
                word.pop(draw(f"at{i}", len(word)))
        elif i < deletions + insertions:
            word.insert(draw(f"at{i}", len(word) + 1), BASES[draw(f"i{i}", 4)])
        elif word:
            at = draw(f"at{i}", len(word))
            word[at] = BASES[(BASES.index(word[at]) + 1 + draw(f"s{i}", 3)) % 4]
    edited, seq = "".join(word), read(key)
    if len(edited) > len(seq):
        return edited, 0, seq
    pos = draw("pos", len(seq) - len(edited) + 1)
    return edited, pos, seq[:pos] + edited + seq[pos + len(edited) :]


def near(words, least, most):
    """All words within one edit of the given ones, of ``least`` to ``most`` bases."""
    out = set(words)
    for x in words:
        for i in range(len(x) + 1):
            out |= {x[:i] + x[i + 1 :]} | {x[:i] + b + x[j:] for b in BASES for j in (i, i + 1)}
    return {w for w in out if least <= len(w) <= most}


def test_planting_matches_the_plain_version(spark):
    for motif, d in (("ACGTACGT", 1), ("ACGTACGTACG", 3), ("AC", 4), ("ACGT" * 8, 2), ("ACG", 0)):
        rows = planted.planted(spark.range(300), F.col("id"), motif, d).collect()
        assert {r.sid: (r.edited, r.pos, r.seq) for r in rows} == {k: plant(k, motif, d) for k in range(300)}


def test_planting_draws_every_edit_and_position(spark):
    rows = planted.planted(spark.range(3000), F.col("id"), "ACGTACGT", 1).collect()
    assert {len(r.edited) for r in rows} == {7, 8, 9} and all(r.edited != "ACGTACGT" for r in rows if len(r.edited) != 9)
    assert {i for r in rows if len(r.edited) == 8 for i in range(8) if r.edited[i] != "ACGTACGT"[i]} == set(range(8))
    assert {(len(r.edited), r.pos) for r in rows} == {(n, p) for n in (7, 8, 9) for p in range(32 - n + 1)}


def test_planted_queries_whole(spark, tmp_path):
    keys = random.Random(3).sample(range(10**6), 40)
    spark.createDataFrame([(k,) for k in keys], "p_partkey long").write.parquet(str(tmp_path / "part.parquet"))
    made = {k: plant(k, queries.LONG_WORD, 1) for k in keys}
    got = queries.planted_generate(spark, str(tmp_path)).collect()
    assert {r.sid: (r.edited, r.pos, r.seq) for r in got} == made and len(got) == 40
    supports = {}
    for _, _, seq in made.values():
        for w in near({seq[i : i + n] for n in (7, 8, 9) for i in range(len(seq) - n + 1)}, 8, 8):
            supports[w] = supports.get(w, 0) + 1
    found = {r.motif: r.n_reads for r in queries.planted_motifs(spark, str(tmp_path)).collect()}
    assert found == {w: n for w, n in supports.items() if n >= 36} and found[queries.LONG_WORD] == 40


def test_keys_of_one_split_are_planted_by_many_tasks(spark, tmp_path):
    spark.range(4000).select(F.col("id").alias("p_partkey")).coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    rows = queries.planted_generate(spark, str(tmp_path)).groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert len(rows) == 4 and max(r["count"] for r in rows) < 2000 and sum(r["count"] for r in rows) == 4000


def test_reads_made_on_the_way_are_made_once_for_rows(spark):
    made = spark.sparkContext.accumulator(0)

    def make(key):
        made.add(1)
        return "".join("ACGT"[key * (i + 3) % 7 % 4] for i in range(30))

    for tasks in (1, 9):  # fewer tasks than there are partitions of a shuffle, and enough of them
        before = made.value
        reads = spark.range(200).repartition(tasks).select(F.col("id").alias("sid"), F.udf(make)("id").alias("seq"))
        found = MotifQuery(5, 1, 0.5, "rows").run(reads).collect()
        assert made.value - before == 200
        assert {tuple(r) for r in found} == {tuple(r) for r in MotifQuery(5, 1, 0.5, "bitmap").run(reads).collect()} and found
