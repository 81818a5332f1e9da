"""The motif engine against its definition and the recorded results."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from strandmill.functions import sequence as S
from strandmill.operators import bitmap, collapsed, neighbours
from strandmill.plans.motif import MotifQuery
from strandmill.sources import reads as R
from strandmill.streaming import ingest

#: The recorded motifs of the read TATAAAAC at (11, 3) in the collapsed variant.
RECORDED = """AAATATAAAAC AATAATAAAAC AATATAAAAAC AATATAAAACA ATAAATAAAAC ATAATAAAAAC ATAATAAAACA ATATAAAAAAC ATATAAAAACA ATATAAAACAA
TAAAATAAAAC TAAATAAAAAC TAAATAAAACA TAATAAAAAAC TAATAAAAACA TAATAAAACAA TATAAAAAAAC TATAAAAAACA TATAAAAACAA TATAAAACAAA""".split()


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def supports(reads, l, d):  # noqa: E741
    out = {}
    for w in map("".join, itertools.product("ACGT", repeat=l)):
        n = sum(any(distance(w, s[i : i + k]) <= d for k in range(max(1, l - d), l + d + 1) for i in range(len(s) - k + 1)) for s in reads)
        if n:
            out[w] = n
    return out


def frame(spark, seqs):
    return spark.createDataFrame(list(enumerate(seqs)), "sid long, seq string")


@pytest.mark.parametrize("l,d", [(3, 1), (4, 2), (4, 0)])
def test_both_strategies_match_the_definition(spark, l, d):  # noqa: E741
    rng = random.Random(l * 10 + d)
    seqs = ["".join(rng.choices("ACGT", k=n)) for n in (12, 9, 3, 1)]
    for engine in (neighbours, bitmap):
        assert {r.w: r.n_reads for r in engine.supports(frame(spark, seqs), l, d).collect()} == supports(seqs, l, d)


def test_small_cases(spark):
    run = lambda seqs, l, d: {r.motif for r in MotifQuery(l, d).run(frame(spark, seqs)).collect()}
    assert run(["A"], 1, 1) == set("ACGT")
    assert "CAC" in run(["ACG"], 3, 1) and "TCT" not in run(["ACG"], 3, 1)
    assert run(["ACGTACGT", "AC"], 5, 1) == set() and run([], 3, 1) == set()
    with pytest.raises(ValueError):
        MotifQuery(0, 1)


def test_collapsed_variant_matches_the_record(spark):
    for seq, count in (("TATAAAAC", 20), ("ACATTAGTCGCA", 1371), ("TCTACCCTATTGAAGA", 2358)):
        found = {r.w for r in collapsed.candidates(frame(spark, [seq]), 11, 3).collect()}
        assert len(found) == count and (count != 20 or found == set(RECORDED))


def test_collapsed_fold(spark):
    rng = random.Random(5)
    reads = frame(spark, ["".join(rng.choices("ACGT", k=14)) for _ in range(8)])
    found = collapsed.candidates(reads, 4, 1).cache()
    sets = {}
    for r in found.collect():
        sets.setdefault(r.sid, set()).add(r.w)
    running = sets[0]
    for i in range(1, 8):
        running = running & sets.get(i, set()) or running
    assert {r.w for r in collapsed.fold(found, reads).collect()} == running


def test_collapsed_reads_are_told_apart_by_row(spark):
    """Repeated and null sids: every row is a read, null sids come first, other letters count as A; a first read without candidates ends the fold."""
    rows = [(3, "ACGTNCA"), (3, "TTTTTT"), (None, "ACGTACA"), (None, None), (1, "acgtaca")]
    reads = spark.createDataFrame(rows, "sid long, seq string").coalesce(1)
    found = collapsed.candidates(reads, 4, 1).cache()
    sets = {}
    for r in found.collect():
        sets.setdefault((r.sid, r.read["at"]), []).append(r.w)
    assert len(sets) == 4 and all(len(s) == len(set(s)) for s in sets.values())
    by_row = [set(collapsed_words(spark, s)) for s in ("ACGTACA", "AAAAAAA", "ACGTACA", "TTTTTT")]  # in order, with small letters as A
    running = by_row[0]
    for other in by_row[1:]:
        running = running & other or running
    assert {r.w for r in collapsed.fold(found, reads).collect()} == running
    short = spark.createDataFrame([(0, "A"), (1, "ACGT")], "sid long, seq string")
    assert collapsed.fold(collapsed.candidates(short, 4, 1), short).collect() == []
    assert collapsed.fold(collapsed.candidates(short.limit(0), 4, 1), short.limit(0)).collect() == []


def test_collapsed_folds_side_by_side(spark):
    rng = random.Random(7)
    rows = [(g, i, "".join(rng.choices("ACGT", k=14))) for g in ("x", "y", "z") for i in range(6)] + [("z", -1, "A")]
    reads = spark.createDataFrame(rows, "file string, sid long, seq string")
    found = {}
    for r in collapsed.fold(collapsed.candidates(reads, 4, 1, "file"), reads, "file").collect():
        found.setdefault(r.group, set()).add(r.w)
    for g in "xyz":
        own = reads.where(F.col("file") == g)
        assert found.get(g, set()) == {r.w for r in collapsed.fold(collapsed.candidates(own, 4, 1), own).collect()}
    assert found["x"] and "z" not in found  # the first read of z has no candidates


def collapsed_words(spark, seq):
    return [r.w for r in collapsed.candidates(frame(spark, [seq]), 4, 1).collect()]


def test_reads_headers_and_sinks(spark, tmp_path):
    (tmp_path / "x.txt").write_text("0 Motif acgt planted as ACG at position 7\r\nacgun\n> skipped\n\n\tACGT \n")
    lines = R.lines(spark, str(tmp_path / "x.txt"))
    assert [r.seq for r in R.reads(lines).orderBy("sid").collect()] == ["ACGTA", "ACGT"]
    assert R.reads(lines, "reference").count() == 3
    assert R.consensus(lines).first().consensus == "ACGT"
    assert tuple(R.headers(lines).select("motif", "edited", "pos").first()) == ("ACGT", "ACG", 7)
    R.write_motifs(spark.createDataFrame([("C", None), ("A", 1)], "motif string, distance long"), str(tmp_path / "out"))
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).orderBy("value").collect()] == ["A\tDistance: 1", "C\tDistance: N/A"]
    assert R.result_path("a/b.txt", "ems1", 8, 1) == "a/output/out_b_ems1_l8_d1.txt"


def test_codes(spark):
    df = spark.createDataFrame([("ACGT",), ("TTTT",)], "x string").withColumn("c", S.pack(F.col("x")))
    assert [r.c for r in df.collect()] == [27, 255]
    assert df.where(S.unpack(F.col("c"), F.lit(4)) != F.col("x")).isEmpty()
    assert [r[0] for r in df.select(S.two_bits(F.col("c"), F.lit(1))).collect()] == [2, 3]
    assert spark.range(1).select(S.wildcard_mask(F.lit("A*C*")), S.decoded(F.lit("01234x-59")), S.distance_to(F.lit("AC"), F.lit("AG"))).first()[:] == (5, "ACGT***??", 1)


def test_stream_counts_match_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("ACGT\nACG\n>no\n")
    query = ingest.kmer_stream(ingest.read_stream(spark, str(tmp_path / "in")), 2).writeStream.outputMode("complete").format("memory").queryName("kmers").start()
    query.processAllAvailable()
    query.stop()
    assert {r.x: r.n for r in spark.sql("select * from kmers").collect()} == {"AC": 2, "CG": 2, "GT": 1}


def test_every_query_has_matching_sql_names():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_merge_union_reads_every_row(spark, tmp_path):
    from strandmill.plans import queries

    keys = [0, 1, 2, 5, 8, 11]
    spark.createDataFrame([(k,) for k in keys], "p_partkey long").write.parquet(str(tmp_path / "part.parquet"))
    seqs = [r.seq for r in queries.key_reads(spark, str(tmp_path)).collect()]
    expected = sorted({s[i : i + 6] for s in seqs for i in range(len(s) - 5)})
    assert len(seqs) == len(keys) and [r.w for r in queries.merge_union(spark, str(tmp_path)).collect()] == expected


def test_collapsed_fold_from_reads_alone(spark, monkeypatch):
    """Groups, null groups, ties and null sids, empty and long reads: as the fold of all candidates; no table of candidates is broadcast."""
    rng = random.Random(11)
    rows = [(g, rng.choice([None, i, i // 2]), "".join(rng.choices("ACGT", k=rng.choice([0, 3, 14, 40])))) for g in ("x", "y", "z", None) for i in range(9)]
    reads = spark.createDataFrame(rows + [("w", 0, "A"), ("w", 1, "ACGTACGT"), ("v", 1, None)], "file string, sid long, seq string").coalesce(1)
    by_group = sorted(map(tuple, collapsed.fold(collapsed.candidates(reads, 4, 1, "file"), reads, "file").collect()))
    every = sorted(collapsed.fold(collapsed.candidates(reads, 5, 2), reads).collect())
    for segment in (64, 3):
        monkeypatch.setattr(collapsed, "SEGMENT", segment)
        assert sorted(map(tuple, collapsed.folded(reads, 4, 1, "file").collect())) == by_group
        assert sorted(collapsed.folded(reads, 5, 2).collect()) == every


def test_collapsed_queries_make_no_row_for_each_candidate(spark, tmp_path, monkeypatch):
    from strandmill.plans import queries

    spark.createDataFrame([(k,) for k in range(40)], "p_partkey long").write.parquet(str(tmp_path / "part.parquet"))
    reads = queries.key_reads(spark, str(tmp_path))
    expected = sorted(r.w for r in collapsed.fold(collapsed.candidates(reads, 5, 1), reads).collect())
    monkeypatch.setattr(collapsed, "candidates", None)
    assert sorted(r.motif for r in queries.ems2p_fold(spark, str(tmp_path)).collect()) == expected


def test_words_are_made_distinct_in_bounded_tasks(spark, monkeypatch):
    """Tasks follow the bases of the reads, however few splits they come in; null, empty and repeated reads."""
    rng = random.Random(12)
    seqs = ["".join(rng.choices("ACGT", k=32)) for _ in range(300)] * 2 + [None, "", "ACG", "ACGTNACGTACGT"]
    reads = frame(spark, seqs).coalesce(1)
    monkeypatch.setattr(neighbours, "TASK_BASES", 500)
    found = neighbours.distinct_kmers(reads, 12)
    whole = [s.replace("N", "A") for s in seqs if s]
    assert sorted(r.x for r in found.collect()) == sorted({s[i : i + 12] for s in whole for i in range(len(s) - 11)})
    assert ", 39)" in found._jdf.queryExecution().toString()  # 19,216 bases
