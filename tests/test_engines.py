"""Agreement of the strategies, large words, files and the command lines."""

import os
import random

import pytest
from pyspark.sql import functions as F
from test_motifs import frame, supports

from strandmill import cli, generate
from strandmill.functions import sequence as S
from strandmill.operators import bitmap, neighbours, planted, verify
from strandmill.plans.motif import MotifQuery
from strandmill.sources import reads as R


@pytest.mark.parametrize("l,d", [(3, 1), (2, 2), (1, 2)])
def test_strategies_agree_on_odd_reads(spark, l, d):  # noqa: E741
    """Repeated and null sids, null and empty reads, letters other than ACGT: every row is one read, others count as A."""
    seqs = ["ACGTA", "ACGTA", "TTTT", "", None, "NZACx", "CCC"]
    reads = spark.createDataFrame([(1, s) for s in seqs[:3]] + [(None, s) for s in seqs[3:]], "sid long, seq string")
    expected = supports(["".join(c if c in "ACGT" else "A" for c in s or "") for s in seqs], l, d)
    for engine in (neighbours, bitmap):
        assert {r.w: r.n_reads for r in engine.supports(reads, l, d).collect()} == expected
    for strategy in ("rows", "bitmap", "auto"):
        found = MotifQuery(l, d, 0.5, strategy).run(reads).collect()
        assert {r.motif: r.n_reads for r in found} == {w: n for w, n in expected.items() if n >= 4}


@pytest.mark.parametrize("l,d", [(5, 1), (5, 2), (6, 1)])
def test_rows_in_place_match_the_broadcast_neighbourhood(spark, monkeypatch, l, d):  # noqa: E741
    rng = random.Random(l + d)
    reads = frame(spark, ["".join(rng.choices("ACGT", k=n)) for n in (30, 20, 7, 3)])
    expected = {r.w: r.n_reads for r in bitmap.supports(reads, l, d).collect()}
    for rows in (0, 1 << 40):
        monkeypatch.setattr(neighbours, "BROADCAST_ROWS", rows)
        assert {r.w: r.n_reads for r in neighbours.supports(reads, l, d).collect()} == expected
    monkeypatch.setattr(neighbours, "LONGEST", 0)  # words too long for a number
    assert {r.w: r.n_reads for r in neighbours.supports(reads, l, d).collect()} == expected


def test_quorum_is_exact():
    for share in (0.55, 0.07, 0.28, 0.29, 0.56, 0.57, 0.58):
        for n in range(100, 2001, 100):
            assert MotifQuery(5, 1, share).least(n) == round(share * 100) * n // 100
    assert MotifQuery(5, 1, 0.55).least(100) == 55 and MotifQuery(5, 1, 0.1).least(0) == 1


def test_strategy_follows_cost():
    assert bitmap.fits(11, 3) and not bitmap.fits(13, 1) and not bitmap.fits(16, 3)
    assert MotifQuery(5, 1).by_bitmap(32) and MotifQuery(9, 2).by_bitmap(600) and not MotifQuery(12, 1).by_bitmap(32)


@pytest.mark.parametrize("l,d", [(5, 1), (6, 2), (4, 0), (2, 2)])
def test_verify_matches_the_definition(spark, l, d):  # noqa: E741
    rng = random.Random(l * d)
    reads = frame(spark, ["".join(rng.choices("ACGT", k=n)) for n in (25, 18, 9, 2)] + [None])
    words = ["".join(rng.choices("ACGT", k=l)) for _ in range(60)] + ["A" * (l + 1)]
    every = {r.w: r.n_reads for r in neighbours.supports(reads, l, d).collect()} if l > d else dict.fromkeys(words[:-1], 5)
    found = {r.w: r.n_reads for r in verify.supports(spark.createDataFrame([(w,) for w in words], "w string"), reads, l, d).collect()}
    assert found == {w: every[w] for w in words if w in every and len(w) == l}


@pytest.mark.parametrize("l,d", [(13, 4), (16, 3)])
def test_large_planted_motifs_are_verified(spark, l, d):  # noqa: E741
    rows = planted.generate(spark, 20, 600, l, d, 7)
    motif = planted.random_motif(7, l)
    candidates = spark.createDataFrame([(motif,), ("A" * l,)], "w string")
    found = {r.motif: (r.n_reads, r.distance) for r in MotifQuery(l, d).verify(candidates, rows, motif).collect()}
    assert found[motif] == (20, 0)


def test_lines_are_numbered_across_splits(spark, tmp_path):
    said = [f"{'ACGT'[i % 4] * (1 + i % 7)}" if i % 5 else f"> {i}" for i in range(500)]
    for name in ("a.txt", "b.txt"):
        (tmp_path / name).write_text("\r\n".join(said))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        lines = R.lines(spark, str(tmp_path))
        found = lines.collect()
        assert lines.select(F.spark_partition_id()).distinct().count() > 2
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    by_file = {}
    for r in found:
        by_file.setdefault(os.path.basename(r.file), {})[r.line_no] = r.raw
    assert by_file == {n: dict(enumerate(said)) for n in ("a.txt", "b.txt")}


def test_bits(spark):
    mask = F.lit(5).cast("long")
    assert spark.range(1).select(*(S.bit(mask, F.lit(i)) for i in range(4))).first()[:] == (1, 0, 1, 0)


def test_generated_files_hold_what_they_state(spark, tmp_path):
    assert generate.main(["-n", "6", "-m", "80", "-l", "8", "-d", "2", "--seed", "3", str(tmp_path / "p")]) == 0
    lines = R.lines(spark, str(tmp_path / "p"))
    stated = R.headers(lines).collect()
    reads = [r.seq for r in R.reads(lines).collect()]
    assert len(stated) == len(reads) == 6 and {len(s) for s in reads} == {80} and (tmp_path / "p").is_file()
    assert {r.motif for r in stated} == {planted.random_motif("3", 8)}
    rows = {r.sid: r for r in planted.generate(spark, 6, 80, 8, 2, "3").collect()}
    assert all(r.seq[r.pos :].startswith(r.edited) and r.seq in reads for r in rows.values())
    assert planted.random_motif(1, 30) != planted.random_motif(2, 30)
    assert generate.main(["-n", "0", str(tmp_path / "q")]) == 255


def test_command_line(spark, tmp_path, capsys):
    path = tmp_path / "reads.txt"
    path.write_text("0 Motif ACGT planted as ACG at position 0\nACGTACGT\nTTACGTTT\n")
    assert cli.main([]) == 255 and "usage" in capsys.readouterr().err
    assert cli.main(["-l", "0", str(path)]) == 255 and "l must be" in capsys.readouterr().err
    assert cli.main(["-l", "4", "-d", "1", str(tmp_path / "none.txt")]) == 255 and "no such file" in capsys.readouterr().err
    with pytest.raises(SystemExit) as e:
        cli.main(["-s", "9", str(path)])
    assert e.value.code == 2
    monkey = {"-s 1": "ems1", "-s 2p": "ems2p"}
    for option, name in monkey.items():
        out = cli.search(spark, str(path), option[3:], 4, 1, "strict")
        assert out.endswith(f"output/out_reads_{name}_l4_d1.txt")
        got = [r.value for r in spark.read.text(out).collect()]
        assert got and all("\tDistance: " in g for g in got)
        if name == "ems1":
            assert "ACGT\tDistance: 0" in got
    record = spark.read.json(str(tmp_path / "output" / "runs")).collect()
    assert {r.variant for r in record} == {"ems1", "ems2p"} and all(r.max_rss_kb > 0 and r.n_motifs > 0 for r in record)
