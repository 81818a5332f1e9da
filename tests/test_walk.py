"""The walk over prefixes: supports, search in rounds, given words, distances, searches by file."""

import os
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_motifs import distance, frame, supports

from strandmill import cli
from strandmill.functions import sequence as S
from strandmill.operators import bitmap, planted, verify, walk
from strandmill.plans import motif as plans
from strandmill.plans.motif import MotifQuery
from strandmill.sources import reads as R


def drawn(rng, *lengths):
    return ["".join(rng.choices("ACGT", k=n)) for n in lengths]


def walked(*args, **more):
    found = {}
    for codes, n, _ in walk.walk(*args, **more):
        assert not found.keys() & set(codes.tolist())  # each word once
        found.update(zip(codes.tolist(), n.tolist()))
    return found


@pytest.mark.parametrize("l,d", [(3, 1), (5, 2), (6, 3), (2, 2), (1, 2), (5, 0)])
def test_walk_gives_each_word_once(l, d):  # noqa: E741
    rng = random.Random(l * 10 + d)
    seqs = drawn(rng, 200, 90, 64, 63, 62, 12, 3, 1, 0)
    expected = {}
    for s in filter(None, seqs):
        for code in np.flatnonzero(bitmap.bitmap(s, l, d)).tolist():
            expected[code] = expected.get(code, 0) + 1
    block = walk.Block(seqs, l, d)
    assert walked(block, l, d) == expected
    for misses in (0, 1, 4):
        assert walked(block, l, d, misses) == {c: n for c, n in expected.items() if n >= 8 - misses}
    depth, parts = min(2, l - 1), {}
    for shard in range(4**depth):
        parts |= walked(block, l, d, walk.ANY, shard, depth)
    assert parts == expected
    words = np.array(sorted(rng.sample(range(4**l), min(4**l, 20))))
    assert walked(block, l, d, words=words) == {c: n for c, n in expected.items() if c in set(words.tolist())}


def test_groups_of_reads_rule_prefixes_out(monkeypatch):
    """Long words, of which few are near all reads, so that chunks are small and reads are looked at in groups."""
    rng = random.Random(4)
    common = "ACGTTGCATGCA"
    seqs = [a + common + b for a, b in zip(drawn(rng, *[30] * 12), drawn(rng, *[80] * 12))]
    monkeypatch.setattr(walk, "CHUNK_BYTES", 1 << 16)
    block = walk.Block(seqs, 12, 1)
    every, found = walked(block, 12, 1), walked(block, 12, 1, 0)
    assert found == {c: n for c, n in every.items() if n == 12} and int(common.translate(str.maketrans("ACGT", "0123")), 4) in found


@pytest.mark.parametrize("l,d", [(3, 1), (2, 2), (1, 1)])
def test_walk_strategy_takes_odd_reads(spark, l, d):  # noqa: E741
    seqs = ["ACGTA", "ACGTA", "TTTT", "", None, "NZACx", "CCC"]
    reads = spark.createDataFrame([(1, s) for s in seqs[:3]] + [(None, s) for s in seqs[3:]], "sid long, seq string")
    expected = supports(["".join(c if c in "ACGT" else "A" for c in s or "") for s in seqs], l, d)
    assert {r.w: r.n_reads for r in walk.supports(reads, l, d).collect()} == expected
    for share in (0.5, 1):
        least = MotifQuery(l, d, share).least(7)
        found = MotifQuery(l, d, share, "walk").run(reads).collect()
        assert {r.motif: r.n_reads for r in found} == {w: n for w, n in expected.items() if n >= least}
    assert MotifQuery(l, d, 1, "walk").run(reads.limit(0)).collect() == []


def test_search_in_rounds(spark, monkeypatch):
    """Rounds of 8, 32, ... reads in small blocks give what one count of all reads gives, whatever may be missed."""
    rng = random.Random(9)
    reads = frame(spark, drawn(rng, *[40] * 120, *[5] * 2, *[200] * 3))
    expected = {r.w: r.n_reads for r in bitmap.supports(reads, 4, 1).collect()}
    for name, value in (("BLOCK", 16), ("FIRST_GROUP", 8), ("GROWTH", 4)):
        monkeypatch.setattr(walk, name, value)
    rounds = []
    monkeypatch.setattr(walk, "stored", lambda df, name, keep=walk.stored: rounds.append(name) or keep(df, name))
    for least in (125, 124, 120, 118, 60):
        assert {r.w: r.n_reads for r in walk.frontier(reads, 4, 1, least).collect()} == {w: n for w, n in expected.items() if n >= least}
    rounds.clear()
    assert walk.frontier(frame(spark, drawn(rng, *[6] * 125)), 6, 0, 125).collect() == [] and rounds == ["frontier"]  # nothing is left after the first


@pytest.mark.parametrize("l,d", [(12, 2), (16, 3)])
def test_long_planted_motifs_are_found(spark, l, d):  # noqa: E741
    rows = planted.generate(spark, 20, 600 if l == 16 else 200, l, d, 7).drop("motif")
    motif = planted.random_motif(7, l)
    found = {r.motif: r.distance for r in MotifQuery(l, d).run(rows, motif).collect()}
    assert found[motif] == 0 and MotifQuery(l, d).by_walk(600)
    given = spark.createDataFrame([(w,) for w in (*found, "A" * l, "C" * (l + 1))], "w string")
    assert {r.motif for r in MotifQuery(l, d).verify(given, rows).collect()} == set(found)


def test_given_words_of_other_letters_and_lengths(spark):
    rng = random.Random(2)
    reads = frame(spark, [*drawn(rng, 60, 40, 10), "ACGTACGTAC"])
    words = [("ACGNACGT",), ("ACGTACGT",), (None,), ("",), ("ACG",), ("ACGTACGT",)]
    found = {r.w: r.n_reads for r in verify.supports(spark.createDataFrame(words, "w string"), reads, 8, 1).collect()}
    assert found["ACGNACGT"] >= 1 and set(found) == {"ACGNACGT", "ACGTACGT"}
    far = drawn(rng, 45)[0]
    assert [tuple(r) for r in verify.supports(spark.createDataFrame([(far,)], "w string"), frame(spark, [far[:20] + far[21:]]), 45, 2).collect()] == [(far, 1)]


def test_best_distances(spark):
    rng = random.Random(6)
    seqs, words, expected = [*drawn(rng, 150, 70, 30, 8, 2, 1), "", None], ["ACGTACG", "TTT", "ACGTACGTACG"], {}
    for i, s in enumerate(seqs):
        for w in words:
            ends = range(1, len(s or "") + 1)
            best = min(((distance(s[a:b], w), b) for b in ends for a in range(max(0, b - len(w) - 3), b)), default=(9, 0))
            if best[0] <= 3:
                expected[i, w] = best
    assert {(r.sid, r.word): (r.distance, r.end) for r in walk.best_distances(frame(spark, seqs), words, 3).collect()} == expected
    every = walk.best_distances(frame(spark, seqs), words, 3, every=True).collect()
    assert {(r.sid, r.word): (r.distance, r.end) for r in every} == {(i, w): expected.get((i, w), (None, None)) for i in range(len(seqs)) for w in words} and len(every) == 24
    by_columns = frame(spark, seqs).select("sid", S.found_within(F.coalesce("seq", F.lit("")), words[0], 2).alias("found")).collect()
    assert {r.sid for r in by_columns if r.found} == {i for (i, w), (n, _) in expected.items() if w == words[0] and n <= 2}


def test_files_have_their_own_parameters(spark, tmp_path, capsys):
    rng, every = random.Random(8), {}
    (tmp_path / "in").mkdir()
    for name, l, d in (("a_l4_d1.txt", 4, 1), ("b_l5_d0.txt", 5, 0), ("plain.txt", 3, 1), ("none_l3_d1.txt", 3, 1), ("odd_l0_d1.txt", 0, 1)):
        seqs = [s + "ACGTA" for s in drawn(rng, 12, 30, 9)] if "none" not in name else []
        (tmp_path / "in" / name).write_text("\n".join(["> 0 Motif ACGT planted as ACGT at position 0", *seqs]) + "\n")
        if seqs and l:
            every[name] = {w for w, n in supports(seqs, l, d).items() if n == 3}
    lines = R.lines(spark, str(tmp_path / "in"))
    found, distances = {}, {}
    for r in plans.search_files(lines, 1, 3, 1).collect():
        found.setdefault(os.path.basename(r.file), set()).add(r.motif)
        distances[os.path.basename(r.file), r.motif] = r.distance
    assert found == every and distances["a_l4_d1.txt", "ACGT"] == 0 and distances["b_l5_d0.txt", "ACGTA"] is None
    assert cli.main(["-l", "3", "-d", "1", "--header-mode", "strict", str(tmp_path / "in")]) == 0
    out = tmp_path / "in" / "output"
    assert {n for n in os.listdir(out) if not n.startswith(".")} == {"out_a_l4_d1_ems2_l4_d1.txt", "out_b_l5_d0_ems2_l5_d0.txt", "out_plain_ems2_l3_d1.txt"}
    assert [x.split("\t")[0] for x in (out / "out_b_l5_d0_ems2_l5_d0.txt").read_text().splitlines()] == sorted(every["b_l5_d0.txt"])
    assert cli.main(["-s", "2p", str(tmp_path / "in")]) == 255


def test_result_is_one_file_that_appears_whole(spark, tmp_path):
    path = tmp_path / "r.txt"
    rows = spark.createDataFrame([("C", None), ("A", 1), ("B", 0)], "motif string, distance long").repartition(3)
    R.write_motifs(rows, str(path))
    assert path.is_file() and path.read_text() == "A\tDistance: 1\nB\tDistance: 0\nC\tDistance: N/A\n"
    with pytest.raises(Exception):
        R.write_motifs(rows.withColumn("motif", F.raise_error(F.lit("broken"))), str(path))
    assert path.read_text().startswith("A\t") and [n for n in os.listdir(tmp_path) if not n.endswith(".crc")] == ["r.txt"]
    R.write_motifs(rows.limit(0), str(path))  # a later run replaces it
    assert path.is_file() and path.read_text() == ""


def test_command_line_limits(spark, tmp_path, capsys):
    path = tmp_path / "reads.txt"
    path.write_text("ACGTACGTACGT\nTTACGTTT\n")
    assert cli.main(["-s", "2p", "-l", "4", "-t", "0", str(path)]) == 255 and "one task" in capsys.readouterr().err
    assert cli.main(["-l", "4", "-q", "0", str(path)]) == 255
    (tmp_path / "words.txt").write_text("acgt\nAAAA\n")
    assert cli.main(["-l", "4", "-d", "0", "-w", str(tmp_path / "words.txt"), str(path)]) == 0
    assert (tmp_path / "output" / "out_reads_ems2_l4_d0.txt").read_text() == "ACGT\tDistance: N/A\n"
    (tmp_path / "long.txt").write_text("A" * 40 + "\n")
    assert cli.main(["-s", "2p", "-l", "33", "-d", "0", str(tmp_path / "long.txt")]) == 255 and "32 bases" in capsys.readouterr().err


@pytest.mark.parametrize("strategy", ["bitmap", "rows", "walk"])
def test_run_records_tell_the_memory_of_executors(spark, tmp_path, strategy):
    reads = frame(spark, drawn(random.Random(1), 60, 60))
    for _ in range(30):  # until Spark has heard from its executor
        MotifQuery(7, 1, 1, strategy).run(reads).count()
        if R.executor_peaks(spark):
            break
        time.sleep(0.5)
    R.append_run(spark, str(tmp_path / "runs"), strategy, 7, 1, 1.0, 5)
    record = spark.read.json(str(tmp_path / "runs")).first()
    assert record.variant == strategy and record.max_rss_kb > 0
    assert [(e.executor, e.jvm_heap_kb > 0, e.jvm_rss_kb > 0, e.python_rss_kb > 0) for e in record.executors] == [("driver", True, True, True)]
