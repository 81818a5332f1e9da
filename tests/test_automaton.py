"""The distance automaton of words against the definition."""

import itertools
import random

import numpy as np
import pytest
from test_motifs import distance, frame

from strandmill.operators import automaton, bitmap


@pytest.mark.parametrize("l,d", [(3, 1), (4, 2), (2, 2), (5, 2), (1, 1), (4, 0), (6, 3)])
def test_each_neighbour_comes_once(l, d, monkeypatch):  # noqa: E741
    rng = random.Random(l * 10 + d)
    words = ["".join(rng.choices("ACGT", k=rng.randrange(max(1, l - d - 1), l + d + 2))) for _ in range(8)]
    every = list(enumerate(map("".join, itertools.product("ACGT", repeat=l))))
    expected = {(i, c) for i, w in enumerate(words) for c, u in every if distance(u, w) <= d}
    for pairs in (1 << 17, 64):  # chunks that are split on the way
        monkeypatch.setattr(automaton, "PAIRS", pairs)
        found = [(i, c) for at, codes in automaton.near(words, l, d) for i, c in zip(at.tolist(), codes.tolist())]
        assert len(found) == len(set(found)) and set(found) == expected
    assert list(automaton.near([], l, d)) == []


def test_reads_count_each_word_once(spark):
    rng = random.Random(1)
    reads = frame(spark, ["".join(rng.choices("ACGT", k=n)) for n in (70, 30, 9, 2, 0)])
    found = {}
    for r in automaton.read_words(reads, 7, 2).collect():
        found[r.code] = found.get(r.code, 0) + 1
    expected = bitmap.supports(reads, 7, 2).collect()
    assert found == {int(r.w.translate(str.maketrans("ACGT", "0123")), 4): r.n_reads for r in expected}


@pytest.mark.parametrize("l,d", [(4, 2), (5, 1), (2, 2), (1, 1), (4, 0), (6, 1)])
def test_kept_neighbours_count_each_read_once(l, d, monkeypatch):  # noqa: E741
    """Words are walked once, however many reads hold them; chunks of all kinds, and empty reads."""
    rng = random.Random(l + 10 * d)
    seqs = ["".join(rng.choices("ACGT", k=n)) for n in (40, 9, 0, 2, 300, 1, 30, 30, 0)]
    every = list(enumerate(map("".join, itertools.product("ACGT", repeat=l))))
    words = [{s[i : i + k] for k in range(max(1, l - d), l + d + 1) for i in range(len(s) - k + 1)} for s in seqs]
    known = {x: {c for c, u in every if distance(u, x) <= d} for x in set().union(*words)}
    expected = [sum(any(c in known[x] for x in own) for own in words) for c, _ in every]
    walked, near = [], automaton.near
    monkeypatch.setattr(automaton, "near", lambda words, *a: walked.extend(words) or near(words, *a))
    for expanded, pairs in ((1 << 21, 1 << 16), (100, 64)):
        monkeypatch.setattr(automaton, "EXPANDED", expanded)
        monkeypatch.setattr(automaton, "PAIRS", pairs)
        kept, counts = automaton.Kept(l, d), np.zeros(4**l, np.int64)
        for part in (seqs, seqs[:3], [], [""]):
            kept.add(part, counts)
        first = [sum(any(c in known[x] for x in own) for own in words[:3]) for c, _ in every]
        assert counts.tolist() == [a + b for a, b in zip(expected, first)]
        assert len(walked) == len(set(walked)) == len(known)
        walked.clear()


@pytest.mark.parametrize("l,d", [(8, 1), (5, 1), (3, 2), (4, 0)])
def test_marked_and_sorted_neighbours_count_the_same(l, d, monkeypatch):  # noqa: E741
    """Over 255 reads with the same words, reads without words among them, in blocks of all sizes."""
    rng = random.Random(l)
    some = ["".join(rng.choices("ACGT", k=n)) for n in (32, 12, 0, l, 60)]
    seqs = some * 120
    words = [{s[i : i + k] for k in range(max(1, l - d), l + d + 1) for i in range(len(s) - k + 1)} for s in some]
    expected = np.zeros(4**l, np.int64)
    for own in words:
        if codes := [c for _, c in automaton.near(sorted(own), l, d)]:
            expected[np.unique(np.concatenate(codes))] += 120
    kept = automaton.Kept(l, d)
    for cells, each, expanded in ((1 << 21, 1 << 30, 1 << 21), (1 << 21, 0, 1 << 21), (1, 1 << 30, 1 << 21), (4**l * 7, 1 << 30, 100), (1, 0, 5000)):
        monkeypatch.setattr(automaton, "CELLS", cells)
        monkeypatch.setattr(automaton, "CELLS_EACH", each)
        monkeypatch.setattr(automaton, "EXPANDED", expanded)
        counts = np.zeros(4**l, np.int64)
        kept.add(seqs, counts)
        assert counts.tolist() == expected.tolist()


def test_read_counts_are_supports(spark):
    rng = random.Random(9)
    reads = frame(spark, ["".join(rng.choices("ACGT", k=n)) for n in (70, 30, 9, 2, 0)] * 20)
    for l, d in ((8, 1), (4, 2)):  # noqa: E741
        found = automaton.read_counts(reads, l, d).groupBy("code").sum("n").collect()
        expected = bitmap.supports(reads, l, d).collect()
        assert dict(map(tuple, found)) == {int(r.w.translate(str.maketrans("ACGT", "0123")), 4): r.n_reads for r in expected}


def test_neighbourhood_of_odd_words(spark):
    words = spark.createDataFrame([("ACG",), (None,), ("",), ("A" * 40,)], "x string")
    assert {r.x for r in automaton.neighbourhood(words, 3, 1).collect()} == {"ACG"}
