"""Wildcard patterns and incremental supports."""

import random

import pytest
from pyspark.sql import functions as F
from test_motifs import frame

from strandmill.operators import bitmap, neighbours, patterns
from strandmill.operators.incremental import SupportTable


@pytest.mark.parametrize("l,d", [(4, 1), (4, 2), (2, 2), (6, 1), (5, 0), (1, 1)])
def test_patterns_stand_for_the_neighbourhood(spark, l, d):  # noqa: E741
    rng = random.Random(l + d)
    xs = sorted({"".join(rng.choices("ACGT", k=rng.randrange(max(1, l - d - 1), l + d + 2))) for _ in range(30)})
    words = spark.createDataFrame([(x,) for x in [*xs, ""]], "x string")
    made = patterns.neighbourhood(words, l, d).cache()
    near = {(r.x, r.w) for r in neighbours.neighbourhood(words, l, d).collect()}
    assert {(r.x, r.w) for r in patterns.expanded(made, l, "x").collect()} == near
    assert not d or made.count() < len(near)  # fewer rows than concrete words
    first = set(xs[::2])
    both = patterns.intersection(made.where(F.col("x").isin(*first)), made.where(~F.col("x").isin(*first)), l, d)
    assert {r.w for r in patterns.expanded(both, l).collect()} == {w for x, w in near if x in first} & {w for x, w in near if x not in first}


def test_pattern_letters(spark):
    row = spark.createDataFrame([("ACGT",)], "x string").select(patterns.from_word(F.col("x")).alias("p"))
    assert row.select(patterns.to_text(F.col("p").bitwiseOR(F.lit(15))), patterns.to_text(F.col("p").bitwiseOR(F.lit(3)))).first()[:] == ("ACG*", "ACGB")
    with pytest.raises(ValueError):
        patterns.neighbourhood(row, 14, 2)


def test_supports_grow_by_batches(spark, tmp_path):
    rng = random.Random(3)
    batches = [["".join(rng.choices(letters, k=n)) for n in (20, 9, 2)] for letters in ("ACGT", "AC", "T")]
    table, path, so_far = None, str(tmp_path / "supports"), []
    for i, seqs in enumerate(batches, 1):
        table = SupportTable(spark, path, 5, 1)
        before = table.manifest()["buckets"]
        assert table.add(i, frame(spark, seqs)) and not table.add(i, frame(spark, ["ACGTACGT"]))
        so_far += seqs
        assert {r.w: r.n_reads for r in table.supports().collect()} == {r.w: r.n_reads for r in bitmap.supports(frame(spark, so_far), 5, 1).collect()}
        after = table.manifest()
        touched = {r.w[:3] for r in bitmap.supports(frame(spark, seqs), 5, 1).collect()}
        assert after["reads"] == len(so_far) and {b for b, v in after["buckets"].items() if before.get(b) != v} == touched
    assert {v for v in table.manifest()["buckets"].values()} == {1, 2, 3}  # untouched buckets stayed
    assert table.add(4, frame(spark, [])) and table.manifest()["reads"] == len(so_far)
    with pytest.raises(ValueError):
        table.add(9, frame(spark, ["ACGT"]))
    with pytest.raises(ValueError):
        SupportTable(spark, path, 6, 1)
