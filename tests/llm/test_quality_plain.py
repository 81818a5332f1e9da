"""The quality classifier against a plain version: least squares on stacked rows, and isotonic regression by its max-min formula."""

import random
import zlib

import numpy as np

from strandmill.llm import quality


def plain(texts, labels):
    """Score of each text by id."""
    part = lambda i: zlib.crc32(str(i).encode()) % 5
    stats = {i: np.array(quality.statistics(t)) for i, t in texts.items()}
    fit = [(stats[i], y) for i, y in labels if part(i) in (1, 2, 3)]
    x, y = np.array([s for s, _ in fit]), np.array([float(y) for _, y in fit])
    mean, scale = x.mean(0), x.std(0)
    scale[scale < 1e-9] = 1
    z = quality.cosines((x - mean) / scale)
    free = np.sqrt(quality.RIDGE) * np.eye(z.shape[1])
    free[-1, -1] = 0  # the constant is not shrunk
    weights = np.linalg.lstsq(np.vstack([z, free]), np.concatenate([y, np.zeros(len(free))]), rcond=None)[0]
    raw = {i: float((quality.cosines((s[None] - mean) / scale) @ weights)[0]) for i, s in stats.items()}
    bins = {}
    for i, label in labels:
        if part(i) == 4:
            r = min(2.0, max(-1.0, raw[i]))
            bins.setdefault(int((r + 1) / 3 * quality.BINS), []).append((r, label))
    rows = [(np.mean([r for r, _ in b]), sum(y for _, y in b), len(b)) for _, b in sorted(bins.items())]
    mean_of = lambda a, b: sum(k for _, k, _ in rows[a : b + 1]) / sum(n for _, _, n in rows[a : b + 1])
    levels = [max(min(mean_of(a, b) for b in range(i, len(rows))) for a in range(i + 1)) for i in range(len(rows))]
    pools = {}
    for (r, _, n), level in zip(rows, levels):
        pools.setdefault(round(level, 12), []).append((r, n))
    edges = [sum(r * n for r, n in p) / sum(n for _, n in p) for _, p in sorted(pools.items())]
    return {i: float(np.interp(r, edges, sorted(pools))) for i, r in raw.items()}


def test_query_matches_the_plain_version(spark, tmp_path):
    rng = random.Random(4)
    good = lambda: ". ".join(" ".join(rng.choices(["the", "river", "runs", "slowly", "to", "sea", "Hills"], k=rng.randrange(3, 12))) for _ in range(rng.randrange(1, 6))) + "."
    poor = lambda: " ".join(rng.choices(["###", "buy!!", "$$$", "the", "river", "A%1"], k=rng.randrange(2, 30)))
    kinds = [rng.random() < 0.6 for _ in range(160)]
    texts = {i: good() if k else poor() for i, k in enumerate(kinds)} | {200: None, 201: "", 202: texts_tie()}
    texts |= {i: texts_tie() for i in range(203, 209)}  # equal raw scores with different labels
    labels = [(i, int(k if rng.random() < 0.9 else not k)) for i, k in enumerate(kinds)] + [(i, i % 2) for i in range(200, 209)] + [(5, 1), (5, 0)]
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, y, 0) for i, y in labels] + [(7, None, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    found = {r.doc_id: r for r in quality.op4_quality(spark, str(tmp_path)).collect()}
    expected = plain(texts, labels)
    assert found.keys() == expected.keys()
    for i, row in found.items():
        assert abs(row.score - expected[i]) < 1e-5 and row.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and row.predicted == (row.score >= 0.3)


def texts_tie():
    return "The same words again."
