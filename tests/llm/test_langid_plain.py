"""Language ID against a plain out-of-place version, on ties of counts and of cost too."""

import random
import zlib
from collections import Counter

from strandmill.llm import langid


def breaks(text):
    letters = "".join((c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " " for c in text or "")
    return " ".join(letters.split())


def grams(text):
    said = breaks(text)
    if not said:
        return Counter()
    said = f" {said} "
    found = Counter(c for c in said if c != " ")
    found.update(said[i : i + 2] for i in range(len(said) - 1))
    found.update(said[i : i + 3] for i in range(len(said) - 2) if said[i + 1] != " ")
    return found


def code(gram):
    out = 0
    for c in gram:
        out = out << 21 | ord(c)
    return out


def ranked(counts, size):
    return sorted(counts, key=lambda g: (-counts[g], code(g)))[:size]


def plain(rows, size):
    """(lang, score) of each text from profiles of the rows that are not held out."""
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    sums = {}
    for i, text, lang in rows:
        if lang is not None and text is not None and not held(i):
            sums.setdefault(lang, Counter()).update(grams(text))
    known = {k: {g: r for r, g in enumerate(ranked(c, size))} for k, c in sums.items() if c}
    out = {}
    for i, text, _ in rows:
        own = ranked(grams(text), size)
        costs = {k: sum(abs(p[g] - r) if g in p else size for r, g in enumerate(own)) for k, p in known.items()}
        best = min(costs, key=lambda k: (costs[k], k), default=None)
        out[i] = (best, 1 - costs[best] / (size * len(own))) if own and known else ("und", 0.0)
    return out


def test_query_matches_the_plain_version(spark, tmp_path):
    rng = random.Random(6)
    sounds = {"aa": ["ka", "lo", "mi"], "bb": ["ßt", "Öl", "un"], "cc": ["字", "語 ", "漢"], "dd": ["ka", "lo", "mi"]}  # aa and dd are alike
    said = lambda lang: " ".join("".join(rng.choices(sounds[lang], k=rng.randrange(1, 4))) for _ in range(rng.randrange(1, 60)))
    rows = [(i, said(lang), lang) for i, lang in enumerate(rng.choices(list(sounds), k=80))]
    rows += [(100, None, "aa"), (101, "", "bb"), (102, "12 ?!", "cc"), (103, "ab ab", None), (104, "İx ﬁ Ǆ", "aa"), (105, "ka " * 5000, "aa")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    found = {r.doc_id: (r.lang_pred, r.score) for r in langid.op6_language_id(spark, str(tmp_path)).collect()}
    expected = plain(rows, langid.SIZE)
    assert {i: lang for i, (lang, _) in found.items()} == {i: lang for i, (lang, _) in expected.items()}
    assert all(abs(found[i][1] - score) < 1e-12 for i, (_, score) in expected.items())
