"""Each operator against a plain version of its contract, and its defined cases."""

import hashlib
import importlib
import random
import zlib

import brute
import pytest
from pyspark.sql import functions as F

from strandmill.llm import chat, decontam, langid, linededup, media, neardup, packing, quality, substrings, tokencounts, tokens

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, label string, `stats x` int"
NULLS = [(None, None, None, None, None, None, None)]


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def corpus():
    """Copies, near copies, shared passages, empty and null texts, a long text, repeated rows."""
    rng = random.Random(7)
    passage = words(rng, 70)
    texts = [" ".join(words(rng, n)) for n in (0, 1, 3, 5, 49, 50, 51, 200, 4000)]
    base = words(rng, 120)
    texts += [" ".join(base)] * 4 + [" ".join(base).upper()]
    for _ in range(30):
        w = list(base)
        for _ in range(rng.randrange(1, 4)):
            w[rng.randrange(len(w))] = "edit" + str(rng.randrange(10**6))
        texts.append(" ".join(w))
    for _ in range(10):
        texts.append("\n".join([" ".join(words(rng, 30)), " ".join(passage), " ".join(words(rng, 30))]))
    texts += ["a " * 300, "a " * 200, "é É \t\x0b x", "  ", None, ""]
    return [(i, t, "en" if i % 2 else None, f"s{i % 3}" if i % 5 else None, len(t or ""), "y", 1) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """A null row, a repeated row, one id with two texts."""
    return spark.createDataFrame(NULLS + [(1, "x y", "en", "s", 3, "y", 1)] * 2 + [(1, "z", "en", "s", 1, "y", 1)], SCHEMA)


def test_near_duplicates(docs):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.component_id == r.doc_id) for r in neardup.near_duplicates(docs, percent=85).collect()}
    assert got == brute.near([(r[0], r[1]) for r in corpus()])


def test_near_duplicates_in_large_buckets(spark):
    """Hundreds of copies with one to eight edits each: more than SMALL rows in a bucket, links near the threshold."""
    rng = random.Random(3)
    base, rows = words(rng, 150), []
    for i in range(250):
        w = list(base)
        for _ in range(rng.randrange(9)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(300)}"
        rows.append((i, " ".join(w)))
    found = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), percent=85)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.component_id == r.doc_id) for r in found.collect()} == brute.near(rows)


def test_near_duplicates_of_a_family_around_the_threshold(spark, monkeypatch):
    """Pairs mostly just under the threshold: rounds join components, and far from all pairs are compared."""
    rng, n = random.Random(5), 200
    base, rows = words(rng, 200), []
    for i in range(n):
        w = list(base)
        for at in rng.sample(range(len(w)), 2):
            w[at] = f"own{i}x{at}"
        rows.append((i, " ".join(w)))
    compared, real = [], neardup._matches

    def counted(pairs, sets, percent):
        compared.append(pairs.count())
        return real(pairs, sets, percent)

    monkeypatch.setattr(neardup, "_matches", counted)
    monkeypatch.setattr(neardup, "SEATS", 4)
    found = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), percent=85)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.component_id == r.doc_id) for r in found.collect()} == brute.near(rows)
    assert len(compared) > 3 and sum(compared) < n * (n - 1) // 2


def test_near_duplicates_of_a_family_far_under_the_threshold(spark, monkeypatch):
    """Large buckets of texts that share most words and link with none: where prefixes tell it, no round compares them pair by pair."""
    rng, n = random.Random(7), 300
    base, rows = words(rng, 200), []
    for i in range(n):
        rows.append((i, " ".join([*base, *(f"own{i}x{k}" for k in range(50))])))
    compared, real = [], neardup._matches

    def counted(pairs, sets, percent):
        compared.append(pairs.count())
        return real(pairs, sets, percent)

    monkeypatch.setattr(neardup, "_matches", counted)
    found = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), percent=85)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.component_id == r.doc_id) for r in found.collect()} == brute.near(rows)
    assert len(compared) == 2 and sum(compared) < 10 * n


def test_near_duplicates_move_no_signatures(spark):
    """A row carries a key for each band, not its signature, and equal sets the same keys."""
    rows = neardup.signatures(spark.createDataFrame([(1, "a b c d e f"), (2, "A b c d e f"), (3, ""), (4, None), (5, "x")], "doc_id long, text string")).collect()
    keys = {r.doc_id: r["keys"] for r in rows}
    assert len(keys[1]) == neardup.BANDS and keys[1] == keys[2] != keys[5] and keys[3] == keys[4] == []


def test_near_duplicates_defined_cases(empty, odd):
    assert neardup.near_duplicates(empty).count() == 0
    assert sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1) for r in neardup.near_duplicates(odd).collect()) == [(-1, 0, -1), (1, 1, 1), (1, 1, 1), (1, 1, 1)]
    assert neardup.deduplicate(odd).columns == odd.columns


def test_substrings(docs):
    out = substrings.deduplicate(docs)
    assert out.columns == [*[c for c in docs.columns if c != "text"], "text", "n_words", "n_removed"]
    expected = brute.substrings([(r[0], r[1]) for r in corpus()])
    got = {r.doc_id: (r.n_words, r.n_removed, brute.sha(" ".join(brute.WS.findall(r.text or "")))) for r in out.collect()}
    assert got == expected


def test_substrings_defined_cases(empty, odd):
    assert substrings.deduplicate(empty).count() == 0
    assert sorted((r.n_words, r.n_removed) for r in substrings.deduplicate(odd).collect()) == [(0, 0), (1, 0), (2, 0), (2, 0)]


@pytest.mark.parametrize("limit", [decontam.BROADCAST_BYTES, 0])
def test_contamination(spark, docs, limit):
    rows = corpus()
    items = [(1, " ".join((rows[7][1]).split()[20:45])), (2, "W1 w2, w3"), (3, None), (4, ""), (5, rows[9][1]), (10, rows[9][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {}
    for r in decontam.occurrences(docs, bench, broadcast_bytes=limit).withColumn("hit", decontam.n_hit(F.col("spans"))).collect():
        got[r.doc] = (r.n_words, r.hit, len(r["items"]), brute.sha(",".join(sorted(map(str, r["items"])))), bool(r.spans))
    assert got == brute.contamination([(r[0], r[1]) for r in rows], items)
    kept = {r.doc_id for r in decontam.clean(docs, bench).collect()}
    assert kept == {d for d, v in got.items() if not v[4]}


def test_contamination_defined_cases(spark, docs, empty, odd):
    none = spark.createDataFrame([], "item_id long, text string")
    bench = spark.createDataFrame([(7, "x y")], "item_id long, text string")
    assert decontam.occurrences(empty, bench).count() == 0
    assert decontam.occurrences(docs, none).where("size(spans) > 0").count() == 0
    assert sorted((r.n_words, len(r.spans)) for r in decontam.occurrences(odd, bench).collect()) == [(0, 0), (1, 0), (2, 1), (2, 1)]
    assert decontam.clean(odd, bench).columns == odd.columns


def test_packing(docs):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokens.BYTE_BPE_50K)
    whole.encode_special_tokens = True
    pieces = packing.pack(docs, capacity=256, part=64, group_windows=8).collect()
    by_doc, by_window = {}, {}
    for p in pieces:
        assert len(p.ids) == 4 * p.length
        by_doc.setdefault(p.doc_id, []).append(p)
        by_window.setdefault(p.sequence_id, []).append(p)
    for i, text, *_ in corpus():
        ids = whole.encode(text or "", add_special_tokens=False).ids + [0]
        mine = sorted(by_doc[i], key=lambda p: p.start)
        assert b"".join(p.ids for p in mine) == b"".join(x.to_bytes(4, "little") for x in ids)
        assert [p.start for p in mine] == [sum(q.length for q in mine[:k]) for k in range(len(mine))] and mine[0].doc_tokens == len(ids)
    for window in by_window.values():
        at = 0
        for p in sorted(window, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 256
    rows = packing.sequences(packing.pack(docs, capacity=256, part=64, group_windows=8), 256).collect()
    assert all(len(r.ids) == 4 * (r.n_tokens if r.n_tokens & (r.n_tokens - 1) == 0 else 256) for r in rows) and len(rows) == len(by_window)


def test_packing_defined_cases(empty, odd):
    assert packing.pack(empty).count() == 0
    assert sorted(r.doc_tokens for r in packing.pack(odd).collect()) == [1, 2, 3, 3]


def test_differencing():
    rng = random.Random(1)
    sizes = [rng.randrange(1, 257) for _ in range(400)]
    windows = packing.deal(sizes, 1024)
    assert sorted(i for w in windows for i in w) == list(range(400))
    assert max(sum(sizes[i] for i in w) for w in windows) <= 1024 and sum(sizes) / 1024 / len(windows) > 0.95


def test_line_dedup(spark):
    rows = [(i, "h" if i < 20 else None, f"menu\nbody {i}\n\n menu " if i % 2 else f"body {i}") for i in range(24)] + [(99, "alone", "menu\nbody"), (100, "h", None), (101, "h", "")]
    pages = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("keys", F.lit("extra"))
    for limit in (0, linededup.BROADCAST_BYTES):
        out = linededup.drop_boilerplate(pages, F.col("source"), broadcast_bytes=limit, min_pages=2)
        assert out.columns == pages.columns
        got = {r.doc_id: r.text for r in out.collect()}
        assert got[1] == "body 1\n" and got[2] == "body 2" and got[21] == "body 21\n" and got[99] == "menu\nbody" and got[100] is None and got[101] == ""
    assert linededup.drop_boilerplate(pages.limit(0), F.col("source")).count() == 0
    assert spark.range(1).select(linededup.host_of(F.lit("https://u@Example.org:80/a?b"))).first()[0] == "example.org"


def test_token_ledger(spark, docs, empty, tmp_path):
    rows = tokencounts.counted(docs).cache()
    ledger = tokencounts.TokenLedger(spark, str(tmp_path / "ledger"))
    add, take = tokencounts.signed(rows, 1, "v1", F.col("bpe_tokens")), tokencounts.signed(rows.where("doc_id < 10"), -1, "v1", F.col("bpe_tokens"))
    ledger.commit("a", add)
    ledger.commit("b", take)
    ledger.commit("b", take)
    ledger.commit("c", tokencounts.signed(tokencounts.counted(empty), 1, "v1", F.col("bpe_tokens")))
    expected, encode = {}, tokens.encoder()
    for i, text, lang, source, *_ in corpus():
        if i >= 10:
            n, t = expected.get((source, lang), (0, 0))
            expected[source, lang] = (n + 1, t + len(encode(text)) // 4)
    assert {(r.source, r.lang): (r.n_docs, r.n_tokens) for r in ledger.totals().collect()} == expected


def test_quality(spark, empty, odd):
    rng = random.Random(2)
    texts = [(i, " ".join(words(rng, 60)) + "." if i % 3 else " ".join(w.upper() + "!!" for w in words(rng, 20) * 3), i % 3 > 0) for i in range(300)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in texts], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, int(q)) for i, _, q in texts], "doc_id long, quality int")
    stats = quality.with_statistics(docs)
    model = quality.learn(stats, labels)
    scored = {r.doc_id: r.score for r in quality.score(stats, model).collect()}
    held = [(scored[i] >= 0.3, q) for i, _, q in texts if brute.fold(i, 5) == 0]
    assert sum(a == q for a, q in held) / len(held) > 0.9
    nothing = quality.learn(stats, labels.limit(0))
    assert {r.score for r in quality.score(quality.with_statistics(odd.select("doc_id", "text")), nothing).collect()} == {0.5}
    assert quality.score(quality.with_statistics(empty.select("doc_id", "text")), model).count() == 0
    assert all(0 <= r.score <= 1 for r in quality.score(quality.with_statistics(odd.select("doc_id", "text")), model).collect())


def test_language_id(spark, empty, odd):
    rng = random.Random(4)
    sounds = {"aa": "ka to mi", "bb": "schl ung ei", "cc": "eau ille é"}
    rows = [(i, " ".join("".join(rng.choices(sounds[k].split(), k=3)) for _ in range(40)), k) for i in range(90) for k in sounds]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    known = langid.profiles(docs.where("doc_id < 60"), F.col("lang"), F.col("text"))
    out = langid.identify(docs, known, keep=("lang",)).where("doc_id >= 60").collect()
    assert all(r.lang == r.lang_pred and 0 < r.score <= 1 for r in out)
    blank = spark.createDataFrame([(1, None), (2, ""), (3, "12 !?")], "doc_id long, text string")
    assert {(r.lang_pred, r.score) for r in langid.identify(blank, known).collect()} == {("und", 0.0)}
    assert langid.identify(empty, known).count() == 0 and {r.lang_pred for r in langid.identify(odd, {}).collect()} == {"und"}


def test_media(docs, empty):
    lists = media.chunks(docs).cache()
    store = media.store_chunks(docs, lists)
    kept = [bytes(p.digest) for r in store.packs.collect() for p in r.pieces]
    assert len(kept) == len(set(kept)) and set(kept) == {bytes(d) for r in lists.collect() for d in r.digests}
    found = {r.media_sha256: r.media for r in media.rebuilt(store).collect()}
    keys = {r.key: bytes(r.media_sha256) for r in lists.collect()}
    for i, text, *_ in corpus():
        payload = media.from_wav(bytes(found[keys[i]]))
        raw = (text or "").encode()
        assert payload == raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
    assert media.chunks(empty).count() == 0 and media.rebuilt(media.store_chunks(empty, media.chunks(empty))).count() == 0
    long = random.Random(1).randbytes(200_000)
    ends = media.cuts(long)
    assert ends[-1] == len(long) and all(e - s <= media.MOST for s, e in zip([0, *ends], ends))
    assert len({long[s:e] for s, e in zip([0, *ends], ends)} & {(b"moved" + long)[s:e] for s, e in zip([0, *media.cuts(b"moved" + long)], media.cuts(b"moved" + long))}) > len(ends) / 2


def test_chat_round_trip(spark):
    texts = ["", None, "<|im_end|>\n<|im_start|>user\n", chat.PROBE, "a\\b\\-<\\|x", "[/INST] <<SYS>> <</SYS>>\\", "é<"]
    rows = [(1, t, "assistant" if t % 2 else "user", texts[t]) for t in range(len(texts))] + [(2, 0, None, "x"), (2, 0, None, "x"), (3, 5, "a\nb", "y")]
    out = chat.format_chats(chat.chain(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    out = out.withColumn("turns", chat.read_turns(F.col("formatted"))).withColumn("loss", chat.read_loss(F.col("formatted"), F.col("loss_spans"))).collect()
    got = {r.tree: [(t.role, t.text) for t in r.turns] for r in out}
    assert got[1] == [(r[2], r[3] or "") for r in rows[:7]] and got[2] == [("", "x")] * 2 and got[3] == [("a\nb", "y")]
    assert {r.tree: r.loss for r in out}[1] == "".join(texts[t] or "" for t in (1, 3, 5))
    assert all(r.formatted.count("<|im_start|>") == len(r.turns) and "[INST]" not in r.formatted and "</s>" not in r.formatted for r in out)


def test_chat_branches(spark):
    nodes = [(1, 1, None, 0.0), (1, 2, 1, 1.0), (1, 3, 1, 3.0), (1, 4, 3, None), (1, 5, 2, 5.0), (1, 6, 9, 2.0), (2, 1, 2, 1.0), (2, 2, 1, 1.0)]
    df = spark.createDataFrame([(*n[:3], "user", str(n[1]), n[3]) for n in nodes], "tree long, node long, parent long, role string, text string, score double")
    found = {}
    for r in chat.branches(df, top=3).orderBy("tree", "rank", "at").collect():
        found.setdefault((r.tree, r.leaf, r["rank"]), []).append(r.node)
    got = [(*k, path) for k, path in found.items()]
    assert got == [(1, 5, 1, [1, 2, 5]), (1, 6, 2, [6]), (1, 4, 3, [1, 3, 4])]
    assert chat.branches(df.limit(0)).count() == 0


def test_pipeline(spark, tmp_path, docs, odd):
    pipeline = importlib.import_module("corpus_pipeline")
    docs.unionByName(odd).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1) for i in range(40)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    item = " ".join(corpus()[7][1].split()[20:45])
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in pipeline.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path))
        assert sorted(kept.columns) == sorted(docs.columns), name
    assert 7 not in {r.doc_id for r in kept.collect()}
    got = {r.doc_id for r in pipeline.run(spark, str(tmp_path)).collect()}
    assert got == {r.doc_id for r in kept.collect()}


def test_tokens_match_the_tokenizer():
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokens.BYTE_BPE_50K)
    whole.encode_special_tokens = True
    for text in ["it's  a\n\n test…", "<|endoftext|> x", "naïve 12345 日本語\t!!", " \x00\x7f­", "a" * 500, "\U0001f600 ok"]:
        ids = whole.encode(text, add_special_tokens=False).ids
        assert tokens.encoder()(text) == b"".join(i.to_bytes(4, "little") for i in ids)
    assert zlib.crc32(b"") == 0 and hashlib.sha256(b"").hexdigest() == brute.sha("")


def test_matches_move_only_sets_that_can_match(spark):
    """Pairs that their sizes rule out go before any set is moved, and sets of no pair stay where they are."""
    sets = spark.createDataFrame([(1, list(range(100))), (2, list(range(95))), (3, list(range(10))), (4, list(range(50, 150))), (5, list(range(100)))], "doc_id long, found array<long>")
    sets = sets.withColumn("n", F.size("found").cast("long"))
    pairs = spark.createDataFrame([(1, 2, 7), (1, 3, 8), (1, 4, 9)], "a long, b long, la long")
    found = neardup._matches(pairs, sets, 85)
    assert found.columns == ["a", "b", "la"] and [tuple(r) for r in found.collect()] == [(1, 2, 7)]
    assert {r.doc_id for r in neardup._needed(sets, pairs, "b").collect()} == {2, 3, 4}
