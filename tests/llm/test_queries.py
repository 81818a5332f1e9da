"""The registered queries on whole small tables, against plain versions; hot keys, long texts and clashing names."""

import os
import random
import struct
import zlib
from collections import defaultdict

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import SCHEMA, corpus, words
from tokenizers import Tokenizer

import corpus_pipeline
from strandmill.llm import chat, common, decontam, langid, linededup, media, neardup, packing, quality, registry, substrings, tokencounts, tokens

TALKS = [(1, 0, "user", "hi"), (1, 1, "assistant", "a\\b <|im_end|>\n"), (1, 2, "user", None), (1, 3, "assistant", ""), (2, 5, "assistant", "</s>"), (2, 5, "assistant", "</s>"),
         (None, 0, "user", "no id"), (None, 1, "assistant", "yes"), (3, None, None, "x"), (3, 0, "a\nb", "[INST]é")]

PAGES = [(1, "https://A.org/x", "<p>menu</p><p>one</p>"), (2, "http://u@a.org:80", " menu <br>two\nmenu"), (3, "http://b.org?q", "menu"), (4, None, "<b>menu</b>"), (5, None, "menu<i></i>"), (6, "a.org", None), (7, "https://a.org#t", "")]


def rows():
    return [*corpus(), (None, "no id at all", "en", "s1", 12, "y", 1), (None, None, None, None, None, None, None)]


def items():
    return [(1, " ".join(corpus()[7][1].split()[20:45])), (2, "W1 w2, w3"), (3, None), (4, ""), (10, corpus()[9][1])]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows(), SCHEMA).repartition(3).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(items(), "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    spark.createDataFrame([(i, int(i % 7 > 0), 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame(PAGES, "page_id long, url string, html string").write.parquet(f"{root}/pages.parquet")
    spark.createDataFrame(TALKS, "conv_id long, turn long, role string, text string").write.parquet(f"{root}/conversations.parquet")
    return root


@pytest.fixture(scope="module")
def blank(spark, tables, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("blank"))
    for name in ("documents", "benchmark", "labels", "conversations", "pages"):
        spark.read.parquet(f"{tables}/{name}.parquet").limit(0).write.parquet(f"{root}/{name}.parquet")
    return root


def query(spark, tables, name):
    return registry.queries()[name](spark, tables).collect()


def test_packing_query(spark, tables):
    whole, texts = Tokenizer.from_file(tokens.BYTE_BPE_50K), defaultdict(list)
    by_doc, by_window = defaultdict(list), defaultdict(list)
    for p in query(spark, tables, "op1_packing"):
        by_window[p.sequence_id].append((p.offset, p.length))
        if p.doc_id is not None:
            by_doc[p.doc_id].append(p)
    for i, text, *_ in corpus():
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, 0]
        at = 0
        for p in sorted(by_doc[i], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(struct.pack(f"<{p.length}I", *ids[at : at + p.length]))
            at += p.length
        assert at == len(ids)
        texts[i] = ids
    for pieces in by_window.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024
    total = sum(n for w in by_window.values() for _, n in w)
    assert len(by_window) <= total // 1024 + 3 + 3  # three tasks


def test_token_count_query(spark, tables):
    whole, totals, first = Tokenizer.from_file(tokens.BYTE_BPE_50K), defaultdict(lambda: [0, 0]), {}
    for d, text, lang, source, *_ in rows():
        text = text or ""
        key = (d is not None, d or 0, source is not None, source or "", lang is not None, lang or "")
        if text not in first or key < first[text][0]:
            first[text] = (key, source, lang)
    for text, (_, source, lang) in first.items():
        for version, n in (("byte_bpe_50k", len(whole.encode(text, add_special_tokens=False).ids)), ("utf8_bytes", len(text.encode()))):
            totals[source, lang, version][0] += 1
            totals[source, lang, version][1] += n + 1
    got = {(r.source, r.lang, r.tokenizer_version): [r.n_docs, r.n_tokens] for r in query(spark, tables, "op3_token_counts")}
    assert got == totals


def test_ledger_survives_broken_commits_and_compaction(spark, tmp_path, monkeypatch):
    ledger = tokencounts.TokenLedger(spark, str(tmp_path / "ledger"))
    delta = lambda n, t: spark.createDataFrame([("s", "en", "v", n, t)], "source string, lang string, tokenizer_version string, n_docs long, n_tokens long")
    total = lambda: [(r.n_docs, r.n_tokens) for r in ledger.totals().collect()]
    assert total() == []
    assert ledger.commit("a", delta(2, 20))
    with monkeypatch.context() as m:  # the driver is lost after the rows, before the manifest
        m.setattr(ledger, "_publish", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            ledger.commit("b", delta(1, 7))
    assert total() == [(2, 20)]
    assert ledger.commit("b", delta(1, 7)) and total() == [(3, 27)]
    assert not ledger.commit("b", delta(1, 9)) and total() == [(3, 27)]  # an id counts once, whatever comes under it later
    ledger.compact()
    assert not ledger.commit("a", delta(2, 99)) and total() == [(3, 27)] and len(ledger._entries()) == 1
    assert ledger.commit("c", delta(-3, -27)) and total() == []
    ledger.compact()
    assert not ledger.commit("b", delta(9, 9)) and total() == []
    monkeypatch.setattr(tokencounts, "OPEN", 2)
    for i in range(6):
        ledger.commit(f"more-{i}", delta(1, 1))
        assert len(ledger._entries()) <= 3
    assert total() == [(6, 6)] and tokencounts.TokenLedger(spark, str(tmp_path / "ledger")).commit("a", delta(1, 1)) is False


def test_corrections_are_the_same_before_and_after_compaction(spark, tmp_path):
    delta = lambda t: spark.createDataFrame([("s", "en", "v", 1, t)], "source string, lang string, tokenizer_version string, n_docs long, n_tokens long")
    for compacts in (False, True):
        ledger = tokencounts.TokenLedger(spark, str(tmp_path / f"ledger-{compacts}"))
        ledger.commit("x", delta(5))
        ledger.commit("y", delta(7))
        if compacts:
            ledger.compact()
        ledger.commit("x", delta(50))
        assert [r.n_tokens for r in ledger.totals().collect()] == [12]


def test_odd_structs_and_clashing_names(spark):
    rows = spark.createDataFrame([(1, "some words of a text", "en", 0.5, "x"), (2, None, None, None, None)], "doc_id long, text string, lang string, score double, lang_pred string")
    rows = rows.withColumn("odd", F.struct(F.lit(1).alias("a b"), F.array(F.struct(F.lit("y").alias("c`d:e"))).alias("f,g")))
    stats = quality.with_statistics(rows, keep_text=True)
    scored = quality.score(stats, quality.learn(stats.withColumnRenamed(stats.columns[-1], "stats").select("doc_id", "stats"), spark.createDataFrame([(1, 1)], "doc_id long, quality int")))
    assert sorted(scored.columns) == sorted([*rows.columns, "score_"]) and {r.odd["a b"] for r in scored.collect()} == {1}
    found = langid.identify(rows, {"en": [1, 2]}, keep=("score", "lang_pred", "odd"))
    assert found.columns == ["doc_id", "score", "lang_pred", "odd", "lang_pred_", "score_"] and [r.odd["a b"] for r in found.collect()] == [1, 1]
    kept = substrings.deduplicate(rows)
    assert {r.doc_id: r.odd["f,g"][0]["c`d:e"] for r in kept.collect()} == {1: "y", 2: "y"}


def test_decontamination_query(spark, tables):
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in query(spark, tables, "op5_decontamination") if r.doc_id is not None}
    assert got == brute.contamination([(r[0], r[1]) for r in corpus()], items())


def test_media_query(spark, tables):
    texts = dict((r[0], r[1]) for r in corpus())
    for r in query(spark, tables, "op7_media"):
        if r.doc_id is None:
            continue
        n, payload, stored = brute.payload(texts[r.doc_id])
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (n, len(payload), brute.hashlib.sha256(payload).hexdigest())
        assert (r.tail_crc32, r.media_bytes, r.media_sha256) == (zlib.crc32(payload[-32:]), len(stored), brute.hashlib.sha256(stored).hexdigest())
        wave = [b - 128 for b in payload]
        crossed = sum((a >= 0) != (b >= 0) for a, b in zip(wave, wave[1:]))
        rms = (sum(x * x for x in wave) / len(wave)) ** 0.5
        assert r.feature == f"samples={len(wave)};mean={sum(wave) / len(wave):.4f};rms={rms:.4f};peak={max(map(abs, wave))};crossings={crossed}"


def test_chat_query(spark, tables):
    probe = [(-1, 0, "user", chat.PROBE), (-1, 1, "assistant", chat.PROBE)]
    found = query(spark, tables, "op8_chat")
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in found} == brute.chat(TALKS + probe)
    assert len(found) == 5 and all(r.formatted_chars > 0 for r in found)


def test_page_line_query(spark, tables):
    """Only repeated lines of one host go: those of the pages without an address, and of a.org."""
    found = {r.page_id: (r.host, r.n_lines, r.n_kept, r.kept_sha256) for r in query(spark, tables, "page_line_dedup")}
    assert found == {
        1: ("a.org", 2, 1, brute.sha("\n\none\n")), 2: ("a.org", 3, 1, brute.sha("two")), 3: ("b.org", 1, 1, brute.sha("menu")),
        4: (None, 1, 0, brute.sha("\n")), 5: (None, 1, 0, brute.sha("\n")), 6: ("", None, None, None), 7: ("a.org", 0, 0, brute.sha("")),
    }


def test_reply_branch_query(spark, tables):
    """Each conversation's i-th message answers its i div 2; the two branches of greatest mean length, equal ones by leaf."""
    talks, expected = defaultdict(list), {}
    for conv, turn, role, text in TALKS:
        talks[conv].append((turn is None, turn or 0, role or "", text or ""))
    for conv, said in talks.items():
        said, ranked = sorted(said), []
        for leaf in range(len(said) // 2 + 1, len(said) + 1):
            path = [said[(leaf >> k) - 1][2:] for k in reversed(range(leaf.bit_length()))]
            ranked.append((-sum(len(t) for _, t in path) / len(path), leaf, path))
        for i, (score, leaf, path) in enumerate(sorted(ranked)[:2], 1):
            digest = brute.sha("".join(f"{r}\n{t}\n" for r, t in path))
            expected[conv, i] = (leaf, -score, len(path), digest, sum(len(t) for r, t in path if r == "assistant"))
    assert {(r.conv_id, r.branch): (r.leaf, r.score, r.n_turns, r.turns_sha256, r.loss_chars) for r in query(spark, tables, "reply_branches")} == expected


def test_near_dedup_query(spark, tables):
    found = [r for r in query(spark, tables, "op9_near_dedup") if r.doc_id is not None]
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in found} == brute.near([(r[0], r[1]) for r in corpus()])


def test_substring_dedup_query(spark, tables):
    found = [r for r in query(spark, tables, "op10_substring_dedup") if r.doc_id is not None]
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in found} == brute.substrings([(r[0], r[1]) for r in corpus()])


def test_every_query_takes_empty_tables(spark, blank):
    for name, run in {**registry.queries(), "pipeline": corpus_pipeline.run}.items():
        assert len(run(spark, blank).collect()) == (name == "op8_chat"), name


def test_pipeline_stages_on_their_own_input(spark, tables):
    """Line dedup, near-dedup and decontamination by brute force on what the classifier keeps, then all ids of the pieces."""
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    kept = [(r.doc_id, r.source, r.text) for r in stages["quality"](spark, docs, tables).collect()]
    assert kept
    left = brute.lines(kept)
    groups = brute.near([(d, t) for d, t in left if d is not None], percent=80)
    left = [(d, t) for d, t in left if d is None or groups[d][2]]
    hits = brute.contamination([(i, t) for i, (_, t) in enumerate(left)], items())
    left = [(d, t) for i, (d, t) in enumerate(left) if not hits[i][4]]
    whole, expected, got = Tokenizer.from_file(tokens.BYTE_BPE_50K), [], defaultdict(list)
    for d, t in left:
        if d is not None:
            expected.append((d, struct.pack(f"<{len(ids := [*whole.encode(t or '', add_special_tokens=False).ids, 0])}I", *ids)))
    for r in corpus_pipeline.run(spark, tables).orderBy("doc_id", "start").collect():
        if r.doc_id is not None:
            got[r.doc_id].append(bytes(r.ids))
    assert {d: b"".join(p) for d, p in got.items()} == dict(expected)


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.01"), reason="needs the given tables")
def test_held_out_accuracy(spark):
    root = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{root}/labels.parquet").collect()}
    held = [(r.score, labels[r.doc_id]) for r in query(spark, root, "op4_quality") if r.held_out and r.doc_id in labels]
    ones, zeros = ([s for s, y in held if y == k] for k in (1, 0))
    assert np.mean([(a > b) + 0.5 * (a == b) for a in ones for b in zeros]) > 0.95
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{root}/documents.parquet").collect()}
    told = [(r.lang_pred, langs[r.doc_id]) for r in query(spark, root, "op6_language_id") if r.held_out and langs[r.doc_id]]
    assert sum(a == b for a, b in told) / len(told) > 0.95


def test_calibration_is_monotone():
    rng = np.random.default_rng(1)
    counts = rng.integers(1, 1000, 60)
    edges, levels = quality.isotonic(np.arange(60.0), rng.binomial(counts, np.linspace(0, 1, 60)), counts)
    assert (np.diff(levels) > 0).all() and (np.diff(edges) > 0).all() and levels.min() >= 0 and levels.max() <= 1
    assert list(quality.isotonic(np.array([0.0, 1.0]), np.array([900.0, 1.0]), np.array([1000.0, 1.0]))[1]) == [0.9, 1.0]


def test_words_that_collide_for_powers_of_one_base(spark):
    """A Thue-Morse word and its complement have the same polynomial hash modulo 2^64 for every odd base."""
    a = "a"
    for _ in range(10):
        a += a.translate(str.maketrans("ab", "ba"))
    b = a.translate(str.maketrans("ab", "ba"))
    rng = random.Random(5)
    fill = words(rng, 60)
    docs = [(1, " ".join([*fill[:30], a, *fill[30:]])), (2, " ".join([*fill[:30], b, *fill[30:]])), (3, a), (4, b), (5, f"{a} x y z w"), (6, f"{b} x y z w")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_removed, brute.sha(" ".join(r.text.split()))) for r in substrings.deduplicate(df).collect()}
    assert got == brute.substrings(docs) and got[2][1] == 0
    got = {r.doc_id: (r.n_shingles, r.component_id, r.doc_id == r.component_id) for r in neardup.near_duplicates(df, percent=85).collect()}
    assert got == brute.near(docs)


def test_hot_keys_are_split_and_change_nothing(spark, monkeypatch):
    """Joins that split every key over two rows give the same rows: copies, a shared passage, one source, one chunk."""
    monkeypatch.setattr(common, "HOT_ROWS", 2)
    docs = spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()
    plain = [(r[0], r[1]) for r in corpus()]
    got = {r.doc_id: (r.n_words, r.n_removed, brute.sha(" ".join(brute.WS.findall(r.text or "")))) for r in substrings.deduplicate(docs).collect()}
    assert got == brute.substrings(plain)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.doc_id == r.component_id) for r in neardup.near_duplicates(docs, percent=85).collect()}
    assert got == brute.near(plain)
    lists = media.chunks(docs).cache()
    back = media.rebuilt(media.store_chunks(docs, lists)).collect()
    assert {bytes(r.media) for r in back} == {brute.payload(t)[2] for _, t in plain}
    bench = spark.createDataFrame(items(), "item_id long, text string")
    hit = decontam.occurrences(docs, bench, broadcast_bytes=0).withColumn("hit", decontam.n_hit(F.col("spans"))).collect()
    assert {r.doc: r.hit for r in hit} == {d: v[1] for d, v in brute.contamination(plain, items()).items()}
    cleaned = linededup.drop_boilerplate(docs, F.col("source"), broadcast_bytes=0).collect()
    assert sorted((r.doc_id, r.text or "") for r in cleaned) == sorted((d, t or "") for d, t in brute.lines([(r[0], r[3], r[1]) for r in corpus()]))


def test_words_that_begin_no_window_stay_before_the_shuffle(spark):
    """Between all windows broadcast and none of their tokens there is the way that broadcasts the tokens: same rows, fewer words moved."""
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * 7 + j) % 400}" for j in range(60 + i))) for i in range(60)], "doc_id long, text string")
    bench = spark.createDataFrame([(f"b{i}", " ".join(f"w{(i * 31 + j) % 400}" for j in range(14))) for i in range(20)], "item_id string, text string")
    probes, _ = decontam.with_prefix(decontam.windows(bench), docs)
    tokens = probes.select("token").distinct()
    middle = tokens.count() * 80
    assert decontam._fits(tokens, middle) and not decontam._fits(probes, middle)
    spoken = docs.select(F.explode(decontam.words(F.col("text"))).alias("token"))
    kept = decontam.beginning(spoken, probes, middle)
    assert 0 < kept.count() < spoken.count() and decontam.beginning(spoken, probes, 0).count() == spoken.count()
    want = brute.contamination([tuple(r) for r in docs.collect()], [tuple(r) for r in bench.collect()])
    for limit in (decontam.BROADCAST_BYTES, middle, 0):
        found = decontam.occurrences(docs, bench, broadcast_bytes=limit)
        got = {r.doc: (r.n_words, r.hit, len(r["items"])) for r in found.withColumn("hit", decontam.n_hit(F.col("spans"))).collect()}
        assert got == {k: v[:3] for k, v in want.items()} and any(hit for _, hit, _ in got.values())


def test_one_anchor_fills_several_automata(spark, monkeypatch):
    monkeypatch.setattr(substrings, "SHARD_PHRASES", 2)
    monkeypatch.setattr(substrings, "TASK_BYTES", 2000)
    docs = spark.createDataFrame(corpus(), SCHEMA).repartition(3)
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substrings.deduplicate(docs).collect()}
    assert got == {d: v[:2] for d, v in brute.substrings([(r[0], r[1]) for r in corpus()]).items()}


def test_very_long_texts(spark, tmp_path):
    rng = random.Random(11)
    shared = words(rng, 20_000, 5000)
    docs = [(1, " ".join([*words(rng, 60_000, 5000), *shared])), (2, " ".join([*shared, *words(rng, 50_000, 5000)])), (3, "x" * 3_000_000), (4, "y " * 100_000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("source", F.lit("s")).withColumn("lang", F.lit("en"))
    got = {r.doc_id: (r.n_words, r.n_removed, brute.sha(" ".join(r.text.split()))) for r in substrings.deduplicate(df).collect()}
    assert got == brute.substrings(docs)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.doc_id == r.component_id) for r in neardup.near_duplicates(df, percent=85).collect()}
    assert got == brute.near(docs)
    assert {bytes(r.media) for r in media.rebuilt(media.store_chunks(df, media.chunks(df))).collect()} == {brute.payload(t)[2] for _, t in docs}
    item = spark.createDataFrame([(1, " ".join(shared[50:70]))], "item_id long, text string")
    assert {r.doc: len(r.spans) for r in decontam.occurrences(df, item).collect()} == {1: 11, 2: 11, 3: 0, 4: 0}
    assert {r.doc_id: r.doc_tokens for r in packing.pack(df).select("doc_id", "doc_tokens").distinct().collect()}.keys() == {1, 2, 3, 4}
    whole = langid.grams(docs[0][1])
    cut = langid.grams(docs[0][1], 1000)
    assert (whole[0] == cut[0]).all() and (whole[1] == cut[1]).all()
    assert tokencounts.counted(df).count() == 4 and quality.with_statistics(df).count() == 4
    long = spark.createDataFrame([(1, i, "assistant", t) for i, t in docs], "conv_id long, turn long, role string, text string")
    found = chat.format_chats(chat.chain(long)).select(F.length(chat.read_loss(F.col("formatted"), F.col("loss_spans")))).first()[0]
    assert found == sum(len(t) for _, t in docs)


def test_long_conversations_and_null_nodes(spark):
    talk = spark.createDataFrame([(7, i, "user" if i % 2 else "assistant", str(i)) for i in range(300)], "conv_id long, turn long, role string, text string")
    out = chat.format_chats(chat.chain(talk)).withColumn("turns", chat.read_turns(F.col("formatted"))).first()
    assert [t.text for t in out.turns] == [str(i) for i in range(300)]
    nodes = spark.createDataFrame([(None, 1, None, "user", "a", 0.0), (None, 2, 1, "assistant", "b", 0.0), (1, None, None, "user", "lost", 0.0), (1, 5, None, "user", "c", 0.0)], "tree long, node long, parent long, role string, text string, score double")
    got = {(r.tree, r.leaf): r.formatted for r in chat.format_chats(nodes, 3).collect()}
    assert set(got) == {(None, 2), (1, 5)} and "lost" not in "".join(got.values())


def test_clashing_names_pass_through(spark):
    names = ["site", "boilerplate", "gone", "hit", "n_words", "n_removed", "stats", "score", "part", "parts", "rep", "label", "h", "c0"]
    df = spark.createDataFrame([(i, f"w{i} " * 60, "s") for i in range(4)], "doc_id long, text string, source string").select("*", *(F.lit(n).alias(n) for n in names))
    bench = spark.createDataFrame([(1, "nothing like it")], "item_id long, text string")
    for out in (linededup.drop_boilerplate(df, F.col("source")), linededup.drop_boilerplate(df, F.col("source"), broadcast_bytes=0), neardup.deduplicate(df), decontam.clean(df, bench)):
        assert out.columns == df.columns and [r.asDict()[n] for r in out.collect() for n in names] == names * 4
    out = substrings.deduplicate(df)
    assert out.columns[-2:] == ["n_words_", "n_removed_"] and all(r.hit == "hit" and r.n_words == "n_words" and r.n_words_ == 60 for r in out.collect())
    out = quality.with_statistics(df)
    assert out.columns[-1] == "stats_" and {r.stats for r in out.collect()} == {"stats"}


def test_scratch_needs_a_shared_folder_on_a_cluster(spark, monkeypatch):
    class Cluster:
        class sparkContext:
            master = "spark://host:7077"

        class conf:
            get = staticmethod(lambda *_: None)

    with pytest.raises(ValueError):
        common.scratch(Cluster, "x")
