"""The alignment of two tokenizers against a plain version."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
import sentencepiece
from tokenizers import Tokenizer

from strandmill.llm import alignment, tokens

COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def letters_of_bytes():
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in keep]
    return {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(rest)}


def plain(texts):
    """Expected rows, and the count of each linked pair."""
    first, second, letters = Tokenizer.from_file(tokens.BYTE_BPE_50K), sentencepiece.SentencePieceProcessor(model_file=alignment.PIECES_32K), letters_of_bytes()
    first.encode_special_tokens = True
    piece = lambda i: bytes([int(second.id_to_piece(i)[3:5], 16)]) if second.is_byte(i) else second.id_to_piece(i).replace("▁", " ").encode()

    def ends(strings):
        return [sum(map(len, strings[: i + 1])) for i in range(len(strings))]

    rows = []
    for text in texts:
        a = first.encode(f" {text}", add_special_tokens=False).ids if text else []
        b = second.encode(text) if text else []
        said = [[bytes(letters[c] for c in first.id_to_token(i)) for i in a], [piece(i) for i in b]]
        if not text or any(b"".join(s) != f" {text}".encode() for s in said):
            rows.append(None)
            continue
        at_a, at_b = ({e: i for i, e in enumerate(ends(s))} for s in said)
        common = sorted(at_a.keys() & at_b.keys())
        groups, i, j = [], 0, 0
        for e in common:
            groups.append(",".join(map(str, a[i : at_a[e] + 1])) + "|" + ",".join(map(str, b[j : at_b[e] + 1])))
            i, j = at_a[e] + 1, at_b[e] + 1
        rows.append((len(a), len(b), groups, [(a[at_a[e]], b[at_b[e]]) for e in common]))
    count, most = Counter(link for r in rows if r for link in r[3]), defaultdict(int)
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    said = lambda r: (r[0], r[1], len(r[2]), len(r[3]), sum(count[x] == most[x[1]] for x in r[3]), sum(count[x] for x in r[3]), hashlib.sha256(";".join(r[2]).encode()).hexdigest())
    return [said(r) if r else (0, 0, 0, 0, 0, 0, "") for r in rows], count, [r[3] if r else [] for r in rows]


def texts():
    rng = random.Random(12)
    odd = ["", None, " ", "  ", " a", "a ", "a ", "a  b  ", " \n x\t ", "a▁b c", "</s><s> <|endoftext|> x", "ﬁne ½", "é́ é", "a\x00b", " 　x", "😀 ü漢字", "x" * 2000]
    drawn = ["".join(rng.choices("ab .,\n", k=rng.randrange(1, 40))) for _ in range(60)]
    wide = ["".join(chr(rng.randrange(32, 0x3000)) for _ in range(50)) for _ in range(20)]
    return [*odd, *drawn, *wide, *["the same words of many"] * 2300, "many words " * 3000]


@pytest.fixture(scope="module")
def expected():
    return plain(texts())


@pytest.fixture(scope="module")
def documents(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("aligned"))
    spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string").coalesce(1).write.parquet(f"{root}/documents.parquet")
    return root


def test_query_matches_the_plain_version(spark, documents, expected):
    found = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in alignment.op12_alignment(spark, documents).collect()}
    assert found == dict(enumerate(expected[0]))


def test_postings_tell_documents_and_links(spark, documents, expected):
    _, count, links = expected
    postings = alignment.index(spark.read.parquet(f"{documents}/documents.parquet")).postings.cache()
    docs = Counter(x for own in links for x in set(own))
    found = {(r.pair >> 16, r.pair & 0xFFFF): (r.n_docs, r.n_links) for r in alignment.pair_counts(postings).collect()}
    assert found == {x: (docs[x], n) for x, n in count.items()}
    assert not postings.where(f"octet_length(bitmap) = {alignment.BLOCK // 8}").isEmpty()  # both kinds of bitmap
    by_id = Counter(b for own in links for b in {b for _, b in own})
    assert {r.second: r.n_docs for r in alignment.id_documents(postings).collect()} == by_id


def test_other_blocks_give_the_same(spark, documents, expected):
    rows = spark.read.parquet(f"{documents}/documents.parquet").repartition(7)
    found = alignment.index(rows, digest=False)
    scored = found.docs.join(alignment.scores(found.postings, alignment.pair_counts(found.postings)), "place", "left")
    got = {r.key: (r.n_a, r.n_b, r.n_links, r.n_links, r.n_best or 0, r.count_sum or 0, hashlib.sha256(bytes(r.groups)).hexdigest() if r.n_a else "") for r in scored.collect()}
    assert got == dict(enumerate(expected[0]))


def test_odd_tables(spark):
    rows = spark.createDataFrame([(None, "a b", "x"), (None, "a b", "y"), (1, None, None)], "key long, text string, pair string")
    found = alignment.index(rows, "key")
    assert sorted((r.key is None, r.n_links) for r in found.docs.collect()) == [(False, 0), (True, 2), (True, 2)]
    assert [(r.n_docs, r.n_links) for r in alignment.pair_counts(found.postings).collect()] == [(2, 2)] * 2
    empty = alignment.index(rows.limit(0), "key")
    assert empty.docs.collect() == [] and alignment.scores(empty.postings, alignment.pair_counts(empty.postings)).collect() == []
