"""Ids of texts that hold the tokenizer's added tokens, against the tokenizer as it is."""

import random

import public_tokenizers
import regex
from tokenizers import Tokenizer

from strandmill.llm import packing, tokencounts, tokens

END = "<|endoftext|>"
TEXTS = [None, "", "plain  text\n", END, END * 3, f"a{END}b", f"a  {END}  b", f" \n{END}\n ", f"it{END}'s 12{END}3", "<|endoftext|", f"<{END}>", "<|ENDOFTEXT|>", f"é{END}日本 " * 400]


def expected():
    whole = Tokenizer.from_file(tokens.BYTE_BPE_50K)
    return [whole.encode(t or "", add_special_tokens=False).ids for t in TEXTS]


def test_encoder_gives_added_tokens_their_id():
    encode = tokens.encoder(added_tokens=True)
    for text, ids in zip(TEXTS, expected()):
        assert encode(text) == b"".join(i.to_bytes(4, "little") for i in ids), text
    assert encode(f"a{END}b") == b"".join(i.to_bytes(4, "little") for i in (64, 50256, 65))


def test_parts_are_those_of_the_pattern():
    """Both engines on every code point, in order and at random, with white space of every kind between."""
    whole, mine, rng = regex.compile(public_tokenizers.PATTERN).findall, tokens.splitter(), random.Random(1)
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    low = points[:0xF800]
    for text in ("".join(points), "".join(low), "".join(low[::-1]), "".join(f"{c} " for c in low)):
        assert mine(text) == whole(text)
    for _ in range(1000):
        text = "".join(rng.choice((rng.choice(low), rng.choice("a '\n\t1.s\x1c\x85\u3000"))) for _ in range(rng.randint(0, 60)))
        assert mine(text) == whole(text)


def test_packing_and_counts_use_the_whole_encoding(spark):
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(TEXTS)], "doc_id long, text string, lang string, source string")
    pieces = packing.pack(docs).collect()
    counts = {r.doc_id: r.bpe_tokens for r in tokencounts.counted(docs).collect()}
    for i, ids in enumerate(expected()):
        mine = sorted((p for p in pieces if p.doc_id == i), key=lambda p: p.start)
        assert b"".join(p.ids for p in mine) == b"".join(x.to_bytes(4, "little") for x in [*ids, packing.END_ID])
        assert {p.doc_tokens for p in mine} == {len(ids) + 1} and counts[i] == len(ids)
