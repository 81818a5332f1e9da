"""The BPE operator against the tiktoken library."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from strandmill.llm import bpe


@pytest.fixture(scope="module")
def library():
    with open(bpe.RANKS_50K, "rb") as file:
        ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rng = random.Random(11)
    drawn = lambda letters, most, n: ["".join(rng.choices(letters, k=rng.randrange(1, most))) for _ in range(n)]
    odd = ["", None, " ", "\n\n  x \t", "<|endoftext|> hi", "a'll b's", "😀 ü 漢字", "a", "a", "0" * 1500, "ab" * 600, "\x00\x7f"]
    return [*odd, *drawn("aeioutrns  ", 300, 60), *drawn("ab", 900, 40), *drawn("éñ😀ü漢字", 300, 20), *drawn([chr(c) for c in range(32, 0x3000)], 200, 40), "".join(rng.choices("abcdefgh", k=3000)), "word " * 20_000]


def ids(text, library):
    return library.encode_ordinary(text) if text else []


def test_query_matches_the_library(spark, tmp_path, library):
    spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    found = {r.doc_id: r for r in bpe.op11_bpe(spark, str(tmp_path)).collect()}
    assert len(found) == len(texts())
    for i, text in enumerate(texts()):
        expected = ids(text, library)
        assert found[i].n_tokens == len(expected)
        assert found[i].ids_sha256 == hashlib.sha256(" ".join(map(str, expected)).encode()).hexdigest()
        assert found[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_long_parts_give_the_same_by_both_ways(library):
    rng, own = random.Random(5), bpe.vocabulary()
    for letters in ("ab", "abcdefghijklmnop", "éü漢"):
        part = "".join(rng.choices(letters, k=700)).encode()
        rows = own.single[np.frombuffer(part, np.uint8)][None, :]
        assert own.merged(rows)[0].tolist() == own.merged_long(part).tolist() == library.encode_ordinary(part.decode())


def test_other_columns_and_clashing_names(spark):
    rows = spark.createDataFrame([(1, "x", "hello world", [2], {"a b": 1}), (None, None, None, None, None)], "ids long, decoded string, text string, keys array<int>, odd map<string,int>")
    rows = rows.withColumn("struct", F.struct(F.lit(1).alias("a b")))
    made = bpe.encode(rows)
    assert made.columns == ["ids", "decoded", "keys", "odd", "struct", "ids_"]
    back = bpe.decode(made, "ids_")
    assert [bytes(r.decoded_) for r in back.orderBy(F.col("ids").desc_nulls_last()).collect()] == [b"hello world", b""]
    assert bpe.encode(rows.limit(0)).collect() == [] and bpe.decode(made.limit(0), "ids_").collect() == []


def test_unknown_ids_fail(spark):
    with pytest.raises(Exception, match="not in the vocabulary"):
        bpe.decode(spark.createDataFrame([([50256],)], "ids array<int>")).collect()
    assert bytes(bpe.decode(spark.createDataFrame([(None,), (None,)], "ids array<int>")).first().decoded) == b""
