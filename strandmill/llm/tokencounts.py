"""Token counts as delta-maintained rollups.

A ledger keeps additive totals by source, language and tokenizer version. Changes come in batches of signed
rows: an insert is +1 document and +n tokens, a delete -1 and -n, a revised count is a delete and an insert.
A batch is added up by its keys and written under a fresh name; one more file of the manifest, which appears whole or
not at all, then makes it count. Nothing is overwritten: a commit that breaks off before that leaves the totals as
they were, and can be repeated. An id counts once: a commit of an id that has been committed changes nothing, whatever
it holds, before and after a compaction; a correction is a batch of its own, of signed rows. Totals are the sum over
the batches that count and never look at a document again.

Entries are numbered in order, without a clock. A compaction adds up all batches so far into one file and takes the
number of the last of them: what counts is the last compaction and the entries after it, ``OPEN`` at most, as a commit
compacts by itself when there are so many. Only those are collected; an id is looked up by a filter.

One writer at a time commits to a ledger; readers need no lock.

Defined cases: null source or language are keys of their own; a null text has no tokens; repeated rows count
each; an empty batch commits and changes nothing; keys whose documents and tokens are both 0 are left out;
a text of any length is counted whole, and a task holds 256 texts at once; other columns are ignored, whatever their
names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from strandmill.llm import common
from strandmill.llm.tokens import BYTE_BPE_50K, encoder

KEYS = ("source", "lang", "tokenizer_version")
_ENTRY = "seq long, batch_id string, name string, compacts boolean"
OPEN = 64  # batches that count beside the last compaction
_DELTA = "source string, lang string, tokenizer_version string, n_docs long, n_tokens long"


def counted(docs: DataFrame, text_col: str = "text", tokenizer: str = BYTE_BPE_50K) -> DataFrame:
    """doc_id, source, lang, text_key (128 bits of the text), bpe_tokens, utf8_bytes of each row."""
    own = docs.select(F.col("doc_id"), F.col("source"), F.col("lang"), F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("text_key"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("utf8_bytes"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, added_tokens=True)
        for b in batches:
            n = [len(encode(t)) // 4 for t in common.values(b.column(5))]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(n, pa.int64())], names=["doc_id", "source", "lang", "text_key", "utf8_bytes", "bpe_tokens"])

    return own.mapInArrow(run, "doc_id long, source string, lang string, text_key string, utf8_bytes long, bpe_tokens long")


def signed(rows: DataFrame, sign: int, version: str, tokens: Column) -> DataFrame:
    """Rows of documents as rows of a batch."""
    return rows.select("source", "lang", F.lit(version).alias("tokenizer_version"), F.lit(sign).cast("long").alias("n_docs"), (sign * tokens).cast("long").alias("n_tokens"))


class TokenLedger:
    """Totals under one folder; ``root`` must be shared by driver and executors."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        spark.createDataFrame([], _ENTRY).write.mode("append").json(f"{self.root}/manifest")

    def _manifest(self) -> DataFrame:
        return self.spark.read.schema(_ENTRY).json(f"{self.root}/manifest")

    def _entries(self) -> list[Row]:
        """The entries that count: the last compaction and the batches after it, in order."""
        last = self._manifest().where("compacts").agg(F.max("seq")).first()[0]
        done = 0 if last is None else last
        rows = self._manifest().where((F.col("seq") > done) | (F.col("compacts") & (F.col("seq") == done))).collect()
        # A compaction that was repeated after a lost driver stands there twice, with the same sums.
        return sorted({(r.seq, r.compacts): r for r in sorted(rows, key=lambda r: r.name)}.values(), key=lambda r: r.seq)

    def _write(self, seq: int, batch_id: str | None, rows: DataFrame) -> None:
        sums = rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        name = uuid.uuid4().hex
        sums.write.parquet(f"{self.root}/data/{name}")
        self._publish(seq, batch_id, name)

    def _publish(self, seq: int, batch_id: str | None, name: str) -> None:
        entry = self.spark.createDataFrame([(seq, batch_id, name, batch_id is None)], _ENTRY)
        entry.coalesce(1).write.mode("append").json(f"{self.root}/manifest")

    def commit(self, batch_id: str, *changes: DataFrame) -> bool:
        """Add up the signed rows by key and let them count as the batch; false where the id has been committed before."""
        if not self._manifest().where(F.col("batch_id") == batch_id).isEmpty():
            return False
        rows = changes[0]
        for more in changes[1:]:
            rows = rows.unionByName(more)
        entries = self._entries()
        if len(entries) > OPEN:
            self.compact()
        self._write(entries[-1].seq + 1 if entries else 1, batch_id, rows)
        return True

    def compact(self) -> None:
        """One file in place of all that count now."""
        entries = self._entries()
        if len(entries) > 1:
            self._write(entries[-1].seq, None, self._rows(entries))

    def _rows(self, entries: list[Row]) -> DataFrame:
        read = self.spark.read.schema(_DELTA)
        return read.parquet(*(f"{self.root}/data/{r.name}" for r in entries)) if entries else self.spark.createDataFrame([], _DELTA)

    def totals(self) -> DataFrame:
        sums = self._rows(self._entries()).groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return sums.where("n_docs <> 0 OR n_tokens <> 0")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Load all documents, delete exact copies, revise counts by an end token, and commit a batch twice."""
    rows = common.stored(counted(common.table(spark, sf_dir, "documents")), "counted")
    ledger = TokenLedger(spark, common.scratch(spark, "ledger"))
    versions = {"byte_bpe_50k": F.col("bpe_tokens"), "utf8_bytes": F.col("utf8_bytes")}
    loaded = [signed(rows, 1, v, n) for v, n in versions.items()]
    # Copies are all rows less the first of each text; as signed rows that needs no join.
    first = rows.groupBy("text_key").agg(F.min(F.struct("doc_id", "source", "lang", "bpe_tokens", "utf8_bytes")).alias("f")).select("f.*")
    first = common.stored(first, "first")
    copies = [d for v, n in versions.items() for d in (signed(rows, -1, v, n), signed(first, 1, v, n))]
    revised = [d for v, n in versions.items() for d in (signed(first, -1, v, n), signed(first, 1, v, n + 1))]
    ledger.commit("load", *loaded)
    ledger.commit("copies", *copies)
    ledger.commit("end-token", *revised)
    ledger.commit("copies", *copies)
    return ledger.totals()
