"""The corpus pipeline: five operators in a row over ``documents``.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; it is written as Parquet and read again as the next
one's docs. All but the last keep the columns of documents.

Defined cases: every stage takes null ids, texts, languages and sources, empty texts and empty tables, and keeps
other columns; what a row then becomes is stated in the docstring of the operator that the stage calls. Rows whose
quality cannot be told (no label to learn from) get the share of label 1 as their score.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.llm import common, decontam, linededup, neardup, packing, quality


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under the threshold go."""
    columns = docs.columns
    clash = {c: f"__kept_{i}" for i, c in enumerate(columns)}
    own = docs.select(*(F.col(f"`{c}`").alias(k) for c, k in clash.items()))
    # The table holds texts and statistics, so texts are read by Python once and the fit reads ids and statistics only.
    stats = common.stored(quality.with_statistics(own, clash["text"], keep_text=True), "stats")
    model = quality.learn(stats.select(F.col(clash["doc_id"]).alias("doc_id"), "stats"), common.table(spark, sf_dir, "labels"))
    scored = quality.score(stats, model)
    return scored.where(F.col("score") >= quality.THRESHOLD).select(*(F.col(k).alias(c) for c, k in clash.items()))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on many pages of their source are taken out; the documents stay."""
    return linededup.drop_boilerplate(docs, F.col("source"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return neardup.deduplicate(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go."""
    return decontam.clean(docs, common.table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of what is left, packed into windows."""
    return packing.pack(docs)


STAGES = [("quality", quality_classifier), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontaminate), ("packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.stored(stage(spark, docs, sf_dir), name)
    return docs
