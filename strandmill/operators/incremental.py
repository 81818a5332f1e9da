"""Supports that grow with new reads: a table in buckets of words, of which a batch replaces only those it touches.

The table is a folder. Each batch writes the buckets it touches under its own number; a manifest of one line tells which
batch holds each bucket now, how many reads there are, and the last batch. It is put in place by a rename, so a batch
counts whole or not at all, and a batch that comes again is ignored. Batches are numbered 1, 2, 3, ... by one writer; a
number that is not the next one is refused. The manifest has at most 4^PREFIX entries, however many batches there were.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.operators import walk
from strandmill.sources.reads import read_small_file, stored, write_file

PREFIX = 3  # bases that name a bucket


class SupportTable:
    """Supports of words of length l within d edits, over all batches of reads so far."""

    def __init__(self, spark: SparkSession, path: str, l: int, d: int):  # noqa: E741
        self.spark, self.path, self.l, self.d = spark, path.rstrip("/"), l, d
        if self.manifest()["of"] != [l, d]:
            raise ValueError(f"{path} holds supports of {self.manifest()['of']}, not of {[l, d]}")

    def manifest(self) -> dict:
        said = read_small_file(self.spark, f"{self.path}/manifest")
        return json.loads(said) if said else {"of": [self.l, self.d], "batch": 0, "reads": 0, "buckets": {}}

    def _buckets(self, held: dict, wanted: list[str]) -> DataFrame:
        """(w, n_reads, bucket) of some buckets."""
        empty = self.spark.createDataFrame([], "w string, n_reads long, bucket string")
        batches: dict[int, list[str]] = {}
        for bucket in wanted:
            if bucket in held["buckets"]:
                batches.setdefault(held["buckets"][bucket], []).append(bucket)
        for batch, buckets in batches.items():
            part = self.spark.read.schema(empty.schema).parquet(f"{self.path}/batch={batch}").where(F.col("bucket").isin(buckets))
            empty = empty.unionByName(part.select("w", "n_reads", "bucket"))
        return empty

    def add(self, batch: int, reads: DataFrame) -> bool:
        """Add a batch of reads (seq); false where it has been added before."""
        held = self.manifest()
        if batch <= held["batch"]:
            return False
        if batch != held["batch"] + 1:
            raise ValueError(f"batch {batch} does not follow {held['batch']}")
        # A hidden folder: what a broken run left behind is written over, and is in no manifest.
        bucket = F.rpad(F.substring("w", 1, PREFIX), PREFIX, F.lit("-")).alias("bucket")
        new = stored(walk.supports(reads, self.l, self.d).select("w", "n_reads", bucket), "batch")
        touched = sorted(r.bucket for r in new.select("bucket").distinct().collect())  # 4^PREFIX at most
        both = self._buckets(held, touched).unionByName(new).groupBy("bucket", "w").agg(F.sum("n_reads").alias("n_reads"))
        if touched:
            both.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/batch={batch}")
        held |= {"batch": batch, "reads": held["reads"] + reads.count(), "buckets": held["buckets"] | dict.fromkeys(touched, batch)}
        write_file(self.spark.createDataFrame([(json.dumps(held),)], "value string"), f"{self.path}/manifest")
        return True

    def supports(self) -> DataFrame:
        """(w, n_reads) over all batches."""
        held = self.manifest()
        return self._buckets(held, sorted(held["buckets"])).select("w", "n_reads")
