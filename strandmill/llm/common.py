"""What several operators share: tables, folds, the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SETTING = "spark.checkpoint.dir"
HOT_ROWS, HOT_KEYS, HOT_PARTS = 1000, 4096, 10_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key: Column, folds: int) -> Column:
    """crc32 of the key as text, modulo the number of folds: the same split in every run and engine."""
    return F.crc32(key.cast("string").cast("binary")) % folds


def values(column: pa.Array, step: int = 256) -> Iterator:
    """Python values of a column of a batch; only ``step`` of them are made at once, as texts may be long."""
    for at in range(0, len(column), step):
        yield from column.slice(at, step).to_pylist()


def slices(batches: Iterator[pa.RecordBatch], step: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches cut to at most ``step`` rows, for tasks that turn their columns into Python values."""
    for b in batches:
        for at in range(0, len(b), step):
            yield b.slice(at, step)


def fresh(taken: list[str], name: str) -> str:
    """``name``, made longer until no column is called so (Spark compares names without case)."""
    held = {c.lower() for c in taken}
    while name.lower() in held:
        name += "_"
    return name


def spread_join(left: DataFrame, right: DataFrame, key: str, sizes: DataFrame, how: str = "inner") -> DataFrame:
    """``left`` joined with ``right`` by ``key``, of which one value may hold any share of left's rows.

    ``sizes`` (key, n) counts left's rows by key; keys it leaves out are not split. The rows of keys over ``HOT_ROWS`` are dealt into parts
    by their own hash, and right's rows of those keys are repeated for each part. Only the ``HOT_KEYS`` largest keys are
    split, so what is collected and broadcast is bounded, and any other key has less than 1 / ``HOT_KEYS`` of all rows.
    """
    n = F.least(F.ceil(F.col("n") / HOT_ROWS), F.lit(HOT_PARTS)).cast("int")
    hot = sizes.where(F.col("n") > HOT_ROWS).select(F.col(key), n.alias("parts")).orderBy(F.desc("parts"), key).limit(HOT_KEYS)
    found = hot.collect()
    if not found:
        return left.join(right, key, how)
    parts, part = fresh(left.columns + right.columns, "parts"), fresh(left.columns + right.columns, "part")
    hot = F.broadcast(left.sparkSession.createDataFrame(found, hot.schema).withColumnRenamed("parts", parts))
    hashed = (f"`{c}`" for c, t in left.dtypes if "map<" not in t and "variant" not in t)
    own = F.coalesce(F.pmod(F.xxhash64(*hashed), F.col(parts)), F.lit(0)).cast("int")
    dealt_left = left.join(hot, key, "left").withColumn(part, own).drop(parts)
    each = F.explode(F.sequence(F.lit(0), F.coalesce(F.col(parts), F.lit(1)) - 1))
    dealt_right = right.join(hot, key, "left").withColumn(part, each).drop(parts)
    return dealt_left.join(dealt_right, [key, part], how).drop(part)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share.

    The folder is the one the cluster names in ``spark.checkpoint.dir``. Where that is unset, a folder of this machine
    is set once for the session if Spark runs on this machine alone; on a cluster it is an error.
    """
    root = spark.conf.get(SETTING, None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {SETTING} to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="strandmill-")
        spark.conf.set(SETTING, root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: cuts lineage, survives lost executors.

    With ``by`` there is a folder for each value of these columns, which must come last.
    """
    path = scratch(df.sparkSession, name)
    df.write.partitionBy(*by).option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, name: str, keys: tuple[str, ...]) -> DataFrame:
    """Like ``stored``, in buckets by ``keys``: the rows are shuffled once, and later joins on those keys leave them where they are.

    A bucketed table is written through an entry in the session's catalog, which is dropped once the table is resolved;
    its files are in the shared folder as the others are.
    """
    spark, n = df.sparkSession, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    path = scratch(spark, name)
    entry = f"strandmill_{name}_{path.rpartition('-')[2]}"
    df.repartition(n, *keys).write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(n, *keys).saveAsTable(entry)
    found = spark.table(entry)
    spark.sql(f"DROP TABLE {entry}")
    return found
