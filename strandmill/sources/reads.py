"""Reads from text files, and results and run records to files."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandmill.functions.sequence import encoded, normalised

#: Fixed values. A line that states what was planted, with or without ``>``.
HEADER = r"Motif\s+([ACGTacgt]+)\s+planted"
PLANTED = r"Motif\s+([ACGTacgt]+)\s+planted\s+as\s+([ACGTacgt]*)\s+at\s+position\s+(\d+)"

SMALL_SPLITS = 10_000  # of about 200 bytes each


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, raw) of every line, numbered from 0 in each file.

    Files are read in splits. Within a split lines come in order, so a line's number is its place in the split and the
    number of lines in the splits before it; only these numbers, one for each split, are brought together.
    """
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("raw"), F.monotonically_increasing_id().alias("place"))
    blocks = rows.groupBy("file", "block").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.select("file", "block", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"))
    blocks = stored(blocks, "splits")
    if blocks.count() <= SMALL_SPLITS:  # the numbers go to the lines, which then stay where they are
        blocks = F.broadcast(blocks)
    return rows.join(blocks, ["file", "block"]).select("file", (F.col("place") + F.col("shift")).alias("line_no"), "raw")


def reads(rows: DataFrame, header_mode: str = "strict") -> DataFrame:
    """(file, sid, seq): each line is one read. ``reference`` keeps header lines without ``>`` as reads."""
    seq = normalised(F.col("raw"))
    kept = rows.where((seq != "") & ~seq.startswith(">"))
    if header_mode == "strict":
        kept = kept.where(~F.col("raw").rlike(HEADER))
    elif header_mode != "reference":
        raise ValueError(f"unknown header mode {header_mode!r}")
    return kept.select("file", F.col("line_no").alias("sid"), encoded(seq).alias("seq"))


def headers(rows: DataFrame) -> DataFrame:
    """(file, line_no, motif, edited, pos) of the lines that state what was planted."""
    part = lambda i: F.regexp_extract("raw", PLANTED, i)
    return rows.where(F.col("raw").rlike(PLANTED)).select("file", "line_no", F.upper(part(1)).alias("motif"), F.upper(part(2)).alias("edited"), part(3).cast("long").alias("pos"))


def consensus(rows: DataFrame) -> DataFrame:
    """(file, consensus): the motif that a file's first line states, or ''."""
    return rows.where("line_no = 0").select("file", F.upper(F.regexp_extract("raw", HEADER, 1)).alias("consensus"))


def result_path(path: str, name: str, l: int, d: int) -> str:  # noqa: E741
    folder, _, file = path.rpartition("/")
    return f"{folder or '.'}/output/out_{file.rsplit('.', 1)[0] if '.' in file else file}_{name}_l{l}_d{d}.txt"


def result_lines(motifs: DataFrame) -> DataFrame:
    """Lines ``MOTIF<TAB>Distance: N|N/A`` sorted by motif."""
    line = F.concat("motif", F.lit("\tDistance: "), F.coalesce(F.col("distance").cast("string"), F.lit("N/A")))
    return motifs.orderBy("motif").select(line.alias("value"))


def write_motifs(motifs: DataFrame, path: str) -> None:
    """``result_lines`` as one text file, which replaces what the path held, whole or not at all."""
    write_file(result_lines(motifs), path)


def write_file(lines: DataFrame, path: str) -> None:
    """Lines (value) as one file. Tasks write sorted parts side by side; their bytes are then joined by the file system's streams
    under a hidden name, and a rename puts the file in its place. A broken run leaves the file that was there."""
    spark, (folder, _, name) = lines.sparkSession, path.rpartition("/")
    hadoop, conf = spark._jvm.org.apache.hadoop, spark._jsparkSession.sessionState().newHadoopConf()
    fresh = f"{folder or '.'}/.{name}-{uuid.uuid4().hex}"
    parts, joined, target = (hadoop.fs.Path(p) for p in (f"{fresh}-parts", fresh, path))
    fs = target.getFileSystem(conf)
    try:
        lines.write.text(f"{fresh}-parts")
        out = fs.create(joined, True)
        try:
            for name in sorted(s.getPath().getName() for s in fs.listStatus(parts)):
                if name.startswith("part-"):
                    part = fs.open(hadoop.fs.Path(parts, name))
                    hadoop.io.IOUtils.copyBytes(part, out, 1 << 16, False)
                    part.close()
        finally:
            out.close()
        how = spark.sparkContext._gateway.new_array(hadoop.fs.Options.Rename, 1)
        how[0] = hadoop.fs.Options.Rename.OVERWRITE
        hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(fs.makeQualified(joined), fs.makeQualified(target), how)
    finally:
        fs.delete(parts, True)
        fs.delete(joined, False)


def is_folder(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return fs.exists(where) and fs.getFileStatus(where).isDirectory()


def read_small_file(spark: SparkSession, path: str) -> str:
    """The text of a file of a few lines; empty where there is none."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return "\n".join(r.value for r in spark.read.text(path).collect()) if fs.exists(where) else ""


def max_rss_kb() -> int:
    """The most memory the driver's Python process has held; 0 where the system does not tell."""
    try:
        import resource
    except ImportError:
        return 0
    return resource.getrusage(resource.RUSAGE_SELF).ru_maxrss


#: Settings under which Spark watches the memory of executors and their Python workers, every half second and at each heartbeat.
WATCHED = {"spark.executor.processTreeMetrics.enabled": "true", "spark.executor.metrics.pollingInterval": "500ms", "spark.executor.heartbeatInterval": "2s"}
_PEAKS = {"jvm_heap_kb": "JVMHeapMemory", "jvm_rss_kb": "ProcessTreeJVMRSSMemory", "python_rss_kb": "ProcessTreePythonRSSMemory"}


def executor_peaks(spark: SparkSession) -> list[tuple]:
    """(executor, jvm_heap_kb, jvm_rss_kb, python_rss_kb): the most memory that each executor's JVM and its Python workers have held
    so far, as Spark's own metrics tell; executors it has not heard from yet are left out, and what it does not watch (see ``WATCHED``) is 0."""
    known, out = spark.sparkContext._jsc.sc().statusStore().executorList(False), []
    for i in range(known.size()):
        executor = known.apply(i)
        if (peaks := executor.peakMemoryMetrics()).isDefined():
            out.append((executor.id(), *(peaks.get().getMetricValue(name) // 1024 for name in _PEAKS.values())))
    return out


def append_run(spark: SparkSession, path: str, variant: str, l: int, d: int, seconds: float, n_motifs: int) -> None:  # noqa: E741
    row = [(variant, l, d, spark.sparkContext.defaultParallelism, seconds, max_rss_kb(), n_motifs, executor_peaks(spark))]
    executors = ", ".join(f"{c}: long" for c in _PEAKS)
    schema = f"variant string, l int, d int, workers int, seconds double, max_rss_kb long, n_motifs long, executors array<struct<executor: string, {executors}>>"
    spark.createDataFrame(row, schema).coalesce(1).write.mode("append").json(path)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder of ``spark.checkpoint.dir``; where it is unset, of this machine if Spark runs on it alone."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{(root or tempfile.gettempdir()).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, and outlives a lost executor."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
