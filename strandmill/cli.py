"""Command line: ``python -m strandmill.cli -s 1 -l 8 -d 1 FILE``, or the same under spark-submit on any cluster.

Given a folder, every file in it is searched on its own, all in one plan, with the l and d that its name states.

Exit code 0; 255 with a message on the error stream for usage, bad parameters, a file that is not there and any other
failure; argparse's own 2 for an unknown ``-s`` or a value that is no number. As in the contract of ``2p``, its motifs have up to 32
bases and ``-t 0`` is a failure.
"""

from __future__ import annotations

import argparse
import sys
import time

from pyspark import SparkConf
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.functions.sequence import distance_to
from strandmill.operators import collapsed, walk
from strandmill.plans.motif import MotifQuery, search_files
from strandmill.sources import reads as R

NAMES = {"1": "ems1", "2": "ems2", "2m": "ems2m", "2p": "ems2p"}
MOST_COLLAPSED = 32  # bases of a motif of 2p


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser("strandmill", add_help=False, description="Motifs within an edit distance in all reads of a file.")
    parser.add_argument("-s", choices=tuple(NAMES), default="2", help="1, 2, 2m: exact; 2p: the collapsed variant")
    parser.add_argument("-l", type=int, default=1)
    parser.add_argument("-d", type=int, default=1)
    parser.add_argument("-t", type=int, help="tasks that a step is cut into; cores, where no master is set")
    parser.add_argument("-q", type=float, default=1, help="share of the reads that a motif must be near; not for 2p")
    parser.add_argument("-w", help="file of words, one a line: tell which of them are motifs instead of listing all")
    parser.add_argument("--header-mode", choices=("strict", "reference"), default="reference")
    parser.add_argument("-h", "--help", action="store_true")
    parser.add_argument("file", nargs="?", help="a file of reads, or a folder of such files")
    return parser


def session(tasks: int | None) -> SparkSession:
    """The session of the launcher's master; of this machine where none is named."""
    builder = SparkSession.builder.appName("strandmill")
    if SparkSession.getActiveSession() is None and SparkConf().get("spark.master", None) is None:
        builder = builder.master(f"local[{tasks or '*'}]")
    if tasks:
        builder = builder.config("spark.sql.shuffle.partitions", tasks)
    if SparkSession.getActiveSession() is None:
        builder = builder.config(map={k: v for k, v in R.WATCHED.items() if SparkConf().get(k, None) is None})
    spark = builder.getOrCreate()
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(R.shared_folder(spark, "rounds"))
    return spark


def search(spark: SparkSession, file: str, s: str, l: int, d: int, header_mode: str = "reference", quorum: float = 1, words: str | None = None) -> str:  # noqa: E741
    """Read, search, write the motifs and the run record; gives the path of the motifs."""
    start = time.time()
    lines = R.lines(spark, file).cache()
    consensus = (R.consensus(lines).first() or {"consensus": ""})["consensus"]
    reads = R.reads(lines, header_mode)
    if s == "2p":
        motifs = collapsed.folded(reads, l, d).select(F.col("w").alias("motif"), distance_to(F.col("w"), F.lit(consensus)).alias("distance"))
    elif words:
        given = spark.read.text(words).select(F.upper(F.trim("value")).alias("w"))
        motifs = MotifQuery(l, d, quorum).verify(given, reads, consensus)
    else:
        if not walk.fits(l, d):
            print(f"Note: words of {l} bases are listed by rows, which may take very long; -w tells about given words.", file=sys.stderr)
        motifs = MotifQuery(l, d, quorum).run(reads, consensus)
    motifs = R.stored(motifs.select("motif", "distance"), "motifs")
    n = motifs.count()
    if s == "2p" and n and l > MOST_COLLAPSED:
        raise ValueError(f"2p has motifs of up to {MOST_COLLAPSED} bases, not {l}")
    out = R.result_path(file, NAMES[s], l, d)
    R.write_motifs(motifs, out)
    took = time.time() - start
    R.append_run(spark, out.rpartition("/")[0] + "/runs", NAMES[s], l, d, took, n)
    print(f"{NAMES[s]}: ({l},{d}) {n} motifs in {took:.1f} s, written to {out}")
    return out


def search_folder(spark: SparkSession, folder: str, s: str, l: int, d: int, header_mode: str = "reference", quorum: float = 1) -> DataFrame:  # noqa: E741
    """(path, l, d, n) of the result files, one for each file of the folder that has a read; the search is one plan over all files."""
    lines = R.lines(spark, folder).cache()
    found = R.stored(search_files(lines, quorum, l, d, header_mode).drop("n_reads", "reads"), "motifs")
    counts = R.stored(found.groupBy("file", "l", "d").agg(F.count(F.lit(1)).alias("n")), "counts")
    done = []
    for row in counts.toLocalIterator():
        out = R.result_path(row.file, NAMES[s], row.l, row.d)
        R.write_motifs(found.where(F.col("file") == row.file), out)
        done.append((out, row.l, row.d, row.n))
    return spark.createDataFrame(done, "path string, l int, d int, n long")


def main(argv: list[str] | None = None) -> int:
    a = _parser().parse_args(argv)
    if a.help or a.file is None:
        _parser().print_help(sys.stderr)
        return 255
    if a.l <= 0 or a.d < 0 or not 0 < a.q <= 1:
        print("Error: l must be > 0, d must be >= 0 and q a share over 0 and up to 1.", file=sys.stderr)
        return 255
    try:
        if a.s == "2p" and a.t is not None and a.t <= 0:
            raise ValueError("2p needs one task at least")
        spark = session(a.t if a.t and a.t > 0 else None)
        if R.is_folder(spark, a.file):
            if a.s == "2p" or a.w:
                raise ValueError("a folder is searched for all motifs of the exact query")
            for r in search_folder(spark, a.file, a.s, a.l, a.d, a.header_mode, a.q).collect():
                print(f"({r.l},{r.d}) {r.n} motifs, written to {r.path}")
        else:
            search(spark, a.file, a.s, a.l, a.d, a.header_mode, a.q, a.w)
    except AnalysisException as e:
        missing = e.getCondition() == "PATH_NOT_FOUND"
        print(f"Error: no such file: {a.file}" if missing else f"Error: the search failed: {e}", file=sys.stderr)
        return 255
    except Exception as e:
        print(f"Error: the search failed: {e}", file=sys.stderr)
        return 255
    return 0


if __name__ == "__main__":
    sys.exit(main())
