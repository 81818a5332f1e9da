"""Command line: ``python -m strandmill.generate -l 11 -d 3 --seed 1 OUT`` writes a file of planted reads."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from strandmill.operators import planted


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser("strandmill.generate", description="Reads with an edited motif planted in each.")
    parser.add_argument("-n", type=int, default=20, help="reads")
    parser.add_argument("-m", type=int, default=600, help="bases of a read")
    parser.add_argument("-l", type=int, default=11)
    parser.add_argument("-d", type=int, default=3)
    parser.add_argument("--seed", default="0")
    parser.add_argument("out", nargs="?", help="the file; planted_l<l>_d<d>.txt by default")
    a = parser.parse_args(argv)
    if min(a.n, a.m, a.l) <= 0 or a.d < 0:
        print("Error: n, m and l must be > 0 and d must be >= 0.", file=sys.stderr)
        return 255
    out = a.out or f"planted_l{a.l}_d{a.d}.txt"
    spark = SparkSession.builder.appName("strandmill.generate").getOrCreate()
    planted.write_planted(planted.generate(spark, a.n, a.m, a.l, a.d, a.seed), out)
    print(f"{out}: motif {planted.random_motif(a.seed, a.l)}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
