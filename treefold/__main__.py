"""python -m treefold build|clean|analyze …"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from treefold.operators import analyze
from treefold.operators import clean as cleaning
from treefold.plans import commands
from treefold.sources import hashlog


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="treefold")
    p.add_argument("-t", "--threads", type=int, help="local worker threads; without it Spark's master decides")
    p.add_argument("-v", "--verbose", action="store_true")
    p.add_argument("-d", "--debug", action="store_true")
    sub = p.add_subparsers(dest="command", required=True)
    b = sub.add_parser("build")
    b.add_argument("directory")
    b.add_argument("--follow-symlinks", action="store_true")
    b.add_argument("-o", "--output", default="hash_tree")
    b.add_argument("-w", "--working-directory")
    b.add_argument("--overwrite", action="store_true")
    b.add_argument("--hash", default="sha256")
    b.add_argument("--noclean", action="store_true")
    c = sub.add_parser("clean")
    c.add_argument("-i", "--input", default="hash_tree")
    c.add_argument("-o", "--output", default="hash_tree_clean")
    c.add_argument("-w", "--working-directory")
    c.add_argument("--overwrite", action="store_true")
    c.add_argument("--root")
    c.add_argument("--follow-symlinks", action="store_true")
    a = sub.add_parser("analyze")
    a.add_argument("-i", "--input", default="hash_tree")
    a.add_argument("-o", "--output", default="analysis.json")
    a.add_argument("--overwrite", action="store_true")
    a.add_argument("--mode", choices=("parity", "complete"), default="parity")
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.threads is not None and args.threads < 1:
        print("threads must be at least 1", file=sys.stderr)
        return 2
    make = SparkSession.builder.appName("treefold")
    if args.threads:
        make = make.master(f"local[{args.threads}]")
    spark = make.getOrCreate()
    spark.sparkContext.setLogLevel("DEBUG" if args.debug else "INFO" if args.verbose else "ERROR")
    mode = "overwrite" if getattr(args, "overwrite", False) else "errorifexists"
    if args.command == "build":
        fresh = args.overwrite or not hashlog._exists(spark, args.output)
        got = commands.resume(spark, args.directory, args.output, args.working_directory, args.hash, args.follow_symlinks, args.noclean, args.overwrite)
        if not fresh and not args.noclean:  # compaction; the old log stays until the new one is whole
            hashlog.write(got, args.output, args.hash, "overwrite")
    elif args.command == "clean":
        kind = hashlog.read_header(spark, args.input)["hash_type"]
        live = commands.live_nodes(spark, args.working_directory or ".", "", args.follow_symlinks)
        hashlog.write(cleaning.clean(hashlog.read(spark, args.input), live, args.root), args.output, kind, mode)
    else:
        records = hashlog.read(spark, args.input)
        hashlog.write_sets(analyze.duplicate_sets(records, args.mode), args.output, mode)
        print(f"{analyze.summary(records, args.mode).first()['redundant_gib']} GiB of duplicated data")
    return 0


if __name__ == "__main__":
    sys.exit(main())
