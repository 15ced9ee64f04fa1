"""build, clean and analyze over a real tree."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treefold.functions import hashing, paths
from treefold.operators import analyze, incremental, merkle
from treefold.operators import clean as cleaning
from treefold.operators.scratch import Scratch
from treefold.schema import DIRECTORY, FILE, OTHER, RECORD, SYMLINK
from treefold.sources import fstree, hashlog

_NONE = "array()"


def build_tree(
    spark: SparkSession, root: str, base_dir: str | None = None, previous: DataFrame | None = None, hash_type: str = "SHA256",
    follow_symlinks: bool = False, include_empty: bool = False,
) -> DataFrame:
    """Records of the tree at root: ord, path (relative to base_dir), file_type, modified, size, hash, children.

    Files whose type, time and size are as in `previous` keep its hash and aren't read. Empty directories get no record
    unless include_empty. A root equal to base_dir has the path "".
    """
    hash_type = hashing.parse_algorithm(hash_type)
    base = paths.resolve(base_dir or ".", existing=True)
    rel = os.path.relpath(paths.resolve(root, base), base)
    rel = "" if rel == "." else rel
    scratch = Scratch(spark, "build")
    seen = scratch.store(fstree.scan(spark, base, rel, follow_symlinks), "seen")  # one listing, which everything below goes by
    links = seen.where(F.col("file_type") == SYMLINK).select("path", "file_type", "modified", "size", hashing.link_digest(F.col("target"), hash_type).alias("hash"))
    others = seen.where(F.col("file_type") == OTHER).select("path", "file_type", F.lit(0).cast("long").alias("modified"), "size", F.lit(hashing.NULL_HASH).alias("hash"))
    files = seen.where(F.col("file_type") == FILE).select("path", "file_type", "modified", "size")
    cols = ["path", "file_type", "modified", "size", "hash"]
    spread = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    if previous is None:
        hashed = fstree.hash_files(files.repartition(spread, "path"), base, hash_type)
    else:
        prev = incremental.keep_last(previous).where(hashing.type_guard(F.col("hash"), F.col("file_type"), hash_type))
        both = scratch.store(incremental.with_cached(files, prev), "cached")
        hit, miss = incremental.split(both)
        hashed = hit.select(*cols).unionByName(fstree.hash_files(miss.repartition(spread, "path"), base, hash_type).select(*cols))
    leaves = hashed.select(*cols).unionByName(links).unionByName(others).withColumn("children", F.expr(_NONE).cast("array<string>"))
    nodes = merkle.tree(leaves, hash_type, seen.where(F.col("file_type") == DIRECTORY).select("path", "modified"), include_root=rel == "", include_empty=include_empty)
    nodes = nodes.where(paths.is_under(F.col("path"), rel))
    # children before their directory, as a post-order walk would write them
    return nodes.withColumn("ord", F.struct((-paths.depth(F.col("path"))).alias("d"), F.col("path").alias("p"))).select(*RECORD)


def live_nodes(spark: SparkSession, base_dir: str, root: str = "", follow_symlinks: bool = False) -> DataFrame:
    """What exists now: path, file_type. A link counts as existing only while its target does. The type is null where a
    node exists but can't be looked at."""
    return live_types(fstree.scan(spark, base_dir, root, follow_symlinks), base_dir)


def live_types(seen: DataFrame, base_dir: str) -> DataFrame:
    """Rows of a scan to path, file_type. A node without an identity couldn't be looked at."""
    base = os.path.abspath(base_dir)

    def reachable(batches):
        for pdf in batches:
            yield pdf[[os.path.exists(os.path.join(base, p) if p else base) for p in pdf["path"]]]

    unseen = F.col("inode").isNull()
    odd = seen.where(unseen | (F.col("file_type") == SYMLINK)).select("path", F.when(~unseen, F.col("file_type")).alias("file_type")).mapInPandas(reachable, "path string, file_type string")
    return seen.where(~unseen & (F.col("file_type") != SYMLINK)).select("path", "file_type").unionByName(odd)


def resume(spark: SparkSession, root: str, log: str, base_dir: str | None = None, hash_type: str = "SHA256", follow_symlinks: bool = False, noclean: bool = False, overwrite: bool = False) -> DataFrame:
    """The build command: starts a log, or continues one by appending only what has changed; then cleans it."""
    hash_type = hashing.parse_algorithm(hash_type)
    hashlog.settle(spark, log)
    if overwrite or not hashlog._exists(spark, log):
        now = build_tree(spark, root, base_dir, None, hash_type, follow_symlinks)
        hashlog.write(now, log, hash_type, "overwrite")
        return now
    if (had := hashlog.read_header(spark, log)["hash_type"]) != hash_type:
        raise ValueError(f"the log was made with {had}; it can't be continued with {hash_type}")
    before = hashlog.read(spark, log)
    now = build_tree(spark, root, base_dir, before, hash_type, follow_symlinks)
    new = Scratch(spark, "resume").store(incremental.changed_records(now, incremental.keep_last(before)), "new")
    hashlog.append(new, log)
    after = hashlog.read(spark, log)
    if noclean:
        return after
    return cleaning.clean(after, live_nodes(spark, paths.resolve(base_dir or ".", existing=True), "", follow_symlinks))


def find_duplicates(records: DataFrame, mode: str = "parity") -> DataFrame:
    """The analyze command's sets."""
    return analyze.duplicate_sets(records, mode)
