"""Order-independent hashes of directories.

A directory's hash is the digest of its children's raw digests, sorted by hash. Names, types and sizes take no part; a
NULL child adds no bytes but counts. One shuffle by parent per level of the tree. The leaves are stored once, sorted by
depth within each file, and so is each level's result, since the next level and the final union both read it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treefold.functions import hashing, paths
from treefold.operators.scratch import Scratch
from treefold.schema import DIRECTORY


def _children() -> Column:
    return F.array_sort(F.collect_list(F.struct(hashing.rank(F.col("hash")).alias("r"), F.col("hash").alias("h"))))


def fold_level(nodes: DataFrame, algorithm: str) -> DataFrame:
    """The directories that hold the given nodes (path, hash): path, hash, size (number of children), children."""
    algorithm = hashing.parse_algorithm(algorithm)
    got = (
        nodes.select(paths.parent(F.col("path")).alias("path"), "hash")
        .where(F.col("path").isNotNull())
        .groupBy("path")
        .agg(_children().alias("c"))
        .select("path", F.col("c.h").alias("children"))
    )
    raw = F.unhex(F.concat_ws("", F.transform(F.filter("children", lambda h: ~h.startswith("NULL:")), lambda h: F.substring_index(h, ":", -1))))
    return got.select("path", hashing.digest(raw, algorithm).alias("hash"), F.size("children").cast("long").alias("size"), "children")


def _by_depth(nodes: DataFrame) -> DataFrame:
    """With their depth, and sorted by it within each file, so that reading a level skips the row groups of others."""
    return nodes.withColumn("depth", paths.depth(F.col("path"))).sortWithinPartitions("depth")


def tree(leaves: DataFrame, algorithm: str = "SHA256", directories: DataFrame | None = None, include_root: bool = False, include_empty: bool = False) -> DataFrame:
    """The leaves' records and those of all directories above them, stored: leaves are computed once."""
    scratch, columns = Scratch(leaves.sparkSession, "tree"), leaves.columns
    held = scratch.store(_by_depth(leaves), "leaves")
    return held.select(*columns).unionByName(_fold(held, scratch, algorithm, directories, include_root, include_empty).select(*columns))


def fold(leaves: DataFrame, algorithm: str = "SHA256", directories: DataFrame | None = None, include_root: bool = False, include_empty: bool = False) -> DataFrame:
    """Records of all directories above the leaves.

    leaves: path, hash, at any depths. directories: path, modified of scanned directories, for their times (0 without).
    Directories without any leaf below get no record, unless include_empty: then size 0 and the digest of no bytes.
    Returns path, file_type, modified, size, hash, children.
    """
    scratch = Scratch(leaves.sparkSession, "fold")
    held = scratch.store(_by_depth(leaves.select("path", "hash")), "leaves")
    return _fold(held, scratch, algorithm, directories, include_root, include_empty)


def _fold(leaves: DataFrame, scratch: Scratch, algorithm: str, directories: DataFrame | None, include_root: bool, include_empty: bool) -> DataFrame:
    """leaves: stored, path, hash, depth."""
    leaves, empty = leaves.select("path", "hash", "depth"), None
    if include_empty and directories is not None:
        held = leaves.select(paths.parent(F.col("path")).alias("path")).unionByName(directories.select(paths.parent(F.col("path")).alias("path"))).distinct()
        empty = directories.select("path").join(held, "path", "left_anti").select("path", hashing.digest(F.lit(b""), algorithm).alias("hash"))
        empty = scratch.store(_by_depth(empty), "empty")
        leaves = leaves.unionByName(empty)
    top = 0 if include_root else 1
    deepest = leaves.agg(F.max("depth")).first()[0]
    levels, above = [], None
    for d in range(deepest or 0, top, -1):
        nodes = leaves.where(F.col("depth") == d).select("path", "hash")
        if above is not None:
            nodes = nodes.unionByName(above.select("path", "hash"))
        above = scratch.store(fold_level(nodes, algorithm), f"level{d}")
        levels.append(above)
    if empty is not None:
        levels.append(empty.select("path", "hash", F.lit(0).cast("long").alias("size"), F.array().cast("array<string>").alias("children")))
    if not levels:
        levels = [fold_level(leaves.where("false"), algorithm)]
    out = levels[0]
    for x in levels[1:]:
        out = out.unionByName(x)
    if directories is not None:
        out = out.join(directories.select("path", "modified"), "path", "left")
    else:
        out = out.withColumn("modified", F.lit(0).cast("long"))
    return out.select("path", F.lit(DIRECTORY).alias("file_type"), F.coalesce("modified", F.lit(0)).cast("long").alias("modified"), "size", "hash", "children")
