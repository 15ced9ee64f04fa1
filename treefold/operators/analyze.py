"""Minimal duplicate sets: a duplicated folder is reported once and its contents are not.

Input: records (ord, path, file_type, size, hash, children) in file order by `ord`.

mode 'parity': a set is reported iff its first member is an unsuppressed candidate. mode 'complete': iff any member is,
and a parent hides its children only if its whole set key (hash, size, type, children) occurs twice.

A group of thousands of copies is one `collect_list` of paths because the result row has that list; `members()` gives
the same sets as one row per member, which has no such row, for trees with larger groups.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from treefold.functions import paths
from treefold.operators.incremental import keep_last
from treefold.operators.scratch import Scratch
from treefold.schema import DIRECTORY, FILE, OTHER

KEY = ["hash", "size", "file_type", "children"]


class Groups:
    """What every question below is answered from: the records, stored once, and one aggregate of them by their whole key.
    Partial aggregation shrinks hot groups before the shuffle."""

    def __init__(self, records: DataFrame):
        self.scratch = scratch = Scratch(records.sparkSession, "analyze")
        self.records = scratch.store(records.select("ord", "path", *KEY), "records")
        self.groups = scratch.store(self.records.groupBy(*KEY).agg(F.count("*").alias("n"), F.min_by("path", "ord").alias("rep")), "groups")
        self.hot = scratch.store(self.groups.groupBy("hash").agg(F.sum("n").alias("n")).where("n >= 2"), "hot")
        self.sets = self.groups.where((F.col("n") >= 2) & (F.col("file_type") != OTHER))


def groups(records: DataFrame | Groups) -> Groups:
    return records if isinstance(records, Groups) else Groups(records)


def hot_hashes(records: DataFrame) -> DataFrame:
    """Hashes with at least two records, stale ones included: hash, n."""
    return records.groupBy("hash").agg(F.count("*").alias("n")).where("n >= 2")


def unsuppressed(records: DataFrame | Groups, mode: str = "parity") -> DataFrame:
    """path, hash of the candidates that no duplicated parent explains."""
    g = groups(records)
    solid = keep_last(g.records).where(F.col("file_type") != OTHER)
    cand = solid.join(g.hot.select("hash"), "hash", "left_semi").select("path", "hash", paths.parent(F.col("path")).alias("parent"))
    if mode == "parity":
        hidden = solid.join(g.hot.select("hash"), "hash", "left_semi")
    else:
        hidden = solid.join(g.groups.where("n >= 2").select(*KEY), KEY, "left_semi")
    return cand.join(hidden.select(F.col("path").alias("parent")), "parent", "left_anti").select("path", "hash")


def emitted(records: DataFrame | Groups, mode: str = "parity") -> DataFrame:
    """Sets that are reported: the key, n, rep."""
    g = groups(records)
    keep = unsuppressed(g, mode)
    if mode == "parity":
        return g.sets.join(keep.select(F.col("path").alias("rep"), "hash"), ["rep", "hash"], "left_semi")
    if mode != "complete":
        raise ValueError("mode must be 'parity' or 'complete'")
    own = g.records.join(keep, ["path", "hash"], "left_semi").select(*KEY).distinct()
    return g.sets.join(own, KEY, "left_semi")


def members(records: DataFrame | Groups, mode: str = "parity") -> DataFrame:
    """One row per member of a reported set: the key, rep, ord, path."""
    g = groups(records)
    return g.records.join(emitted(g, mode).drop("n"), KEY, "inner").select(*KEY, "rep", "ord", "path")


def duplicate_sets(records: DataFrame | Groups, mode: str = "parity") -> DataFrame:
    """ftype, size, hash, conflicting (paths in file order), n."""
    return (
        members(records, mode)
        .groupBy(*KEY)
        .agg(F.array_sort(F.collect_list(F.struct("ord", "path"))).alias("m"))
        .select(F.col("file_type").alias("ftype"), "size", "hash", F.col("m.path").alias("conflicting"), F.size("m").cast("long").alias("n"))
    )


def summary(records: DataFrame | Groups, mode: str = "parity") -> DataFrame:
    """One row: the redundant size (which mixes bytes with child counts of directories), its GiB, and bytes alone."""
    spare = F.col("size") * (F.col("n") - 1)
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    got = emitted(records, mode).agg(
        F.count("*").alias("sets"), zero(F.sum(spare)).alias("redundant_units"), zero(F.sum(F.when(F.col("file_type") == FILE, spare))).alias("redundant_bytes"),
        zero(F.sum(F.when(F.col("file_type") == DIRECTORY, F.col("n") - 1))).alias("redundant_directories"),
    )
    return got.withColumn("redundant_gib", F.expr("redundant_units div 1073741824"))


def ranked(records: DataFrame | Groups, mode: str = "parity") -> DataFrame:
    """members() with each one's position in its set, for trees whose sets are too large for one row. Members are dealt by
    ranges of (key, ord), so a large set is numbered in several tasks; each adds what the ranges before it hold."""
    g = groups(records)
    dealt = g.scratch.store(members(g, mode).repartitionByRange(*KEY, "ord").withColumn("_part", F.spark_partition_id()), "members")
    ahead = F.sum("_n").over(Window.partitionBy(*KEY).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    ahead = dealt.groupBy(*KEY, "_part").agg(F.count("*").alias("_n")).select(*KEY, "_part", F.coalesce(ahead, F.lit(0)).alias("_ahead"))
    inside = F.row_number().over(Window.partitionBy(*KEY, "_part").orderBy("ord"))
    got = dealt.withColumn("position", inside).join(g.scratch.store(ahead, "ahead"), [*KEY, "_part"])
    return got.withColumn("position", (F.col("position") + F.col("_ahead")).cast("int")).drop("_part", "_ahead")
