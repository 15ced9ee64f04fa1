"""Resuming from an earlier snapshot: unchanged nodes keep their hash and aren't written again."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from treefold.schema import DIRECTORY


def keep_last(records: DataFrame, key: str = "path", order: str = "ord") -> DataFrame:
    """The last record of each key, in file order. Spark plans the rank as a group limit before its shuffle."""
    last = Window.partitionBy(key).orderBy(F.col(order).desc())
    return records.withColumn("_rank", F.row_number().over(last)).where("_rank = 1").drop("_rank")


def with_cached(current: DataFrame, previous: DataFrame) -> DataFrame:
    """current (path, file_type, modified, size, …) with `cached_hash` from the snapshot, null unless type, time and size
    are equal, and for directories, where current has children, those too."""
    prev = previous.select("path", F.col("file_type").alias("_t"), F.col("modified").alias("_m"), F.col("size").alias("_s"), F.col("hash").alias("_h"), F.col("children").alias("_c"))
    same = (F.col("_t") == F.col("file_type")) & (F.col("_m") == F.col("modified")) & (F.col("_s") == F.col("size"))
    if "children" in current.columns:
        same &= (F.col("file_type") != DIRECTORY) | F.col("_c").eqNullSafe(F.col("children"))
    return current.join(prev, "path", "left").withColumn("cached_hash", F.when(same, F.col("_h"))).drop("_t", "_m", "_s", "_h", "_c")


def split_cached(current: DataFrame, previous: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits with `hash`, misses): two branches, so that only the misses reach a hashing UDF."""
    return split(with_cached(current, previous))


def split(both: DataFrame) -> tuple[DataFrame, DataFrame]:
    """with_cached()'s rows; best stored, as both branches read them."""
    return both.where("cached_hash is not null").withColumnRenamed("cached_hash", "hash"), both.where("cached_hash is null").drop("cached_hash")


def changed_records(current: DataFrame, previous: DataFrame) -> DataFrame:
    """The records of the new snapshot that differ from the old one's in type, time, size, hash or children."""
    key = ["path", "file_type", "modified", "size", "hash", "children"]
    return current.join(previous.select(*key), key, "left_anti")


def snapshot_status(current: DataFrame, previous: DataFrame) -> DataFrame:
    """path, status: added, removed, changed (other hash), touched (other time or size only), cached."""
    a, b = (x.select("path", F.struct("file_type", "modified", "size", "hash").alias(n)) for x, n in ((current, "c"), (previous, "p")))
    status = (
        F.when(F.col("p").isNull(), "added")
        .when(F.col("c").isNull(), "removed")
        .when(F.col("p.hash") != F.col("c.hash"), "changed")
        .when(F.col("p") != F.col("c"), "touched")
        .otherwise("cached")
    )
    return a.join(b, "path", "full").select("path", status.alias("status"))


def append(log: DataFrame, new: DataFrame) -> DataFrame:
    """The log with new records behind it."""
    return log.unionByName(new)
