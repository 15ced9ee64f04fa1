"""Tables that a computation writes on its way, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import gc
import os
import tempfile
import uuid
from contextlib import suppress

from pyspark.sql import DataFrame, SparkSession

_left: list = []


@atexit.register
def _sweep() -> None:
    """Results are read lazily from these tables, so what nobody dropped goes when the driver ends."""
    while _left:
        with suppress(Exception):  # Spark may be gone by then
            fs, path = _left.pop()
            fs.delete(path, True)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; one of our own only where that is unset and the master is local."""
    if not (found := spark.conf.get("spark.checkpoint.dir", None)):
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = os.path.join(tempfile.gettempdir(), f"treefold-{spark.sparkContext.applicationId}")
        spark.conf.set("spark.checkpoint.dir", found)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found


def located(spark: SparkSession, path: str):
    """The file system that holds a path, and the path as it sees it."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def free(spark: SparkSession) -> None:
    """Lets Spark's cleaner delete the shuffle files of finished steps now rather than at its next collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


class Scratch:
    """A written table cuts the lineage and survives lost executors; drop() frees its disk as soon as nothing reads it."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.top = spark, os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")
        _left.append(located(spark, self.top))

    def path(self, name: str) -> str:
        return os.path.join(self.top, name)

    def store(self, df: DataFrame, name: str, by: str | None = None, few: bool = False) -> DataFrame:
        """by: a column with few values, each of which gets a folder that a filter on it reads alone. few: for short lists
        of keys, which are dealt out anew so that they don't get a file for each partition of a shuffle."""
        if few:
            df = df.repartition(max(4 * self.spark.sparkContext.defaultParallelism, int(self.spark.conf.get("spark.sql.shuffle.partitions")) // 4))
        to = df.write.mode("overwrite")
        (to.partitionBy(by) if by else to).parquet(self.path(name))
        return self.load(name, df)

    def load(self, name: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(self.path(name)).select(*[f"`{c}`" for c in like.columns])

    def drop(self, *names: str, collect: bool = True) -> None:
        """collect: lets go of finished shuffles too, which takes a moment."""
        for path in [self.path(n) for n in names] or [self.top]:
            fs, p = located(self.spark, path)
            fs.delete(p, True)
        if collect:
            free(self.spark)
