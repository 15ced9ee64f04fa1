"""A growing log folder as a stream: every appended file is parsed with the fixed schema and guarded by algorithm.

The record log has no event time and needs no state, so neither watermark nor window is involved."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treefold.functions import hashing
from treefold.sources import hashlog


def tail(spark: SparkSession, path: str, algorithm: str = "SHA256") -> DataFrame:
    """Records of all files, present and to come. A malformed line stops the query: appended files are whole, so that none
    can be the unfinished end of a write."""
    lines = hashlog.parsed(spark.readStream.option("recursiveFileLookup", "true").text(path))
    stop = F.raise_error(F.concat(F.lit("malformed line: "), F.left("value", F.lit(200)))).cast("boolean")
    got = hashlog.records(lines.where(F.when(F.col("bad"), stop).otherwise(F.lit(True))))
    return got.where(hashing.type_guard(F.col("hash"), F.col("file_type"), algorithm))
