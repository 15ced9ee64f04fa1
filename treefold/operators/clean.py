"""Compaction of a record log: drop records of what is gone or has changed its type, then keep the last per path."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treefold.functions import paths
from treefold.operators.incremental import keep_last


def live_only(records: DataFrame, live: DataFrame) -> DataFrame:
    """Records whose path exists with the same type. live: path, file_type; a null type (unreadable) keeps the record."""
    seen = live.select("path", F.col("file_type").alias("_live"))
    got = records.join(seen, "path", "inner")
    return got.where(F.col("_live").isNull() | (F.col("_live") == F.col("file_type"))).drop("_live")


def clean(records: DataFrame, live: DataFrame, root: str | None = None) -> DataFrame:
    """The liveness filter comes before keep-last, so an older record of the right type can survive a newer wrong one."""
    if root is not None:
        records = records.where(paths.is_under(F.col("path"), root))
    return keep_last(live_only(records, live))
