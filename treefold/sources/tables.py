"""Rows of a table as the leaves of a virtual tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treefold.functions import hashing
from treefold.operators import merkle
from treefold.schema import FILE


def leaves(df: DataFrame, path: Column, content: Column, algorithm: str = "SHA256", modified: Column | None = None) -> DataFrame:
    """One File record a row: path, file_type, modified, size (bytes), hash, children. Paths must be unique."""
    return df.select(
        path.alias("path"),
        F.lit(FILE).alias("file_type"),
        (F.lit(0) if modified is None else modified).cast("long").alias("modified"),
        F.octet_length(content).cast("long").alias("size"),
        hashing.digest(content, algorithm).alias("hash"),
        F.array().cast("array<string>").alias("children"),
    )


def from_table(df: DataFrame, path: Column, content: Column, algorithm: str = "SHA256", include_root: bool = False) -> DataFrame:
    """Records of the leaves and of all directories above them. File order is the order of paths, which needs no
    global ranking: `ord` is the path itself."""
    return merkle.tree(leaves(df, path, content, algorithm), algorithm, include_root=include_root).withColumn("ord", F.col("path"))
