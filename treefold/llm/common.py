"""What the operators share: tables in the shared folder, and words."""

from __future__ import annotations

import gc

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treefold.operators.scratch import Scratch, free, located  # noqa: F401

#: The white space between words, as the contracts give it.
WORD_JAVA = r"[^\x20\x09-\x0D]+"


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fold_ascii(text: Column) -> Column:
    """Lower-cases A-Z only; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def only(df: DataFrame, *columns: str) -> DataFrame:
    """Just the columns an operator works on, so that others, whatever their names, can't clash."""
    return df.select(*[F.col(f"`{c}`") for c in columns])


def hash_sample(df: DataFrame, key: str, rows: int, seed: int = 11) -> DataFrame:
    """About `rows` rows at most, chosen by a hash of the key: the same ones whatever the partitioning. For fitting."""
    return weighted_sample(df, key, rows, seed)[0]


def weighted_sample(df: DataFrame, key: str, rows: int, seed: int = 11) -> tuple[DataFrame, float]:
    """hash_sample() and how many rows of df each of its rows stands for."""
    n = df.count()
    if n <= rows:
        return df, 1.0
    part = int(rows / n * (1 << 30))
    return df.where(F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1 << 30)) < part), (1 << 30) / part


def shares(sizes: dict, total: int, least: int = 1) -> dict:
    """What each group gets of a total: equal parts, of which small groups leave to the others what they can't fill, and
    `least` (or all it has) where an equal part is less."""
    out, left = {}, total
    for k, x in enumerate(sorted(sizes, key=lambda g: (sizes[g], g))):
        out[x] = min(sizes[x], max(least, left // (len(sizes) - k)))
        left -= out[x]
    return out


_held: dict = {}


def held(name, make):
    """What a worker process keeps between tasks, such as a cache. Another operator's is let go first, so that a worker
    that serves one stage after another holds one at a time."""
    if name not in _held:
        _held.clear()
        gc.collect()
        _held[name] = make()
    return _held[name]


def let_go() -> None:
    """Frees what other operators left in this worker."""
    if _held:
        _held.clear()
        gc.collect()
