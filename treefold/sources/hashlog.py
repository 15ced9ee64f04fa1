"""The record log: JSON lines behind a header line, or Parquet with an explicit ordinal.

File order matters (the last record of a path wins, the first of a set represents it). Read from text it is
(file, offset of the split, line within the split), which follows the file however it is split.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treefold.functions import hashing, paths
from treefold.operators.scratch import located
from treefold.schema import ENTRY, HEADER, NODE_TYPES, VERSION


def header(algorithm: str, created: int | None = None) -> dict:
    return {"version": VERSION, "hash_type": hashing.parse_algorithm(algorithm), "creation_date": int(time.time()) if created is None else created}


def _lines(spark: SparkSession, path: str) -> DataFrame:
    text = spark.read.option("recursiveFileLookup", "true").text(path)
    return text.select(F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("line")).alias("ord"), "value")


def _is_header() -> Column:
    return F.get_json_object("value", "$.version").isNotNull() & F.get_json_object("value", "$.file_type").isNull()


def read_header(spark: SparkSession, path: str) -> dict:
    """The header of a log; an error if there is none or its version isn't known."""
    got = _lines(spark, path).where(_is_header()).orderBy("ord").select(F.from_json("value", HEADER).alias("h")).select("h.*").first()
    if got is None:
        raise ValueError(f"{path} has no header line")
    if got["version"] != VERSION:
        raise ValueError(f"{path} has version {got['version']}; known: {VERSION}")
    return got.asDict()


def malformed(e: Column) -> Column:
    """Whether a parsed line lacks a field, or has a type or hash that doesn't exist."""
    missing = F.lit(False)
    for name in ENTRY.fieldNames():
        missing = missing | e[name].isNull()
    bad_child = F.exists(e["children"], lambda h: hashing.parse(h).isNull())
    parts = e["path"]["path"]
    bad_path = parts.isNull() | F.exists(parts, lambda c: c["path"].isNull() | c["target"].isNull())
    return F.coalesce(missing | ~e["file_type"].isin(*NODE_TYPES) | hashing.parse(e["hash"]).isNull() | bad_child | bad_path, F.lit(True))


def parsed(lines: DataFrame) -> DataFrame:
    """Lines (value, …) without blank ones and headers, with the record as e and whether it is malformed as bad."""
    got = lines.where((F.length("value") > 0) & ~F.coalesce(_is_header(), F.lit(False))).withColumn("e", F.from_json("value", ENTRY))
    return got.withColumn("bad", malformed(F.col("e")))


def records(good: DataFrame) -> DataFrame:
    """Well-formed lines to record columns, with hashes in canonical form."""
    out = good.drop("value", "bad").select("*", "e.*").drop("e").withColumn("path", paths.unwrap(F.col("path")))
    return out.withColumn("hash", hashing.parse(F.col("hash"))).withColumn("children", F.transform("children", hashing.parse))


def read(spark: SparkSession, path: str, guard: bool = True) -> DataFrame:
    """Records with `ord`. Blank lines are skipped; with guard, records of another algorithm than the header's are
    dropped. A malformed line is an error, except the very last, which a killed writer may have left unfinished. A line is
    malformed if it isn't JSON, lacks a field, or has an unknown type or hash."""
    kind = read_header(spark, path)["hash_type"]
    lines = parsed(_lines(spark, path))
    wrong = F.when(F.col("bad"), F.struct("ord", "value"))
    found = lines.agg(F.min(wrong).alias("first"), F.max("ord").alias("last")).first()
    if found["first"] is not None and found["first"]["ord"] != found["last"]:
        raise ValueError(f"malformed line in {path}: {found['first']['value'][:200]}")
    good = records(lines.where("not bad"))
    return good.where(hashing.type_guard(F.col("hash"), F.col("file_type"), kind)) if guard else good


def to_lines(records: DataFrame) -> DataFrame:
    """One JSON line a record, in the log's field order."""
    return records.select(F.to_json(F.struct("file_type", "modified", "size", "hash", paths.wrap(F.col("path")).alias("path"), "children")).alias("value"))


def write(records: DataFrame, path: str, algorithm: str, mode: str = "errorifexists", created: int | None = None) -> None:
    """A log folder: the header's file sorts before the records'. It is written under another name first and takes its place
    only when it is whole, so that the old log may be read meanwhile and none of its parts stay behind."""
    spark = records.sparkSession
    settle(spark, path)
    if mode == "errorifexists" and _exists(spark, path):
        raise FileExistsError(f"{path} exists; pass mode='overwrite'")
    first, new = spark.createDataFrame([(json.dumps(header(algorithm, created)),)], "value string"), path.rstrip("/") + NEW
    to_lines(records.sort("ord")).write.mode("overwrite").text(os.path.join(new, "1-records"))
    first.coalesce(1).write.mode("overwrite").text(os.path.join(new, "0-header"))
    if _exists(spark, path):
        _move(spark, path, path.rstrip("/") + OLD)
    settle(spark, path)


#: What a log that is being written, and one that is being replaced, is called meanwhile.
NEW, OLD = ".new", ".old"


def settle(spark: SparkSession, path: str) -> None:
    """Finishes or undoes a replacement that was broken off. A new log is whole once the old one has been moved away, or
    once it has its header, which is written last."""
    new, old = (path.rstrip("/") + x for x in (NEW, OLD))
    if _exists(spark, new) and not _exists(spark, path) and _exists(spark, os.path.join(new, "0-header", "_SUCCESS")):
        _move(spark, new, path)
    elif _exists(spark, old) and not _exists(spark, path):
        _move(spark, old, path)
    for left in (new, old):
        if _exists(spark, left):
            fs, p = located(spark, left)
            fs.delete(p, True)


def _move(spark: SparkSession, a: str, b: str) -> None:
    (fs, p), (_, q) = located(spark, a), located(spark, b)
    if not fs.rename(p, q):
        raise OSError(f"{a} can't be renamed to {b}")


def write_file(records: DataFrame, path: str, algorithm: str, created: int | None = None) -> None:
    """A log as one local file, streamed partition by partition through the driver."""
    part = f"{path}.part"
    with open(part, "w") as f:
        f.write(json.dumps(header(algorithm, created)) + "\n")
        for row in to_lines(records.sort("ord")).toLocalIterator():
            f.write(row["value"] + "\n")
    os.replace(part, path)


def append(records: DataFrame, path: str) -> None:
    """Adds the new records behind a log folder; the folder's name sorts behind those before."""
    to_lines(records.sort("ord")).write.mode("errorifexists").text(os.path.join(path, f"2-{time.time_ns():020d}"))


def write_parquet(records: DataFrame, path: str, mode: str = "errorifexists") -> None:
    records.write.mode(mode).parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    fs, p = located(spark, path)
    return fs.exists(p)


def write_sets(sets: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Duplicate sets as JSON lines: ftype, size, hash, conflicting (logical paths)."""
    out = F.struct("ftype", "size", "hash", F.transform("conflicting", lambda p: paths.wrap(p)).alias("conflicting"))
    sets.select(F.to_json(out).alias("value")).write.mode(mode).text(path)
