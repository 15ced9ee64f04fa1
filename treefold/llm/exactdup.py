"""Exact deduplication by deterministic block naming.

A normalised text is cut into blocks of a fixed number of bytes. Equal blocks get one integer name: distinct blocks are
sorted, by hash and then by content, and numbered. Then adjacent pairs of names are named the same way, level by level,
until every document has one name. Names stand for contents without collisions: while blocks are numbered, neighbours
of equal 128-bit hash are compared byte by byte, and if two differ the pass is repeated with another hash seed.

A block's content is shuffled once for each task that holds it, so a group of copies with a third of all rows sends as
many blocks as there are tasks, and contents are never stored: references to blocks, a few integers each, come from a
second pass over the texts. Joins on hot names are split by Spark.

Texts are equal when identical after lower-casing A-Z; null counts as empty. Of equal texts the row with the largest key
stays (null is smallest); of rows that share that key too, one stays. Empty tables give no rows; extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treefold.llm.common import Scratch, fold_ascii, free, let_go, only, shuffle_partitions

#: Bytes of blocks that a task remembers having sent; beyond them a block may be sent again.
REMEMBER = 32 << 20
SHIFT = 40


def _hashed(data: bytes, size: int, seed: int) -> Iterator[tuple[int, int, bytes]]:
    """h1, h2 and content of each block; an empty text is one empty block."""
    for at in range(0, max(1, len(data)), size):
        block = data[at : at + size]
        h = xxhash.xxh3_128_intdigest(block, seed)
        yield (h >> 64) - (1 << 63), (h & (2**64 - 1)) - (1 << 63), block


def _folded(text: str | None) -> bytes:
    return (text or "").encode().lower()


def _contents(df: DataFrame, text: str, size: int, seed: int) -> DataFrame:
    """h1, h2, block: each block once a task, as far as the task remembers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        sent, held = set(), 0
        for batch in batches:
            out = []
            for x in batch.column(0):
                for h1, h2, block in _hashed(_folded(x.as_py()), size, seed):
                    if (mark := (h1, h2, len(block))) not in sent:
                        if held > REMEMBER:
                            sent.clear()
                            held = 0
                        sent.add(mark)
                        held += 200
                        out.append((h1, h2, block))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.binary()))], names=["h1", "h2", "block"])

    return only(df, text).mapInArrow(run, "h1 long, h2 long, block binary")


def _references(df: DataFrame, key: str, text: str, size: int, seed: int) -> DataFrame:
    """_row, pos, n, h1, h2, and for pos 0 the key and sha."""
    key_type = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << SHIFT
        for batch in batches:
            refs, at = [], []
            for i, x in enumerate(batch.column(1)):
                data = _folded(x.as_py())
                n = max(1, -(-len(data) // size))
                refs += [(row, pos, n, h1, h2, None if pos else hashlib.sha256(data).hexdigest()) for pos, (h1, h2, _) in enumerate(_hashed(data, size, seed))]
                at += [i] + [None] * (n - 1)
                row += 1
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
            cols = [pa.array([r[k] for r in refs], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*cols[:5], batch.column(0).take(pa.array(at, pa.int64())), cols[5]], names=["_row", "pos", "n", "h1", "h2", key, "sha"])

    return only(df, key, text).mapInArrow(run, f"_row long, pos int, n int, h1 long, h2 long, `{key}` {key_type}, sha string")


def _numbered(contents: DataFrame) -> DataFrame:
    """Distinct blocks, sorted by (h1, h2, block) within each partition, to h1, h2, name, clash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, last, seen = (TaskContext.get().partitionId() << SHIFT) - 1, None, None
        for batch in batches:
            out = []
            for h1, h2, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                block = block.as_py()
                if (h1, h2) != last:
                    last, seen, name = (h1, h2), block, name + 1
                    out.append((h1, h2, name, False))
                elif block != seen:
                    out.append((h1, h2, name, True))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.bool_()))], names=["h1", "h2", "name", "clash"])

    return contents.mapInArrow(run, "h1 long, h2 long, name long, clash boolean")


def identities(df: DataFrame, scratch: Scratch, key: str = "doc_id", text: str = "text", block: int = 1024) -> DataFrame:
    """_row, the key, sha, level, name: rows have equal texts iff (level, name) are equal."""
    spark, seed = df.sparkSession, 0
    while True:
        contents = _contents(df, text, block, seed).repartition(shuffle_partitions(spark), "h1", "h2")
        names = scratch.store(_numbered(contents.sortWithinPartitions("h1", "h2", "block")), "names")
        free(spark)
        if not names.where("clash").limit(1).count():
            break
        seed += 1
    refs = scratch.store(_references(df, key, text, block, seed), "references")
    refs = refs.join(names.select("h1", "h2", "name"), ["h1", "h2"]).select("_row", "pos", "n", "name", key, "sha")
    level, state = 0, scratch.store(refs, "level0")
    scratch.drop("references", "names")
    ids = state.where("pos = 0").select("_row", key, "sha")
    done = state.where("n = 1").select("_row", F.lit(0).alias("level"), "name")
    left = state.where("n > 1").select("_row", "pos", "n", "name")
    while left.limit(1).count():
        level, held = level + 1, f"level{level}"
        half = F.expr("pos div 2").cast("int")
        pairs = left.groupBy("_row", half.alias("pos"), F.expr("(n + 1) div 2").cast("int").alias("n")).agg(
            F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("l"), F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("r")
        )
        pairs = scratch.store(pairs, f"pairs{level}")
        numbered = pairs.select("l", "r").distinct().sortWithinPartitions("l", "r").withColumn("name", F.monotonically_increasing_id())
        numbered = scratch.store(numbered, f"numbers{level}")
        now = scratch.store(pairs.join(numbered, ["l", "r"]).select("_row", "pos", "n", "name"), f"level{level}")
        scratch.drop(f"pairs{level}", f"numbers{level}", *[held] * (level > 1))
        done = done.unionByName(scratch.store(now.where("n = 1").select("_row", F.lit(level).alias("level"), "name"), f"done{level}"))
        left = now.where("n > 1")
    out = scratch.store(ids.join(done, "_row"), "identities")
    scratch.drop("level0", *[f"level{level}"] * (level > 0), *[f"done{k}" for k in range(1, level + 1)])
    return out


def mark(df: DataFrame, key: str = "doc_id", text: str = "text", block: int = 1024) -> DataFrame:
    """One row a document: the key, keep_id, group_size, kept, text_sha256."""
    scratch = Scratch(df.sparkSession, "exactdup")
    each = identities(df, scratch, key, text, block)
    groups = each.groupBy("level", "name").agg(F.max(F.struct(key, "_row")).alias("best"), F.count("*").alias("group_size"))
    groups = scratch.store(groups, "groups")  # so that Spark may split a hot group's side of the join
    both = each.join(groups, ["level", "name"])
    return both.select(key, F.col(f"best.{key}").alias("keep_id"), "group_size", (F.col("_row") == F.col("best._row")).alias("kept"), F.col("sha").alias("text_sha256"))


def dedup(df: DataFrame, key: str = "doc_id", text: str = "text", block: int = 1024) -> DataFrame:
    """The rows that stay, with all their columns."""
    scratch = Scratch(df.sparkSession, "exactdup-kept")
    kept = scratch.store(mark(df, key, text, block).where("kept").select(F.col(key).alias("_treefold_k")), "kept").distinct()
    marks = df.groupBy(key).count().where("count > 1").select(F.col(key).alias("_treefold_k"))
    stay = df.join(kept, F.col(key).eqNullSafe(F.col("_treefold_k")), "left_semi")
    if not marks.limit(1).count():
        return stay
    # keys that occur more than once: equal texts among them stand once, and only if that text was kept
    often = stay.join(marks, F.col(key).eqNullSafe(F.col("_treefold_k")), "left_semi").withColumn("_treefold_t", fold_ascii(F.col(text)))
    single = stay.join(marks, F.col(key).eqNullSafe(F.col("_treefold_k")), "left_anti")
    held = mark(df, key, text, block).where("kept").select(F.col(key).alias("_treefold_k"), F.col("text_sha256").alias("_treefold_s"))
    often = often.join(held, F.col(key).eqNullSafe(F.col("_treefold_k")) & (F.sha2(F.col("_treefold_t"), 256) == F.col("_treefold_s")), "left_semi")
    return single.unionByName(often.dropDuplicates([key, "_treefold_t"]).drop("_treefold_t"))
