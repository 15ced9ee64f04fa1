"""From documents to packed training sequences: each stage's result is written as Parquet and read again by the next.

All stages but the last return the columns they got, whatever those are, in their order. In every stage null texts count as
empty ones, rows that share a doc_id are separate documents, and an empty table gives an empty one. Texts of any length are
worked on whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treefold.llm import exactdup, neardup, packing, substring, toxicity
from treefold.llm.common import Scratch

ORACLE_SQL = None  # a classifier and a packing aren't expressible; tests hold the stages against brute force


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxic documents go; the model is fitted on the labelled ones among them. Null and empty texts stay, equal rows share
    their fate, and without labels of both kinds all stay."""
    return toxicity.keep(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, null and empty ones included, the one with the largest doc_id stays (a null id is the smallest); of
    equal rows, one."""
    return exactdup.dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word shingles at a similarity of 0.8 or more, the least doc_id stays (a null id only if
    there is no other); of equal rows, one. Texts without words, null ones included, all stay."""
    return neardup.dedup(docs, size=5, percent=80)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in a repeated window of 35 go; all documents stay, unchanged where nothing repeats, null texts too. n_chars is
    the length of what is left. Rows that stand twice lose all such windows, as they repeat each other."""
    cut = substring.remove(docs, window=35)
    if "n_chars" not in docs.columns:
        return cut
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row a piece of a document, with its place in a sequence of at most 4096 tokens. Null and empty texts are one token,
    the separator; equal rows are packed each."""
    import public_tokenizers

    return packing.run(docs, public_tokenizers.path("word_bpe_49k.json"), room=4096)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", reject_toxic),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("substring_dedup", cut_repeated_passages),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    scratch, docs = Scratch(spark, "pipeline"), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.store(stage(spark, docs, sf_dir), name)
        if k:
            scratch.drop(STAGES[k - 1][0])
    return docs
