"""Best-fit packing by a grouping genetic algorithm on islands.

An individual is a partition of documents into bins (sequences), and the bins are its genes. Crossover injects whole
well-filled bins of one parent into the other, removes the documents that now stand twice, and best-fits the documents
this displaces. The pieces are dealt by hash to shards of bounded size; several islands evolve each shard, start from
differently ordered best-fit packings, make a fixed number of generations (`generations`) an epoch, and after every epoch
hand their elite to the next island. Fewer bins are fitter, and of as many bins those whose slack lies in the fewest of
them: the emptiest bins of all shards (one in 64, at least one, and up to half of them while they are filled to less than
`loose`) are pooled and packed again, until the pool fits one shard.

Only lengths travel; the work in a task is bounded by the shard's size. Null texts count as empty (one token, the
separator). Longer documents are cut into pieces of exactly `room` tokens, which are sequences of their own. Repeated
rows and repeated ids are packed row by row. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from treefold.llm import wordbpe
from treefold.llm.common import Scratch, only

SEPARATOR = 1


def pieces(df: DataFrame, path: str, room: int = 4096, key: str = "doc_id", text: str = "text", ids: bool = False) -> DataFrame:
    """One row a piece: _row (unique), the key, piece, start, length, ids_crc32, and on request the ids. No shuffle."""
    key_type = df.schema[key].dataType.simpleString()
    end = array("I", [SEPARATOR]).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, row = wordbpe.load(path, library=True), TaskContext.get().partitionId() << 40
        for batch in batches:
            at, out = [], {k: [] for k in ("_row", "piece", "start", "length", "ids_crc32")} | ({"ids": []} if ids else {})
            for i, x in enumerate(batch.column(1)):
                data = bpe.encode(x.as_py()) + end
                for n, start in enumerate(range(0, len(data), 4 * room)):
                    part = data[start : start + 4 * room]
                    at.append(i)
                    for k, v in (("_row", row), ("piece", n), ("start", start // 4), ("length", len(part) // 4), ("ids_crc32", zlib.crc32(part))):
                        out[k].append(v)
                    if ids:
                        out["ids"].append(array("I", part).tolist())
                    row += 1
            kinds = {"piece": pa.int32(), "ids": pa.list_(pa.int32())}
            cols = {k: pa.array(v, kinds.get(k, pa.int64())) for k, v in out.items()}
            yield pa.RecordBatch.from_arrays([cols.pop("_row"), batch.column(0).take(pa.array(at, pa.int64())), *cols.values()], names=["_row", key, *[k for k in out if k != "_row"]])

    schema = f"_row long, `{key}` {key_type}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * ids
    return only(df, key, text).mapInArrow(run, schema)


# --- one island


class Packing(NamedTuple):
    """The bin of each item, and how full each bin is."""

    label: np.ndarray
    fill: np.ndarray


def best_fit(lengths: np.ndarray, order: np.ndarray, held: Packing, room: int) -> Packing:
    """Puts the items of `order` one by one into the fullest bin that holds them."""
    fill, at = held.fill.tolist(), []
    free = sorted((room - f, k) for k, f in enumerate(fill) if f < room)
    for x in lengths[order].tolist():
        i = bisect_left(free, (x, -1))
        if i == len(free):
            left, k = room, len(fill)
            fill.append(0)
        else:
            left, k = free.pop(i)
        at.append(k)
        fill[k] += x
        if left > x:
            insort(free, (left - x, k))
    label = held.label.copy()
    label[order] = at
    return Packing(label, np.array(fill, np.int64))


def from_nothing(lengths: np.ndarray, order: np.ndarray, room: int) -> Packing:
    return best_fit(lengths, order, Packing(np.zeros(len(lengths), np.int32), np.empty(0, np.int64)), room)


def read_labels(lengths: np.ndarray, label: np.ndarray) -> Packing:
    return Packing(label, np.bincount(label, lengths).astype(np.int64))


def longest_first(lengths: np.ndarray, items: np.ndarray) -> np.ndarray:
    return items[np.lexsort((items, -lengths[items]))]


def fitness(held: Packing, room: int) -> tuple[int, float]:
    """Fewer bins first; then the sum of squared fillings, which favours full bins beside emptier ones."""
    return -len(held.fill), float(((held.fill / room) ** 2).sum())


def without(held: Packing, gone: np.ndarray) -> tuple[Packing, np.ndarray]:
    """The packing without the bins `gone`, and the items they held (whose labels mean nothing until they are placed)."""
    stay = np.ones(len(held.fill), bool)
    stay[gone] = False
    return Packing((np.cumsum(stay) - 1)[held.label].astype(np.int32), held.fill[stay]), np.flatnonzero(~stay[held.label])


def crossover(lengths: np.ndarray, a: Packing, b: Packing, room: int, rng: np.random.Generator, share: float = 1 / 128) -> Packing:
    """Whole well-filled bins of b go into a; the bins of a that hold any of their documents are dissolved, so that none
    stands twice, and what else those held is best-fitted, longest first."""
    n = len(b.fill)
    filled = np.argsort(-b.fill, kind="stable")[: max(1, n // 2)]
    chosen = np.sort(rng.choice(filled, max(1, int(n * share)), replace=False)) if len(filled) > 1 else filled
    come = np.isin(b.label, chosen)
    left, loose = without(a, np.unique(a.label[come]))
    label = left.label
    label[come] = len(left.fill) + np.searchsorted(chosen, b.label[come])
    return best_fit(lengths, longest_first(lengths, loose[~come[loose]]), Packing(label, np.concatenate((left.fill, b.fill[chosen]))), room)


def mutate(lengths: np.ndarray, held: Packing, room: int, rng: np.random.Generator) -> Packing:
    """Dissolves the emptiest bins and a few others, and best-fits their documents in a random order."""
    n = len(held.fill)
    gone = np.union1d(np.argsort(held.fill, kind="stable")[: max(1, n // 100)], np.flatnonzero(rng.random(n) < 0.01))
    left, loose = without(held, gone)
    return best_fit(lengths, rng.permutation(loose), left, room)


def evolve(lengths: np.ndarray, room: int, start: list[Packing], seed: int, population: int, generations: int) -> tuple[Packing, int, int]:
    """The best packing that one island finds in one epoch, how many crossovers it made, and how many of their children were
    better than all before. The number of generations is fixed: where no bin can be saved, the slack still gathers in the
    emptiest bins, whose documents are packed again with those of other shards."""
    rng, pool = np.random.default_rng(seed), list(start)
    every = np.arange(len(lengths))
    while len(pool) < population:
        weight = lengths * (1 + 0.1 * rng.random(len(lengths))) if pool or seed % 2 else lengths
        pool.append(from_nothing(lengths, every[np.lexsort((every, -weight))], room))
    scored = sorted(((fitness(x, room), k, x) for k, x in enumerate(pool)), key=lambda t: t[:2], reverse=True)
    won = 0
    for g in range(generations):
        i, j = rng.choice(len(scored), 2, replace=False) if len(scored) > 1 else (0, 0)
        child = crossover(lengths, scored[i][2], scored[j][2], room, rng)
        if g % 2:
            child = mutate(lengths, child, room, rng)
        score = fitness(child, room)
        won += score > scored[0][0]
        if score > scored[-1][0]:
            scored[-1] = (score, len(pool) + g, child)
            scored.sort(key=lambda t: t[:2], reverse=True)
    return scored[0][2], generations, won


# --- shards and islands


def pack_lengths(rows: DataFrame, scratch: Scratch, room: int, shard_rows: int, islands: int, epochs: int, population: int, generations: int, seed: int, name: str, stats: dict | None = None) -> DataFrame:
    """rows (_row, length) to (_row, length, shard, bin), stored. stats: gets the sums of crossovers made and won."""
    n = rows.count()
    shards = max(1, -(-n // shard_rows))
    dealt = rows.groupBy(F.pmod(F.xxhash64("_row", F.lit(seed)), F.lit(shards)).alias("shard")).agg(F.sort_array(F.collect_list(F.struct("_row", "length"))).alias("x"))
    none = F.expr("cast(array() as array<int>)")
    state = dealt.select(
        "shard", F.col("x._row").alias("rows"), F.col("x.length").alias("lengths"), F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), none.alias("own"), none.alias("come"),
        *[F.lit(0).alias(c) for c in ("crossed", "won", "bins")], F.lit(0.0).alias("full"),
    )
    state = state.repartition(max(1, min(shards * islands, 4096)), "shard", "island")

    def epoch(k: int):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                out = {c: [] for c in ("own", "crossed", "won", "bins", "full")}
                for shard, island, lengths, own, come, c, w in zip(pdf["shard"], pdf["island"], pdf["lengths"], pdf["own"], pdf["come"], pdf["crossed"], pdf["won"]):
                    lengths = np.asarray(lengths, np.int64)
                    start = [read_labels(lengths, np.asarray(x, np.int32)) for x in (own, come) if len(x)]
                    got = evolve(lengths, room, start, seed * 1_000_003 + int(shard) * 1009 + int(island) * 31 + k, population, generations)
                    bins, full = fitness(got[0], room)
                    for key, x in zip(out, (got[0].label.astype(np.int32), c + got[1], w + got[2], -bins, full)):
                        out[key].append(x)
                yield pdf.assign(**out)

        return run

    done = state
    for k in range(epochs):
        done = scratch.store(done.mapInPandas(epoch(k), done.schema), f"{name}-epoch{k}")
        if k:
            scratch.drop(f"{name}-epoch{k - 1}")
        if k + 1 < epochs:  # the elite of each island goes to the next one
            elite = done.select("shard", ((F.col("island") + 1) % islands).cast("int").alias("island"), F.col("own").alias("come"))
            done = done.drop("come").join(elite, ["shard", "island"]).select(*state.columns)
    if stats is not None:
        for key, x in done.agg(F.sum("crossed").alias("crossed"), F.sum("won").alias("won")).first().asDict().items():
            stats[key] = stats.get(key, 0) + (x or 0)
    # of a shard's islands the fittest
    first = done.groupBy("shard").agg(F.max_by(F.struct("rows", "lengths", "own"), F.struct(-F.col("bins"), F.col("full"), -F.col("island"))).alias("b"))
    flat = first.select("shard", F.explode(F.arrays_zip("b.rows", "b.lengths", "b.own")).alias("z"))
    out = scratch.store(flat.select(F.col("z.rows").alias("_row"), F.col("z.lengths").alias("length"), "shard", F.col("z.own").alias("bin")), f"{name}-bins")
    scratch.drop(f"{name}-epoch{epochs - 1}")
    return out


def pack(found: DataFrame, scratch: Scratch, room: int = 4096, shard_rows: int = 8192, islands: int = 3, epochs: int = 2, population: int = 4, generations: int = 48, seed: int = 7, loose: float = 0.98, stats: dict | None = None) -> DataFrame:
    """found: stored pieces with _row and length. Adds sequence_id (the smallest _row in the sequence) and offset."""
    rest, placed, level, before = found.where(F.col("length") < room).select("_row", "length"), [], 0, None
    while n := rest.count():
        bins = pack_lengths(rest, scratch, room, shard_rows, islands, epochs, population, generations, seed + level, f"level{level}", stats)
        bins = bins.withColumn("seq", F.concat_ws("-", F.lit(level), "shard", "bin"))
        if n <= shard_rows or n == before:  # one shard, or shards of one bin each
            placed.append(bins)
            break
        fill = bins.groupBy("shard", "seq").agg(F.sum("length").alias("fill"))
        order = Window.partitionBy("shard").orderBy("fill", "seq")  # a shard holds about shard_rows pieces
        place = fill.select("seq", "fill", F.row_number().over(order).alias("k"), F.count("*").over(Window.partitionBy("shard")).alias("m"))
        pooled = f"k = 1 or k <= m div 64 or (k <= m div 2 and fill < {loose} * {room})"
        emptiest = scratch.store(place.where(pooled).select("seq"), f"level{level}-emptiest")
        placed.append(bins.join(emptiest, "seq", "left_anti"))
        rest, level, before = bins.join(emptiest, "seq", "left_semi").select("_row", "length"), level + 1, n
    alone = found.where(F.col("length") >= room).select("_row", F.col("_row").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    if placed:
        every = placed[0]
        for x in placed[1:]:
            every = every.unionByName(x)
        w = Window.partitionBy("seq")  # a sequence holds `room` pieces at most
        ahead = F.sum("length").over(w.orderBy("_row").rowsBetween(Window.unboundedPreceding, -1))
        alone = alone.unionByName(every.select("_row", F.min("_row").over(w).alias("sequence_id"), F.coalesce(ahead, F.lit(0)).cast("long").alias("offset")))
    return found.join(alone, "_row").drop("_row")


def run(df: DataFrame, path: str, room: int = 4096, ids: bool = False, **how) -> DataFrame:
    """Documents to packed pieces: key, piece, start, length, ids_crc32, (ids,) sequence_id, offset."""
    scratch = Scratch(df.sparkSession, "packing")
    return pack(scratch.store(pieces(df, path, room, ids=ids), "pieces"), scratch, room, **how)


def sequences(packed: DataFrame) -> DataFrame:
    """The token sequences themselves, from run(ids=True): sequence_id, ids."""
    inner = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"]))
    return packed.groupBy("sequence_id").agg(inner.alias("ids"))
