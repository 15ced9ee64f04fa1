"""Approximate nearest neighbours by inner product, over learned partitions.

On a bounded sample the graph of nearest neighbours is built and cut into balanced parts, so that neighbours share a
part. A small classifier (softmax regression) learns to tell a vector's part; it assigns every vector of the table to a
part and routes every query to its most probable parts, whose vectors are ranked by the exact inner product.

The sample is the only bounded thing: every vector is indexed and every query searched. Of several numbers of parts the one
is taken with which a query is expected to cost least: the vectors of the parts it probes, of all there are, and what it
takes to send it there. So parts grow with the table as far as the vectors have a structure that more parts can use. A
part's vectors are dealt by hash to blocks of bounded size, and so are the queries routed to it; a task ranks one block of
queries against one block of vectors and returns `top` rows a query at most. Only the classifier is shipped to all tasks.
Queries that find fewer than `top` in their parts are asked again of all parts.

Vectors that are null, zero, or hold nulls or non-finite components take no part, nor do those of another length than most
have (of equally many, the shortest). Products beyond the range of a double count as infinite. Rows that share an id are
separate candidates and separate queries, each with a ranking of its own, but no row with a query's id is a candidate of
that query. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treefold.llm.common import Scratch, hash_sample, only


def usable(v: Column) -> Column:
    """A vector without null or non-finite components, and not zero."""
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return v.isNotNull() & F.coalesce(fine, F.lit(False)) & F.exists(v, lambda x: x != 0)


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """The k nearest of each row by inner product, without itself."""
    out = np.empty((len(x), k), np.int64)
    for at in range(0, len(x), 1024):
        s = x[at : at + 1024] @ x.T
        s[np.arange(len(s)), np.arange(at, at + len(s))] = -np.inf
        out[at : at + 1024] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, slack: float = 1.15, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """A part for each row: spherical clusters to begin with, then rows move to where most of their neighbours are, as
    long as no part exceeds its share by `slack`."""
    rng, n = np.random.default_rng(seed), len(x)
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)  # a scaled vector may vanish
    centre = unit[rng.choice(n, parts, replace=False)]
    room = int(np.ceil(n / parts * slack))
    for _ in range(rounds):
        label = _fill(unit @ centre.T, room)
        centre = np.stack([unit[label == p].sum(0) if (label == p).any() else unit[rng.integers(n)] for p in range(parts)])
        centre /= np.maximum(np.linalg.norm(centre, axis=1, keepdims=True), 1e-12)
    for _ in range(rounds):
        votes = np.zeros((n, parts))
        np.add.at(votes, (np.repeat(np.arange(n), graph.shape[1]), label[graph].ravel()), 1.0)
        np.add.at(votes, (graph.ravel(), np.repeat(label, graph.shape[1])), 1.0)
        votes[np.arange(n), label] += 0.5
        moved = _fill(votes, room)
        if (moved == label).all():
            break
        label = moved
    return label


def _fill(score: np.ndarray, room: int) -> np.ndarray:
    """Every row to its best part with room left; rows that lose most by waiting go first."""
    order = np.argsort(-score, axis=1, kind="stable")
    ranked = np.take_along_axis(score, order, axis=1)
    gain = ranked[:, 0] - (ranked[:, 1] if score.shape[1] > 1 else 0)
    left, label = np.full(score.shape[1], room), np.empty(len(score), np.int64)
    for i in np.argsort(-gain, kind="stable"):
        for p in order[i]:
            if left[p] > 0:
                label[i] = p
                left[p] -= 1
                break
    return label


def train(x: np.ndarray, label: np.ndarray, parts: int, steps: int = 300, rate: float = 0.2) -> np.ndarray:
    """Softmax regression (weights and intercept) by Adam."""
    y = np.hstack((x, np.ones((len(x), 1)))).astype(np.float32)
    w, m, v = (np.zeros((y.shape[1], parts), np.float32) for _ in range(3))
    goal = np.zeros((len(x), parts), np.float32)
    goal[np.arange(len(x)), label] = 1
    for t in range(1, steps + 1):
        z = y @ w
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        g = y.T @ (goal - p) / len(x) - 1e-5 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w + rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w.astype(np.float64)


def probes_for(x: np.ndarray, near: np.ndarray, w: np.ndarray, recall: float) -> int:
    """The least number of parts in which the sample's own nearest are found at the wanted recall."""
    z = x @ w[:-1] + w[-1]
    own, place = z.argmax(axis=1), np.empty(z.shape, np.int64)
    np.put_along_axis(place, np.argsort(-z, axis=1, kind="stable"), np.arange(z.shape[1])[None, :], axis=1)
    ranks = np.take_along_axis(place, own[near], axis=1)
    return int(np.quantile(ranks, recall, method="higher")) + 1


class Router(NamedTuple):
    """The classifier's weights, the number of parts to probe, and what vectors are multiplied with before."""

    weights: np.ndarray | None
    probes: int
    scale: float = 1.0

    def ranked(self, v: np.ndarray, probes: int) -> np.ndarray:
        """The `probes` most probable parts of each vector, the best first."""
        if self.weights is None:
            return np.zeros((len(v), 1), np.int32)
        return np.argsort(-((v * self.scale) @ self.weights[:-1] + self.weights[-1]), axis=1, kind="stable")[:, :probes].astype(np.int32)


#: What sending a query to one more part costs, in vectors that it is compared with.
SENT = 256


def fit(rows: DataFrame, n: int, fit_rows: int = 8000, parts: int | None = None, neighbours: int = 10, top: int = 20, recall: float = 0.96) -> Router:
    """rows (id, v), n of them, to the router. Without `parts`, 32, 128 and, from a million rows on, 512 are tried."""
    sample = hash_sample(rows, "id", fit_rows).toPandas().sort_values("id", kind="stable")
    if len(sample) < 2:
        return Router(None, 1)
    x = np.stack(sample["v"].to_numpy()).astype(np.float64)
    most = np.abs(x).max()
    scale = 1.0 if 1e-100 < most < 1e100 else 1 / most
    x = x * scale
    if n <= top + 1:  # all candidates are wanted
        recall = 1.0
    graph, near = (neighbour_graph(x, min(k, len(x) - 1)) for k in (neighbours, top))
    found = []
    for p in [parts] if parts else (32, 128, 512) if n >= 1_000_000 else (32, 128):
        p = max(2, min(p, len(x) // 16))
        if p not in [len(w[0]) for _, w, _ in found]:
            w = train(x, balanced_parts(x, graph, p), p)
            probes = probes_for(x, near, w, recall)
            found.append((probes / p * n + SENT * probes, w, probes))
    _, w, probes = min(found, key=lambda f: f[0])
    return Router(w, probes, scale)


def route(rows: DataFrame, router: Router, probes: int, kept: str) -> DataFrame:
    """rows (id, v) with their `probes` most probable parts, the best first. kept: one more long column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = router.ranked(np.stack(batch.column(1).to_numpy(zero_copy_only=False)).astype(np.float64), probes) if len(batch) else []
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(parts), pa.list_(pa.int32()))], names=["id", "v", kept, "parts"])

    return rows.select("id", "v", kept).mapInArrow(run, f"id long, v array<double>, {kept} long, parts array<int>")


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of all rows; where they could leave the range of a double, from rows scaled by powers of two."""
    if np.abs(q).max() * x.shape[1] < 1e300 / max(np.abs(x).max(), 1):
        return q @ x.T
    (a, i), (b, j) = _halved(q), _halved(x)
    with np.errstate(over="ignore"):
        return np.ldexp(a @ b.T, i[:, None] + j[None, :])


def _halved(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows divided by a power of two such that their largest component is below 1, and its exponent."""
    e = np.frexp(np.abs(x).max(axis=1))[1]
    return np.ldexp(x, -e[:, None]), e


def scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The inner products of one vector with the rows of x, each summed in the same way."""
    with np.errstate(over="ignore", invalid="ignore"):
        out = (x * q).sum(axis=1)
    if np.isfinite(out).all():
        return out
    (a, i), (b, j) = _halved(q[None, :]), _halved(x)
    with np.errstate(over="ignore"):
        return np.ldexp((b * a).sum(axis=1), i + j)


def rank_block(ids: np.ndarray, q: np.ndarray, theirs: np.ndarray, x: np.ndarray, top: int) -> tuple[list, list, list]:
    """The `top` best of the vectors x (ids `theirs`) for each query: its position, the id, the score."""
    order = np.argsort(theirs, kind="stable")
    theirs, x, out = theirs[order], x[order], ([], [], [])
    for at in range(0, len(q), 256):
        mine, some = ids[at : at + 256], q[at : at + 256]
        s = products(some, x)
        other = mine[:, None] != theirs[None, :]
        s[~other] = -np.inf
        kth = -np.partition(-s, top - 1, axis=1)[:, top - 1] if s.shape[1] > top else np.full(len(some), -np.inf)
        # products of one kernel may differ in their last bits: all near the edge are scored again, alike
        edge = np.where(np.isfinite(kth), kth - 1e-9 * (1 + np.abs(kth)), kth)
        for r in range(len(some)):
            near = np.flatnonzero((s[r] >= edge[r]) & other[r])
            score = scores(some[r], x[near])
            best = np.lexsort((theirs[near], -score))[:top]
            out[0].extend([at + r] * len(best))
            out[1].extend(theirs[near][best].tolist())
            out[2].extend(score[best].tolist())
    return out


def compared(held: DataFrame, asked: DataFrame, top: int, block: int) -> DataFrame:
    """held (id, v, part) and asked (id, v, row, part) to row, query_id, id, score: the best of each block of vectors for each query."""
    blocks = lambda x, name: x.groupBy("part").agg(F.ceil(F.count("*") / block).cast("int").alias(name))
    shape = F.broadcast(blocks(held, "m").join(blocks(asked, "n"), "part"))  # one row a part
    own = lambda name, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.col(name)).cast("int")
    left = held.join(shape, "part").select("part", own("m", 1).alias("i"), F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("j"), F.lit(None).cast("long").alias("row"), "id", "v")
    right = asked.join(shape, "part").select("part", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("i"), own("n", 2).alias("j"), "row", "id", "v")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        asks, out = pdf["row"].notna().to_numpy(), ([], [], [])
        v, ids = pdf["v"].to_numpy(), pdf["id"].to_numpy()
        if asks.any() and not asks.all():
            out = rank_block(ids[asks], np.stack(v[asks]), ids[~asks], np.stack(v[~asks]), top)
        at = np.array(out[0], np.int64)
        return pd.DataFrame({"row": pdf["row"].to_numpy()[asks][at].astype(np.int64), "query_id": ids[asks][at], "id": np.array(out[1], np.int64), "score": np.array(out[2], np.float64)})

    return left.unionByName(right).groupBy("part", "i", "j").applyInPandas(run, "row long, query_id long, id long, score double")


def search(df: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", top: int = 20, parts: int | None = None, probes: int | None = None, recall: float = 0.96, fit_rows: int = 8000, block: int = 4096) -> DataFrame:
    """query_id, rank (from 1), the key, score: the `top` nearest found rows of df for every row of queries. Without
    `probes`, as many parts are probed as the sample needs for the wanted recall."""
    scratch = Scratch(df.sparkSession, "ann")
    clean = lambda x: only(x, key, vector).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where(usable(F.col("v")) & F.col("id").isNotNull())
    rows, asked = clean(df), clean(queries)
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"))
    usual = sizes.agg(F.max(F.struct("n", -F.col("d"))).alias("m")).select("m.*").first()
    n, d = usual[0] or 0, -(usual[1] or 0)
    rows, asked = (x.where(F.size("v") == d) for x in (rows, asked))
    router = fit(rows, n, fit_rows, parts, top=top, recall=recall)
    held = scratch.store(route(rows.withColumn("none", F.lit(None).cast("long")), router, 1, "none").select("id", "v", F.col("parts")[0].alias("part")), "held")
    asked = scratch.store(route(asked.withColumn("row", F.monotonically_increasing_id()), router, 1 << 30, "row"), "asked")
    some = asked.select("id", "v", "row", F.explode(F.slice("parts", 1, probes or router.probes)).alias("part"))
    best = Window.partitionBy("row").orderBy(F.desc("score"), "id")
    first = lambda found: found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    ranked = scratch.store(first(compared(held, some, top, block)), "ranked")
    several = held.groupBy("id").agg(F.count("*").alias("c"))  # rows that share a query's id are none of its candidates
    enough = asked.select("row", "id").join(ranked.groupBy("row").agg(F.count("*").alias("k")), "row", "left").join(several, "id", "left")
    short = scratch.store(enough.where(F.coalesce("k", F.lit(0)) < F.least(F.lit(top), F.lit(n) - F.coalesce("c", F.lit(0)))).select("row"), "short")
    if short.limit(1).count():
        again = asked.join(short, "row").select("id", "v", "row", F.explode("parts").alias("part"))
        ranked = ranked.join(short, "row", "left_anti").unionByName(first(compared(held, again, top, block)))
    return ranked.select("query_id", "rank", F.col("id").alias(key), "score")
