"""Toxicity by cumulative-link ordinal regression.

P(grade <= k) = sigmoid(theta_k - w.x), with one weight vector w for all thresholds theta_1 < theta_2. The result is the
expected severity, the sum of P(grade > k). Features are sparse: whether a word, or a word with a certain beginning, occurs in the text.

Labels only say toxic or not, so the grades are built from them: 0 for label 0; a toxic document gets grade 2 if the share
of its words (repetitions count) that are typical of toxic labels is above the median of toxic documents, else 1. Which
words are typical is learned from the other half of the sample, so a row's label takes no part in its own grade; and the
features, which say only whether a word occurs, know neither repetitions nor a text's length.

The model is fitted on a bounded sample of labelled rows (`fit_rows`, a parameter). Its words are all that tell the labels
apart in that sample by a likelihood ratio of `ratio`, and occur in `least` rows. Half the sample at most is of one label; a
row weighs as many labelled rows as it stands for, so that the thresholds are those of all labelled rows. Scoring reads
every whole text and needs no shuffle. Null and empty texts have no features and get the
severity of the thresholds alone. Without labels of both kinds everything has severity 0. Repeated rows are scored
each. Extra columns are ignored by severity(), and kept by keep().
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treefold.llm.common import held, only, weighted_sample
from treefold.llm.wordbpe import Cache

LETTERS = re.compile(r"[^\W\d_]+")


def parts(word: str) -> list[str]:
    """A word's features: the word itself and, marked, its beginnings of 4 to 7 letters, which inflected forms share."""
    return [word, *[word[:k] + "*" for k in range(4, min(8, len(word)))]]


def bag(text: str | None) -> set[str]:
    """The features that occur in a text; words are runs of letters, lower-cased."""
    return {f for w in set(LETTERS.findall((text or "").lower())) for f in parts(w)}


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class Scorer:
    """The chances P(grade > k) of whole texts. A worker keeps it, with what it knows of at most 300,000 chunks."""

    def __init__(self, model: Ordinal | None):
        self.model, weight = model, model.weight if model else {}
        starts = {f.rstrip("*")[:4] for f in weight}  # most words share no feature's beginning

        def hits(chunk: bytes) -> tuple:
            found = LETTERS.findall(chunk.decode("utf-8", "replace").lower())
            return tuple({f for w in found if w[:4] in starts for f in parts(w) if f in weight})

        self.hits = Cache(hits, 300_000)

    @classmethod
    def of(cls, model: Ordinal | None) -> Scorer:
        return held(("toxicity", model and model.name), lambda: cls(model))

    def above(self, text: str | None) -> np.ndarray:
        if not self.model:
            return np.zeros(2)
        found: set[str] = set()
        for hit in map(self.hits.__getitem__, set((text or "").encode().split())):
            if hit:
                found.update(hit)
        return self.model.above(sum(self.model.weight[w] for w in sorted(found)))


class Ordinal:
    def __init__(self, words: list[str], weights: np.ndarray, thresholds: np.ndarray):
        self.words, self.weights, self.thresholds = words, weights, thresholds
        self.weight, self.name = {w: float(x) for w, x in zip(words, weights) if x}, uuid.uuid4().hex

    def above(self, z: float) -> np.ndarray:
        """P(grade > k) for each threshold."""
        return _sigmoid(z - self.thresholds)


def fit_ordinal(ids: list[np.ndarray], d: int, y: np.ndarray, grades: int, steps: int = 400, rate: float = 0.1, decay: float = 1e-4, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Weights and increasing thresholds by maximum likelihood with a small L2 penalty (Adam on the whole batch). ids: the
    features that each row has, of d. weight: how many rows each row stands for, 1 by default."""
    n = len(ids)
    row, column = np.repeat(np.arange(n), [len(i) for i in ids]), np.concatenate([np.empty(0, np.int64), *ids]).astype(np.int64)
    weight = np.ones(n) if weight is None else weight / weight.mean()
    share = np.array([(weight * (y > k)).mean() for k in range(grades - 1)]).clip(1e-3, 1 - 1e-3)
    base = np.log((1 - share) / share)
    p = np.concatenate((np.zeros(d), [base[0]], np.log(np.maximum(np.diff(base), 0.1))))
    m, v = np.zeros_like(p), np.zeros_like(p)
    for t in range(1, steps + 1):
        theta = p[d] + np.concatenate(([0.0], np.cumsum(np.exp(p[d + 1 :]))))
        cut = np.concatenate(([-np.inf], theta, [np.inf]))
        z = np.bincount(row, p[column], n)
        hi, lo = _sigmoid(cut[y + 1] - z), _sigmoid(cut[y] - z)
        hi, lo = np.where(y == grades - 1, 1.0, hi), np.where(y == 0, 0.0, lo)
        chance = np.maximum(hi - lo, 1e-9)
        dhi, dlo = weight * hi * (1 - hi) / chance, weight * lo * (1 - lo) / chance
        slope = np.zeros(grades - 1)  # of the likelihood by each threshold
        np.add.at(slope, y[y < grades - 1], dhi[y < grades - 1])
        np.add.at(slope, y[y > 0] - 1, -dlo[y > 0])
        grad = np.concatenate((np.bincount(column, (dlo - dhi)[row], d) / n - decay * p[:d], [slope.sum() / n], [slope[k + 1 :].sum() * np.exp(p[d + 1 + k]) / n for k in range(grades - 2)]))
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        p = p + rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return p[:d], p[d] + np.concatenate(([0.0], np.cumsum(np.exp(p[d + 1 :]))))


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = 8000, least: int = 3, ratio: float = 10.0) -> Ordinal | None:
    """docs (doc_id, text) and labels (doc_id, toxic) to a model; None without labels of both kinds."""
    lab = only(labels, "doc_id", "toxic").where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    samples, stands_for = zip(*(weighted_sample(lab.where(F.col("toxic") == t), "doc_id", fit_rows // 2) for t in (0, 1)))
    sampled = F.broadcast(samples[0].unionByName(samples[1]).withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit(29)), F.lit(2)).cast("int")))  # fit_rows rows at most
    rows = only(docs, "doc_id", "text").where("text is not null").join(sampled, "doc_id").select("text", "toxic", "half")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got, kind, part = [], [], []
            for x, t, h in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                found = bag(x.as_py())
                got += found
                kind += [t] * len(found)
                part += [h] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(got, pa.string()), pa.array(kind, pa.int32()), pa.array(part, pa.int32())], names=["w", "toxic", "half"])

    sizes = {(r["toxic"], r["half"]): r["n"] for r in rows.groupBy("toxic", "half").agg(F.count("*").alias("n")).collect()}
    n = [sum(v for k, v in sizes.items() if k[0] == t) for t in (0, 1)]
    if not n[0] or not n[1]:
        return None
    each = {f"c{t}{h}": F.count(F.when((F.col("toxic") == t) & (F.col("half") == h), 1)) for t in (0, 1) for h in (0, 1)}
    df = rows.mapInArrow(words, "w string, toxic int, half int").groupBy("w").agg(*[c.alias(k) for k, c in each.items()])
    df = df.withColumn("bad", F.col("c10") + F.col("c11")).withColumn("good", F.col("c00") + F.col("c01"))
    # likelihood-ratio statistic of the word against the labels: chance alone seldom gives 10
    rate, n_word = n[1] / (n[0] + n[1]), F.col("bad") + F.col("good")
    part = lambda c, share: F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) / (n_word * share))).otherwise(0.0)
    best = df.where(n_word >= least).where(2 * (part("bad", rate) + part("good", 1 - rate)) >= ratio).orderBy("w").collect()
    vocabulary = [r["w"] for r in best]
    number = {w: i for i, w in enumerate(vocabulary)}
    # by half, the words typical of toxic labels in the other one
    odds = lambda r, h: np.log((r[f"c1{h}"] + 0.5) / (sizes.get((1, h), 0) + 1)) - np.log((r[f"c0{h}"] + 0.5) / (sizes.get((0, h), 0) + 1))
    typical = [{r["w"] for r in best if odds(r, 1 - h) > 2} for h in (0, 1)]

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, share = [], []
            for x, h in zip(batch.column(0), batch.column(2).to_pylist()):
                found = LETTERS.findall(x.as_py().lower())
                share.append(sum(not typical[h].isdisjoint(parts(w)) for w in found) / max(1, len(found)))
                ids.append([number[f] for f in bag(x.as_py()) if f in number])
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(ids, pa.list_(pa.int32())), pa.array(share, pa.float64())], names=["toxic", "ids", "share"])

    sample = rows.mapInArrow(sparse, "toxic int, ids array<int>, share double").toPandas()
    toxic, share = sample["toxic"].to_numpy(), sample["share"].to_numpy()
    y = np.where(toxic == 0, 0, np.where(share > np.median(share[toxic == 1]), 2, 1)).astype(np.int64)
    ids = [np.sort(i) for i in sample["ids"]]
    order = sorted(range(len(ids)), key=lambda i: (y[i], ids[i].tolist()))  # the same sums whatever order the rows came in
    weights, thresholds = fit_ordinal([ids[i] for i in order], len(vocabulary), y[order], 3, weight=np.where(y[order] > 0, stands_for[1], stands_for[0]))
    return Ordinal(vocabulary, np.where(np.abs(weights) < 0.05, 0, weights), thresholds)


def severity(docs: DataFrame, model: Ordinal | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: the key, severity (0 to 2), grade (the most likely), toxic (P(grade > 0) >= 0.5)."""
    key_type = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer.of(model)
        for batch in batches:
            out = [[], [], []]
            for x in batch.column(1):
                above = scorer.above(x.as_py())
                chances = -np.diff(np.concatenate(([1.0], above, [0.0])))
                out[0].append(float(above.sum()))
                out[1].append(int(chances.argmax()))
                out[2].append(bool(above[0] >= 0.5))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out[0], pa.float64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.bool_())], names=[key, "severity", "grade", "toxic"])

    return only(docs, key, text).mapInArrow(run, f"`{key}` {key_type}, severity double, grade int, toxic boolean")


def keep(docs: DataFrame, model: Ordinal | None, text: str = "text") -> DataFrame:
    """The rows that aren't toxic, with all their columns; no shuffle."""
    columns, at = docs.columns, docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer.of(model)
        for batch in batches:
            stay = [bool(scorer.above(x.as_py())[0] < 0.5) for x in batch.column(at)]
            yield pa.RecordBatch.from_arrays(batch.columns, names=columns).filter(pa.array(stay, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
