"""Quality by a linear-chain conditional random field over lines.

Every line is good or bad. A line's features are its own, its predecessor's and its successor's; a 2 x 2 table scores
neighbouring labels. Forward-backward gives each line's chance of being good; their mean, weighted by the lines' lengths,
is the document's quality, mapped to a score by a logistic curve fitted on the same sample, in which both labels count
as often as among all labelled documents.

Only documents are labelled. First every line gets its document's label, and the weights of a line's own features are
trained alone. The lines of bad documents that these take for good are then called good (unless they take all of a document's
lines for good), and the whole model is trained on that, so that the table learns how good and bad lines follow each other. It is
fitted on all lines of a bounded sample of documents (`fit_rows`); the driver holds 13 numbers a line of it. Scoring reads
every whole text, needs no shuffle, and works through a document's lines in vectors. Null and empty texts are one empty
line. Without labels of both kinds every score is 0.5. Repeated rows are scored each.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treefold.llm.common import only, weighted_sample

#: Classes of bytes: letter below 128, capital, digit, space, sentence mark, other mark, byte of a longer character.
CLASSES = np.array([3 if c in b" \t\r\x0b\x0c" else 2 if 48 <= c < 58 else 1 if 65 <= c < 91 else 0 if 97 <= c < 123 else 6 if c > 127 else 4 if c in b".,;:'?-" else 5 for c in range(256)], np.uint8)
OWN = 13


def lines_of(text: str | None) -> list[bytes]:
    return (text or "").encode().split(b"\n")


def own_features(lines: list[bytes]) -> np.ndarray:
    n = len(lines)
    data = np.frombuffer(b"\n".join(lines) + b"\n", np.uint8)
    size = np.fromiter(map(len, lines), np.int64, n)
    start = np.concatenate(([0], np.cumsum(size + 1)[:-1]))
    kind = CLASSES[data]
    share = np.stack([np.add.reduceat((kind == k).astype(np.int32), start) - (k == 5) for k in range(7)], axis=1)  # the line's end is class 5
    out = np.zeros((n, OWN))
    total = np.maximum(size, 1)[:, None]
    out[:, 0] = 1
    out[:, 1:8] = share / total
    out[:, 8] = np.log1p(size) / 8
    seen = Counter(lines)
    split = [x.split() for x in lines]
    out[:, 9] = [min(seen[x] - 1, 8) / 8 for x in lines]
    out[:, 10] = [len(set(w)) / len(w) if w else 1 for w in split]
    out[:, 11] = [np.log1p(len(w)) / 6 for w in split]
    out[:, 12] = size == 0
    return out


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """One row a line with the neighbours' features beside its own, and the lines' lengths."""
    own, length = own_and_length(text)
    return beside(own), length


def own_and_length(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    lines = lines_of(text)
    return own_features(lines), np.fromiter((len(x) + 1 for x in lines), np.float64, len(lines))


def beside(own: np.ndarray) -> np.ndarray:
    edge = np.zeros((1, OWN))
    return np.hstack((own, np.vstack((edge, own[:-1])), np.vstack((own[1:], edge))))


def marginals(unary: np.ndarray, table: np.ndarray) -> np.ndarray:
    """P(good) of each line, from unary scores (n, 2) and the table of neighbours, by forward-backward in logs."""
    n = len(unary)
    f, b = np.empty((n, 2)), np.zeros((n, 2))
    (u, v), (s, t) = table.tolist()
    x, y = unary[0].tolist()
    add = np.logaddexp
    f[0] = x, y
    rows = unary.tolist()
    from math import exp, log1p

    def lse(p: float, q: float) -> float:
        return p + log1p(exp(q - p)) if p >= q else q + log1p(exp(p - q))

    for i in range(1, n):
        x, y = rows[i][0] + lse(x + u, y + s), rows[i][1] + lse(x + v, y + t)
        f[i] = x, y
    x = y = 0.0
    for i in range(n - 2, -1, -1):
        p, q = rows[i + 1][0] + x, rows[i + 1][1] + y
        x, y = lse(p + u, q + v), lse(p + s, q + t)
        b[i] = x, y
    z = f + b
    return np.exp(z[:, 1] - add(z[:, 0], z[:, 1]))


class Crf:
    def __init__(self, weights: np.ndarray, table: np.ndarray, slope: float = 1.0, shift: float = 0.0):
        self.weights, self.table, self.slope, self.shift = weights, table, slope, shift

    def mean(self, x: np.ndarray, length: np.ndarray) -> float:
        z = x @ self.weights
        return float((marginals(np.stack((-z / 2, z / 2), axis=1), self.table) * length).sum() / length.sum())

    def score(self, text: str | None) -> float:
        m = min(max(self.mean(*features(text)), 1e-6), 1 - 1e-6)
        return float(1 / (1 + np.exp(-np.clip(self.slope * np.log(m / (1 - m)) + self.shift, -40, 40))))


def forward(z: np.ndarray, fresh: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Log odds of good at every line given the lines up to it, from the lines' own log odds z. A line that is fresh begins
    a document. The lines are one chain, cut to about sqrt(n) pieces that are worked through side by side: first what each
    piece makes of either label before it, then the odds between the pieces, then those within."""
    n = len(z)
    side = int(np.ceil(np.sqrt(n)))
    many = -(-n // side)
    own, live = np.zeros(many * side), np.zeros(many * side)
    own[:n], live[:n] = z, ~fresh
    own, live = own.reshape(many, side).T.copy(), live.reshape(many, side).T.copy()
    (u, v), (s, t) = table.tolist()
    bad, good = np.full((2, many), -np.inf), np.full((2, many), -np.inf)  # by the label before the piece
    bad[0], good[1] = 0, 0
    for x, k in zip(own, live):
        bad, good = np.logaddexp(bad + u * k, good + s * k), np.logaddexp(bad + v * k, good + t * k) + x
    start, before = np.zeros(many), 0.0
    for i in range(many):
        start[i] = before
        before = np.logaddexp(good[0, i], before + good[1, i]) - np.logaddexp(bad[0, i], before + bad[1, i])
    out, now = np.empty((side, many)), start
    for i, (x, k) in enumerate(zip(own, live)):
        out[i] = now = x + k * (np.logaddexp(v, now + t) - np.logaddexp(u, now + s))
    return out.T.reshape(-1)[:n]


def line_odds(own: np.ndarray, fresh: np.ndarray, last: np.ndarray, w: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each line's own log odds of good, and those given all lines up to it and from it on. Lines of all documents are one
    chain, without padding, in which a document's first line has no predecessor."""
    z = own @ w[:OWN] + np.where(fresh, 0, np.roll(own @ w[OWN : 2 * OWN], 1)) + np.where(last, 0, np.roll(own @ w[2 * OWN :], -1))
    return z, forward(z, fresh, table), forward(z[::-1], last[::-1], table.T)[::-1]


def chained(seqs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The lines of all documents, which begin and which end one."""
    own, size = np.concatenate(seqs), np.array([len(s) for s in seqs])
    fresh, last = np.zeros(len(own), bool), np.zeros(len(own), bool)
    last[np.cumsum(size) - 1] = True
    fresh[0], fresh[1:] = True, last[:-1]
    return own, fresh, last


def relabelled(seqs: list[np.ndarray], y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """A label for each line: its document's, but good for lines of bad documents that are good by their own features, if
    another line of theirs is bad."""
    good, doc = np.concatenate(seqs) @ w[:OWN] > 0, np.repeat(np.arange(len(seqs)), [len(s) for s in seqs])
    mixed = np.bincount(doc, ~good, len(seqs)) > 0
    return np.where(y[doc] == 1, 1, (good & mixed[doc]).astype(np.int64))


def train(seqs: list[np.ndarray], y: np.ndarray, label: np.ndarray | None = None, alone: bool = False, steps: int = 200, rate: float = 0.1, decay: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Maximum likelihood by Adam, from the own features of all lines of each document and its label y. label: of all lines,
    one after another; their documents' by default. alone: only the weights of a line's own features. Documents of both
    labels weigh the same, and so do all of one."""
    (own, fresh, last), size = chained(seqs), np.array([len(s) for s in seqs])
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    per_line, label = np.repeat(weight / size, size), np.repeat(y, size) if label is None else label
    inner = np.flatnonzero(~fresh)  # lines with a predecessor

    def earlier(x: np.ndarray) -> np.ndarray:
        return np.where(fresh, 0, np.roll(x, 1))

    def later(x: np.ndarray) -> np.ndarray:
        return np.where(last, 0, np.roll(x, -1))

    want = np.bincount(2 * label[inner - 1] + label[inner], per_line[inner], 4).reshape(2, 2)
    w, table = np.zeros(3 * OWN), np.zeros((2, 2))
    ms, vs = [np.zeros(3 * OWN), np.zeros((2, 2))], [np.zeros(3 * OWN), np.zeros((2, 2))]
    for t in range(1, steps + 1):
        z, f, b = line_odds(own, fresh, last, w, table)  # f and b both with the line's own odds
        gap = (label - 1 / (1 + np.exp(-np.clip(f + b - z, -500, 500)))) * per_line
        grad_w = np.concatenate((gap @ own, later(gap) @ own, earlier(gap) @ own)) - decay * w
        p, q = f[inner - 1], b[inner]
        pair = np.stack((np.full(len(p), table[0, 0]), table[0, 1] + q, table[1, 0] + p, table[1, 1] + p + q))
        pair = np.exp(pair - np.logaddexp.reduce(pair, axis=0))
        grad_t = want - (pair @ per_line[inner]).reshape(2, 2) - decay * table
        if alone:
            grad_w[OWN:], grad_t = 0, np.zeros((2, 2))
        for k, (p, g) in enumerate(((w, grad_w), (table, grad_t))):
            ms[k], vs[k] = 0.9 * ms[k] + 0.1 * g, 0.999 * vs[k] + 0.001 * g**2
            p += rate * (ms[k] / (1 - 0.9**t)) / (np.sqrt(vs[k] / (1 - 0.999**t)) + 1e-8)
    return w, table


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = 2000) -> Crf | None:
    """docs (doc_id, text) and labels (doc_id, quality) to a model; None without labels of both kinds."""
    lab = only(labels, "doc_id", "quality").where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    parts, stands_for = zip(*(weighted_sample(lab.where(F.col("quality") == q), "doc_id", fit_rows // 2) for q in (0, 1)))
    rows = only(docs, "doc_id", "text").join(F.broadcast(parts[0].unionByName(parts[1])), "doc_id")  # fit_rows rows at most
    key = F.xxhash64("doc_id")  # ids of any type; what follows only needs an order that doesn't depend on the partitions

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [own_and_length(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([x.ravel() for x, _ in got], pa.list_(pa.float64())), pa.array([n for _, n in got], pa.list_(pa.float64()))], names=["key", "quality", "x", "n"])

    sample = rows.select(key.alias("key"), "text", F.col("quality").cast("int")).mapInArrow(run, "key long, quality int, x array<double>, n array<double>").toPandas()
    sample = sample.sort_values("key", kind="stable")
    y = sample["quality"].to_numpy()
    if set(y) != {0, 1}:
        return None
    seqs = [np.asarray(x).reshape(-1, OWN) for x in sample["x"]]
    crf = Crf(*train(seqs, y, relabelled(seqs, y, train(seqs, y, alone=True)[0])))
    mean = np.array([crf.mean(beside(x), np.asarray(n)) for x, n in zip(seqs, sample["n"])]).clip(1e-6, 1 - 1e-6)
    a, c, z = 1.0, 0.0, np.log(mean / (1 - mean))
    weight = np.array(stands_for)[y]
    weight = weight / weight.mean()
    for _ in range(300):  # logistic curve by gradient steps
        gap = weight * (y - 1 / (1 + np.exp(-np.clip(a * z + c, -40, 40))))
        a, c = a + 0.05 * (gap * z).mean(), c + 0.5 * gap.mean()
    crf.slope, crf.shift = max(a, 1e-3), c
    return crf


def score(docs: DataFrame, model: Crf | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: the key, score (0 to 1), predicted."""
    key_type = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = np.array([model.score(x.as_py()) if model else 0.5 for x in batch.column(1)], np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got), pa.array((got >= 0.5).astype(np.int32))], names=[key, "score", "predicted"])

    return only(docs, key, text).mapInArrow(run, f"`{key}` {key_type}, score double, predicted int")
