"""Language identification by words first, with backoff to character n-grams.

A known word counts with its log frequency in each language. An unseen word falls back to its character n-grams: at each
place the longest known one, from 4 characters down to 1, each step down at a discount. A text's score is the sum over
its words, and the result is the likeliest language.

Frequencies are learned from a bounded sample of labelled rows (`fit_rows`, a parameter), and the model holds every word and
n-gram of it but those of three letters or more, and words, that it saw once only. The sample is shared out among the
languages, so that a rare one is learned beside one that has nearly all rows: each gets an equal part, and what a small one
can't fill goes to the others. A language has 32 rows in the sample, or all it has, even if that makes more than `fit_rows`
together. Prediction reads every whole text and nothing else, and needs no shuffle. The model is broadcast (its size is
bounded by the sample), and a worker keeps the scores of at most `HELD` chunks. Null texts and texts without a letter
are `und` with score 0; so is everything when there is nothing to learn from. Repeated rows are predicted each.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treefold.llm.common import held, only, shares
from treefold.llm.wordbpe import Cache

WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
LONGEST = 4
DISCOUNT = 0.7
#: Chunks whose scores a worker keeps.
HELD = 500_000


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def grams(word: str, n: int) -> list[str]:
    padded = f"^{word}$"
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


class Model:
    def __init__(self, languages: list[str], places: list[dict[str, int]], logs: np.ndarray):
        """places[0]: rows of words in logs (log frequencies by language); places[n]: those of n-grams."""
        self.languages, self.places, self.logs, self.name = languages, places, logs, uuid.uuid4().hex

    def word(self, w: str) -> np.ndarray:
        if (known := self.places[0].get(w)) is not None:
            return self.logs[known]
        padded, at, step = f"^{w}$", [], []
        for i in range(len(padded)):
            for n in range(min(LONGEST, len(padded) - i), 0, -1):
                if (got := self.places[n].get(padded[i : i + n])) is not None:
                    at.append(got)
                    step.append(DISCOUNT ** (LONGEST - n))
                    break
        return np.asarray(step) @ self.logs[at] / len(padded) if at else np.zeros(len(self.languages))


class Chunks:
    """Summed scores and the number of words of chunks without white space, made on demand."""

    def __init__(self, model: Model):
        self.model, self.width = model, len(model.languages)
        self.rows, self.place = np.zeros((1 << 12, self.width + 1)), Cache(self.add, 1 << 62)

    def add(self, chunk: bytes) -> int:
        if (at := len(self.place)) == len(self.rows):
            self.rows = np.concatenate((self.rows, np.zeros_like(self.rows)))
        found = words(chunk.decode("utf-8", "replace"))
        self.rows[at] = 0
        for w in found:
            self.rows[at, : self.width] += self.model.word(w)
        self.rows[at, self.width] = len(found)
        return at

    def total(self, text: str | None) -> np.ndarray:
        """The sums over a text. A text's chunks go through in parts, so that a full cache can be emptied in between."""
        chunks, out = (text or "").encode().split(), np.zeros(self.width + 1)
        for i in range(0, len(chunks), HELD):
            if len(self.place) > HELD:
                self.place.clear()
            part = chunks[i : i + HELD]
            at = np.fromiter(map(self.place.__getitem__, part), np.int64, len(part))
            out += self.rows[at].sum(axis=0)
        return out

    def predict(self, text: str | None) -> tuple[str, float]:
        total = self.total(text)
        if not total[self.width]:
            return "und", 0.0
        z = total[: self.width] / math.sqrt(total[self.width])
        best = int(z.argmax())
        return self.model.languages[best], float(1 / np.exp(z - z[best]).sum())


def fit(docs: DataFrame, fit_rows: int = 8000) -> Model | None:
    """docs (doc_id, text, lang) to a model."""
    spark, rows = docs.sparkSession, only(docs, "doc_id", "text", "lang").where("lang is not null and text is not null")
    n = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not n:
        return None
    part = spark.createDataFrame([(x, int(k / n[x] * (1 << 30))) for x, k in shares(n, fit_rows, 32).items()], "lang string, part long")
    rows = rows.join(F.broadcast(part), "lang").where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30)) < F.col("part"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for x, lang in zip(batch.column(0), batch.column(1).to_pylist()):
                seen.update((lang, w) for w in words(x.as_py()))
        out: Counter = Counter()
        for (lang, w), c in seen.items():
            out[lang, 0, w] += c
            for n in range(1, LONGEST + 1):
                for g in grams(w, n):
                    out[lang, n, g] += c
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in out], pa.string()), pa.array([k[1] for k in out], pa.int32()), pa.array([k[2] for k in out], pa.string()), pa.array(out.values(), pa.int64())], names=["lang", "n", "g", "c"])

    counts = rows.select("text", "lang").mapInArrow(count, "lang string, n int, g string, c long").groupBy("lang", "n", "g").agg(F.sum("c").alias("c"))
    best = counts.where("c >= 2 or n in (1, 2)").toArrow().to_pandas()
    if not len(best):
        return None
    languages = sorted(set(best["lang"]))
    kind, lang = best["n"].to_numpy(), best["lang"].map({x: i for i, x in enumerate(languages)}).to_numpy()
    places: list[dict[str, int]] = []
    for k in range(LONGEST + 1):
        places.append({g: i for i, g in enumerate(sorted(set(best["g"][kind == k])), sum(map(len, places)))})
    kinds = np.repeat(np.arange(LONGEST + 1), [len(x) for x in places])
    seen, total = np.zeros((len(kinds), len(languages))), np.zeros((LONGEST + 1, len(languages)))
    seen[[places[k][g] for k, g in zip(kind, best["g"])], lang] = best["c"]
    np.add.at(total, (kind, lang), best["c"])
    size = np.array([len(x) for x in places])
    return Model(languages, places, np.log((seen + 0.1) / (total + 0.1 * size[:, None])[kinds]))


def predict(docs: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: the key, lang_pred, score (the chance of that language)."""
    key_type = docs.schema[key].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        chunks = known and held(("langid", known.name), lambda: Chunks(known))
        for batch in batches:
            got = [chunks.predict(x.as_py()) if chunks else ("und", 0.0) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in got], pa.string()), pa.array([y for _, y in got], pa.float64())], names=[key, "lang_pred", "score"])

    return only(docs, key, text).mapInArrow(run, f"`{key}` {key_type}, lang_pred string, score double")
