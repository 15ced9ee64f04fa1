"""Substring deduplication with a log-structured fingerprint index.

A window is `window` consecutive words of a document. Every word covered by a window whose word sequence also starts
anywhere else, in the same document too, goes.

Which windows to post: every window is represented by its minimizer, the least of its `gram`-word hashes (leftmost of
equals). Equal windows have the same minimizer at the same place, so an index of minimizers misses none. Consecutive
windows with one minimizer form a region, posted as one row: (fp, body, key, first window, windows), where fp is the
64-bit hash of the minimizer and body a 64-bit hash of all the region's words, made from other word hashes than fp. That
is about a row for 14 words.

The index is a log of immutable runs, each sorted by fp with one row a fingerprint: (fp, n). A batch's run is merge-joined
with every older run on fp, the matches are verified on the postings, which are kept beside the runs, and runs are merged
when `fan` of them are of one size. extend() keeps such an index on disk and deduplicates each new batch against all earlier
ones. mark() and remove() judge one table as a whole: it comes in `batches` batches by hash, and since every batch's
documents are judged by all the others, their matches are verified together, after the last one.

Regions with equal fp and body are equal as a whole: their words have the same independent hash, their minimizers another.
Regions that share only fp are opened: their windows are compared by two independent 64-bit hashes, one copy of each different body only, so that a group of copies is compared once.

Null texts have no words. Documents shorter than a window lose nothing. Repeated rows and repeated ids are separate
documents. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treefold.llm.common import Scratch, free, held, located, only, shuffle_partitions

#: Odd multipliers for hashing.
M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


class WordHashes(dict):
    """Two independent 64-bit hashes of a word, as positions in two growing arrays."""

    def __init__(self, room: int = 600_000):
        self.room, self.a, self.b, self.n = room, np.empty(1024, np.uint64), np.empty(1024, np.uint64), 0

    def __missing__(self, word: bytes) -> int:
        h = hashlib.blake2b(word, digest_size=16).digest()
        if self.n == len(self.a):
            self.a, self.b = np.resize(self.a, 2 * self.n), np.resize(self.b, 2 * self.n)
        self.a[self.n], self.b[self.n] = np.frombuffer(h, np.uint64)
        self[word] = out = self.n
        self.n += 1
        return out

    def of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if self.n > self.room:
            self.clear()
            self.n = 0
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        return self.a[at], self.b[at]


def word_hashes() -> WordHashes:
    return held("word hashes", WordHashes)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * M1
    x = (x ^ (x >> np.uint64(29))) * M2
    return x ^ (x >> np.uint64(32))


def rolling(h: np.ndarray, n: int, m: np.uint64) -> np.ndarray:
    """Polynomial hashes of all runs of n values, put together from runs of powers of two."""
    if len(h) < n:
        return h[:0]
    out, done, power, run, size = None, 0, np.uint64(m), h, 1
    while True:
        if n & size:
            if out is None:
                out, done = run, size
            else:
                k = len(h) - done - size + 1
                out, done = out[:k] * power + run[done : done + k], done + size
        if 2 * size > n:
            return out
        k = len(run) - size
        run = run[:k] * power + run[size : size + k]
        power, size = np.uint64(int(power) ** 2 % (1 << 64)), 2 * size


def least(h: np.ndarray, n: int) -> np.ndarray:
    """Position of the leftmost least value in every run of n values."""
    pos, size = np.arange(len(h)), 1
    while size < n:
        step = min(size, n - size)
        a, b = pos[: len(pos) - step], pos[step:]
        pos = np.where(h[b] < h[a], b, a)
        size += step
    return pos


def regions(a: np.ndarray, b: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """fp, body, first window, number of windows of each region of one document, from two independent hashes of its words."""
    grams = mix(rolling(a, gram, M1))
    at = least(grams, window - gram + 1)
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    count = np.diff(np.append(first, len(at)))
    return grams[at[first]], span_hash(b, first, first + count + window - 1, M3), first, count


def span_hash(h: np.ndarray, start: np.ndarray, stop: np.ndarray, m: np.uint64) -> np.ndarray:
    """Hashes of the spans h[start:stop], wherever they lie: prefix sums of h[i] * m^i, divided by m^start."""
    n, back = len(h), np.uint64(pow(int(m), -1, 1 << 64))
    up, down = np.full(n + 1, m), np.full(n + 1, back)
    up[0] = down[0] = 1
    up, down = np.multiply.accumulate(up), np.multiply.accumulate(down)
    sums = np.zeros(n + 1, np.uint64)
    np.add.accumulate(mix(h) * up[:n], out=sums[1:])
    return mix((sums[stop] - sums[start]) * down[start] + (stop - start).astype(np.uint64) * M2)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


#: Names that no column of a caller has.
TAG, SPANS, BATCH = "_treefold_tag", "_treefold_spans", "_treefold_batch"


def tagged(df: DataFrame, key: str, text: str) -> DataFrame:
    """With a tag of the text, so that rows that share a key are told apart; equal rows may share their spans."""
    return df.withColumn(TAG, F.xxhash64(F.coalesce(F.col(text), F.lit(""))).bitwiseAND(F.lit(0x7FFFFFFF)).cast("int"))


def post(df: DataFrame, key: str, text: str, window: int, gram: int, batches: int = 1) -> DataFrame:
    """The postings of all regions: fp, body, the key, the tag, first, windows, and the batch of their row."""
    key_type = df.schema[key].dataType.simpleString()
    batch_of = F.pmod(F.xxhash64(key, TAG), F.lit(batches)).cast("int")

    def run(them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in them:
            at, cols = [], [[np.empty(0, t)] for t in (np.uint64, np.uint64, np.int64, np.int64)]
            for i, x in enumerate(batch.column(3)):
                words = words_of(x.as_py())
                if len(words) < window:
                    continue
                got = regions(*word_hashes().of(words), window, gram)
                at.append(np.full(len(got[0]), i, np.int64))
                for c, v in zip(cols, got):
                    c.append(v)
            fp, body, first, count = (np.concatenate(c) for c in cols)
            rows = pa.array(np.concatenate([np.empty(0, np.int64), *at]))
            own = [batch.column(k).take(rows) for k in range(3)]
            yield pa.RecordBatch.from_arrays([_signed(fp), _signed(body), own[0], own[1], pa.array(first.astype(np.int32)), pa.array(count.astype(np.int16)), own[2]], names=["fp", "body", key, TAG, "first", "windows", BATCH])

    return df.select(key, TAG, batch_of.alias(BATCH), text).mapInArrow(run, f"fp long, body long, `{key}` {key_type}, {TAG} int, first int, windows short, {BATCH} int")


class Index:
    """Sorted immutable runs of (fp, n), bucketed by fp, with one row a fingerprint, so that one that occurs very often
    is counted before it is shuffled and is one row of a bucket. Joins of runs need no shuffle. The postings stay beside
    the index in the order in which they were made.

    Everything lies in the folder of `scratch`. save() makes the state last by one more manifest; until then, what was
    added since isn't part of the index, and open() removes it. One writer at a time.
    """

    def __init__(self, scratch: Scratch, buckets: int, fan: int = 3):
        self.spark, self.scratch, self.buckets, self.fan = scratch.spark, scratch, buckets, fan
        self.runs: list[tuple[str, int]] = []
        self.made: list[str] = []
        self.gone: list[str] = []  # runs that were merged into others
        self.version = 0

    @classmethod
    def open(cls, spark: SparkSession, path: str, buckets: int, fan: int, **settings) -> Index:
        """The index kept at path, or an empty one. Its settings, such as the window, must be those it was made with."""
        found = cls(Folder(spark, path), buckets, fan)
        names = found.scratch.names()
        saved = [int(n.split("-")[1]) for n in names if n.startswith("manifest-") and "_SUCCESS" in found.scratch.names(n)]
        if saved:
            found.version = max(saved)
            state = json.loads(spark.read.text(found.scratch.path(f"manifest-{found.version}")).first()[0])
            if state["settings"] != settings:
                raise ValueError(f"{path} was made with {state['settings']}, not {settings}")
            found.buckets, found.runs, found.made = state["buckets"], [tuple(r) for r in state["runs"]], state["made"]
            for name, _ in found.runs:
                place = found.scratch.path(name).replace("'", "\\'")
                spark.sql(f"CREATE TABLE IF NOT EXISTS {name} (fp BIGINT, n BIGINT) USING parquet CLUSTERED BY (fp) SORTED BY (fp) INTO {found.buckets} BUCKETS LOCATION '{place}'")
        found.settings = settings
        stay = {f"manifest-{found.version}", *found.made, *[n for n, _ in found.runs]}
        if left := [n for n in names if n.startswith(("run_", "postings_", "manifest-")) and n not in stay]:
            found.scratch.drop(*left)
        return found

    def save(self) -> None:
        self.version += 1
        state = json.dumps({"settings": self.settings, "buckets": self.buckets, "runs": self.runs, "made": self.made})
        self.spark.createDataFrame([(state,)], "value string").coalesce(1).write.text(self.scratch.path(f"manifest-{self.version}"))
        for name in self.gone:
            self.remove(name)
        self.gone = []
        self.scratch.drop(f"manifest-{self.version - 1}")

    def write(self, counts: DataFrame, tier: int) -> str:
        name = f"run_{uuid.uuid4().hex}"
        counts.write.bucketBy(self.buckets, "fp").sortBy("fp").option("path", self.scratch.path(name)).saveAsTable(name)
        self.runs.append((name, tier))
        return name

    def remove(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.scratch.drop(name)

    def keep(self, postings: DataFrame) -> DataFrame:
        """Stores a batch's postings beside the runs."""
        self.made.append(f"postings_{uuid.uuid4().hex}")
        return self.scratch.store(postings, self.made[-1])

    def add(self, made: DataFrame) -> DataFrame:
        """Takes in a batch by its stored postings. Returns the fps that the batch shares with itself or with any older run,
        read from the runs, which stay until save() or close()."""
        older = [n for n, _ in self.runs]
        shared = self.spark.table(self.write(made.groupBy("fp").agg(F.count("*").alias("n")), 0))
        seen = F.col("n") >= 2
        for k, name in enumerate(older):
            shared = shared.join(self.spark.table(name).select("fp", F.lit(True).alias(f"in{k}")), "fp", "left")
            seen |= F.col(f"in{k}").isNotNull()
        free(self.spark)
        return shared.where(seen).select("fp")

    def compact(self) -> None:
        """Merges the runs of a tier into one of the next, while any tier has `fan` of them."""
        while full := [t for t in {t for _, t in self.runs} if sum(x == t for _, x in self.runs) >= self.fan]:
            names = [n for n, t in self.runs if t == full[0]]
            # read as files: over a union of bucketed tables Spark 4.1 sums without bringing equal fps together
            merged = self.spark.read.schema("fp long, n long").parquet(*[self.scratch.path(n) for n in names]).repartition(self.buckets, "fp")
            self.write(merged.groupBy("fp").agg(F.sum("n").alias("n")), full[0] + 1)
            self.runs = [r for r in self.runs if r[0] not in names]
            self.gone += names

    def postings(self, since: int = 0) -> DataFrame:
        """The postings taken in, all or those from a batch on."""
        return self.spark.read.parquet(*[self.scratch.path(n) for n in self.made[since:]])

    def close(self) -> None:
        """Ends an index that isn't kept."""
        for n in [*self.gone, *[n for n, _ in self.runs]]:
            self.remove(n)


class Folder(Scratch):
    """A folder that is kept."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.top = spark, path

    def names(self, below: str = "") -> list[str]:
        fs, p = located(self.spark, os.path.join(self.top, below) if below else self.top)
        return [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []


def _open(df: DataFrame, opened: DataFrame, key: str, text: str, window: int) -> DataFrame:
    """Windows of the opened bodies: w1, w2, fp, body, j."""
    wanted = opened.groupBy(key, TAG).agg(F.collect_list(F.struct("fp", "body", "first", "windows")).alias("_o"))
    both = _by_row(df.select(key, TAG, text), wanted, key, "inner")

    def run(them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in them:
            cols = [[np.empty(0, t)] for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64)]
            for x, o in zip(batch.column(0), batch.column(1)):
                a, b = word_hashes().of(words_of(x.as_py()))
                first, many, fps, bodies = (o.values.field(k).to_numpy() for k in ("first", "windows", "fp", "body"))
                many = many.astype(np.int64)
                j = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                start = np.repeat(first, many) + j
                for c, v in zip(cols, (span_hash(a, start, start + window, M3), span_hash(b, start, start + window, M1), np.repeat(fps, many), np.repeat(bodies, many), j)):
                    c.append(v)
            w1, w2, fp, body, j = (np.concatenate(c) for c in cols)
            yield pa.RecordBatch.from_arrays([_signed(w1), _signed(w2), pa.array(fp), pa.array(body), pa.array(j.astype(np.int16))], names=["w1", "w2", "fp", "body", "j"])

    return both.select(text, "_o").mapInArrow(run, "w1 long, w2 long, fp long, body long, j short")


def _by_row(a: DataFrame, b: DataFrame, key: str, how: str) -> DataFrame:
    b = b.withColumnsRenamed({key: "_treefold_k", TAG: "_treefold_t"})
    return a.join(b, F.col(key).eqNullSafe(F.col("_treefold_k")) & (F.col(TAG) == F.col("_treefold_t")), how).drop("_treefold_k", "_treefold_t")


def repeated(df: DataFrame, scratch: Scratch, key: str, text: str, window: int = 35, gram: int = 10, batches: int = 3, fan: int = 3) -> DataFrame:
    """df (tagged) to its repeated windows, by row: the key, the tag, first, windows, js (null: all of them)."""
    index, shared = Index(scratch, shuffle_partitions(df.sparkSession), fan), None
    made = scratch.store(post(df, key, text, window, gram, batches), "postings", BATCH)  # one pass over the texts
    for k in range(batches):
        found = index.add(made.where(F.col(BATCH) == k))
        shared = found if shared is None else shared.unionByName(found)
        if k + 1 < batches:  # after the last one nothing reads a run but what is shared
            index.compact()
    hits = matched(made.drop(BATCH), shared, scratch, "hits")
    index.close()
    scratch.drop("postings")
    return verified(hits, hits, df, scratch, key, text, window)


def matched(postings: DataFrame, shared: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """The postings with shared fingerprints, of which some may come several times. Those are stored, so that Spark may split
    the postings of one that has very many."""
    shared = scratch.store(shared, f"{name}-shared", few=True)
    hits = scratch.store(postings.join(shared, "fp", "left_semi"), name)
    scratch.drop(f"{name}-shared")
    return hits


def verified(hits: DataFrame, mine: DataFrame, df: DataFrame, scratch: Scratch, key: str, text: str, window: int) -> DataFrame:
    """Of the postings `mine` the windows that occur elsewhere in `hits`: the key, the tag, first, windows, js. All postings of
    a fingerprint are in hits; the texts come from df."""
    bodies = hits.groupBy("fp", "body").agg(F.count("*").alias("n"), F.min(F.struct(key, TAG, "first", "windows")).alias("s"))
    bodies = scratch.store(bodies, "bodies")
    several = scratch.store(bodies.groupBy("fp").count().where("count >= 2").select("fp"), "several", few=True)
    opened = bodies.join(several, "fp", "left_semi").select("fp", "body", "s.*")
    windows = scratch.store(_open(df, opened, key, text, window), "windows")
    free(df.sparkSession)
    # a row that stands several times is opened as often, so bodies are counted, not rows
    twice = scratch.store(windows.groupBy("w1", "w2").agg(F.min(F.struct("fp", "body")).alias("a"), F.max(F.struct("fp", "body")).alias("b")).where("a <> b").select("w1", "w2"), "twice", few=True)
    some = windows.join(twice, ["w1", "w2"], "left_semi").groupBy("fp", "body").agg(F.sort_array(F.collect_set("j")).alias("js"))
    whole = bodies.where("n >= 2").select("fp", "body", F.lit(None).cast("array<smallint>").alias("js"))
    gone = scratch.store(whole.unionByName(some.join(whole.select("fp", "body"), ["fp", "body"], "left_anti")), "gone", few=True)
    out = scratch.store(mine.join(gone, ["fp", "body"]).select(key, TAG, "first", "windows", "js"), "spans")
    scratch.drop("hits", "mine", "several", "bodies", "windows", "twice", "gone")
    return out


def covered(n: int, spans: list[dict] | None, window: int) -> np.ndarray:
    """Which of n words the spans cover."""
    edge = np.zeros(n + 1, np.int32)
    for s in spans or ():
        if s["js"] is None:
            edge[s["first"]] += 1
            edge[s["first"] + s["windows"] + window - 1] -= 1
        else:
            for j in s["js"]:
                edge[s["first"] + j] += 1
                edge[s["first"] + j + window] -= 1
    return np.cumsum(edge[:-1]) > 0


def _with_spans(df: DataFrame, key: str, text: str, **how) -> tuple[DataFrame, int]:
    rows = tagged(df, key, text)
    scratch = Scratch(df.sparkSession, "substring")
    return _beside(rows, repeated(only(rows, key, text, TAG), scratch, key, text, **how), key), how.get("window", 35)


def _beside(rows: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    per_row = spans.groupBy(key, TAG).agg(F.collect_list(F.struct("first", "windows", "js")).alias(SPANS))
    return _by_row(rows, per_row, key, "left")


def mark(df: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """One row a document: the key, n_words, n_removed, kept_sha256 (of the words kept, joined by one space)."""
    both, window = _with_spans(only(df, key, text), key, text, **how)
    key_type = df.schema[key].dataType.simpleString()

    def run(them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in them:
            n, gone, sha = [], [], []
            for x, s in zip(batch.column(1), batch.column(2)):
                words = words_of(x.as_py())
                cover = covered(len(words), s.as_py(), window)
                n.append(len(words))
                gone.append(int(cover.sum()))
                sha.append(hashlib.sha256(b" ".join([w for w, c in zip(words, cover) if not c] if gone[-1] else words)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())], names=[key, "n_words", "n_removed", "kept_sha256"])

    return both.select(key, text, SPANS).mapInArrow(run, f"`{key}` {key_type}, n_words long, n_removed long, kept_sha256 string")


def remove(df: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """All rows and columns; texts without their repeated words. Kept words stay with the white space before them, and a
    text that loses nothing is unchanged."""
    both, window = _with_spans(df, key, text, **how)
    return _cut(both, df, text, window)


def _cut(both: DataFrame, df: DataFrame, text: str, window: int) -> DataFrame:
    columns, at = df.columns, df.columns.index(text)

    def run(them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in them:
            out = []
            for x, s in zip(batch.column(at), batch.column(len(columns))):
                old = x.as_py()
                if s.as_py() and old is not None:
                    data = old.encode()
                    places = [m.span() for m in WORDS.finditer(data)]
                    cover = covered(len(places), s.as_py(), window)
                    ends = [0, *[b for _, b in places]]
                    old = b"".join([data[a:b] for a, b, c in zip(ends, ends[1:], cover) if not c] + [data[ends[-1] :]]).strip().decode()
                out.append(old)
            cols = list(batch.columns[: len(columns)])
            cols[at] = pa.array(out, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(cols, names=columns)

    return both.select(*columns, SPANS).mapInArrow(run, df.schema)


def extend(batch: DataFrame, path: str, history: DataFrame | None, key: str = "doc_id", text: str = "text", window: int = 35, gram: int = 10, fan: int = 3) -> DataFrame:
    """Incremental deduplication: the rows of a new batch, with all their columns, without the words that a window covers
    which starts anywhere else in the batch or in what the index at `path` has taken in before.

    history: the documents (key, text, as they came, not as they were cut) of all earlier batches, of which only those that
    share a fingerprint with the batch are opened; None for the first. Earlier documents don't change. The batch's run is
    merge-joined with the older runs, its matches are verified, and runs are compacted; then the index is saved, all or
    nothing. A batch that failed can simply come again.
    """
    spark = batch.sparkSession
    index = Index.open(spark, path, shuffle_partitions(spark), fan, window=window, gram=gram, key=key)
    scratch, rows = Scratch(spark, "substring"), tagged(batch, key, text)
    documents = only(rows, key, text, TAG)
    if history is not None:
        documents = documents.unionByName(tagged(only(history, key, text), key, text))
    shared = index.add(index.keep(post(only(rows, key, text, TAG), key, text, window, gram).drop(BATCH)))
    shared = scratch.store(shared, "shared")
    hits, mine = matched(index.postings(), shared, scratch, "hits"), matched(index.postings(len(index.made) - 1), shared, scratch, "mine")
    spans = verified(hits, mine, documents, scratch, key, text, window)
    out = scratch.store(_cut(_beside(rows, spans, key), batch, text, window), "cut")
    index.compact()
    index.save()
    scratch.drop("shared", "spans")
    return out
