"""Near-duplicate detection by a signature-coordinate inverted join.

Every document's set of distinct word shingles gets a MinHash signature of `coordinates` values. Documents are posted
under each (coordinate, value) pair; pairs of documents that collide in at least `matches` coordinates are candidates,
and are confirmed on their full sets.

Prefix and skip merging: postings that one set alone holds are skipped. A set with fewer than `matches` shared postings
has no partner and is skipped. Any pair with enough collisions shares one of the (shared - matches + 1) rarest postings
of either set, so only these prefixes are merged, rarest first; what many documents share drops out.

No pairs within a group of copies are expanded. Equal sets are one node (equal by two 64-bit sums over the shingles' hashes
and by size). In each posting list all members meet one pivot first, and confirmed links are contracted to components.
Lists whose members are in one component are done. In the others collisions are counted for members of different
components, on signatures, block by block; the pairs above the threshold are kept as a spanning forest, whose trees are
the groups that are then compared exactly, also block by block. No pairs are emitted but those that join components or
groups. Every link lies within one of the resulting components.

With 64 coordinates and 34 matches a pair of similarity 0.8 is missed with probability 3.2e-7.

Words are split at ASCII white space after lower-casing A-Z. A text with fewer words than a shingle is one shingle;
without words it is empty and linked with nothing. Null texts count as empty. Rows that share a key are separate
documents. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treefold.llm.common import Scratch, free, only
from treefold.llm.substring import M1, M2, M3, TAG, _by_row, mix, rolling, tagged, word_hashes, words_of

STEP = 1024


def shingles(text: str | None, size: int) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    words = words_of(text and text.encode().lower().decode())
    if not words:
        return np.empty(0, np.uint64)
    n = min(size, len(words))
    return np.unique(mix(rolling(word_hashes().of(words)[0], n, M1) + np.uint64(n) * M3))


def multipliers(k: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240611)
    return rng.integers(1, 1 << 63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, k, dtype=np.uint64)


def signature(s: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least value of each of the hash functions over the set."""
    low = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(s), STEP):
        np.minimum(low, (s[at : at + STEP, None] * a + b).min(axis=0), out=low)
    return low >> np.uint64(32)


def sets(df: DataFrame, key: str, text: str, size: int, coordinates: int) -> DataFrame:
    """One row a document: the key, the tag, n, s1, s2 (identity of the set), sig (a 32-bit value a coordinate)."""
    key_type = df.schema[key].dataType.simpleString()

    def run(them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = multipliers(coordinates)
        for batch in them:
            n, s1, s2, sig = [], [], [], []
            for x in batch.column(2):
                s = shingles(x.as_py(), size)
                n.append(len(s))
                s1.append(int(mix(s + M2).sum(dtype=np.uint64)) - (1 << 63))
                s2.append(int(mix(s ^ M3).sum(dtype=np.uint64)) - (1 << 63))
                sig.append(signature(s, a, b).astype(np.uint32).view(np.int32) if len(s) else np.empty(0, np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(sig, pa.list_(pa.int32()))],
                names=[key, TAG, "n", "s1", "s2", "sig"],
            )

    return df.select(key, TAG, text).mapInArrow(run, f"`{key}` {key_type}, {TAG} int, n long, s1 long, s2 long, sig array<int>")


def confirm(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """a, b, linked for each pair: 100 * intersection >= percent * union on the full sets."""
    left = pairs.join(texts.select(F.col("sid").alias("a"), F.col("text").alias("ta")), "a")
    both = left.join(texts.select(F.col("sid").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb")

    def run(them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None
        for batch in them:
            ok = []
            for a, ta, tb in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3)):
                if a != last:
                    last, held = a, shingles(ta.as_py(), size)
                other = shingles(tb.as_py(), size)
                shared = len(np.intersect1d(held, other, assume_unique=True))
                ok.append(100 * shared >= percent * (len(held) + len(other) - shared))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ok, pa.bool_())], names=["a", "b", "linked"])

    return both.mapInArrow(run, "a long, b long, linked boolean")


def rooted(parents: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """parents (b, a), where a < b and each b stands once, to node, comp: the root of each tree, by pointer jumping. The side
    of a join that has each key once is stored, so that Spark can split the other side's rows of a node with many children."""
    now, step = scratch.store(parents.select("b", "a", F.lit(True).alias("moved")), f"{name}-p0"), 0
    while now.where("moved").limit(1).count():
        up = now.select(F.col("b").alias("a"), F.col("a").alias("c"))
        far = now.drop("moved").join(up, "a", "left").select("b", F.coalesce("c", "a").alias("a"), F.col("c").isNotNull().alias("moved"))
        now, step = scratch.store(far, f"{name}-p{step + 1}"), step + 1
        scratch.drop(f"{name}-p{step - 1}", collect=False)
    return now.select(F.col("b").alias("node"), F.col("a").alias("comp")).unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("comp")).distinct())


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """node, comp (the least node reachable) for all nodes of the edges (a, b).

    Every node hooks onto its least smaller neighbour, trees are contracted to their roots, and so on with the edges that are
    left between different roots. Nothing about a node with many neighbours is gathered in one place.
    """

    def stored(u: str, v: str, of: DataFrame, step: int) -> DataFrame:
        pairs = of.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where("u <> v").distinct()
        return scratch.store(pairs, f"{name}-e{step}")

    now, step = stored("a", "b", edges, 0), 0
    found = now.select(F.col("u").alias("node")).unionByName(now.select(F.col("v").alias("node"))).distinct().withColumn("comp", F.col("node"))
    found = scratch.store(found, f"{name}-f0")
    while now.limit(1).count():
        roots = rooted(now.groupBy("u").agg(F.min("v").alias("a")).select(F.col("u").alias("b"), "a"), scratch, f"{name}-{step}")
        roots = scratch.store(roots, f"{name}-r{step}")

        def at_root(df: DataFrame, x: str) -> DataFrame:  # a node that is nobody's least neighbour, and has none, is its own root
            own = roots.select(F.col("node").alias(x), F.col("comp").alias("_root"))  # noqa: B023
            return df.join(own, x, "left").withColumn(x, F.coalesce("_root", x)).drop("_root")

        now = stored("u", "v", at_root(at_root(now, "u"), "v"), step + 1)
        found = scratch.store(at_root(found, "comp"), f"{name}-f{step + 1}")
        scratch.drop(*[f"{name}-{x}{step}" for x in "efr"], collect=False)
        step += 1
    free(scratch.spark)
    return found


def link(nodes: DataFrame, docs: DataFrame, scratch: Scratch, key: str, text: str, size: int, matches: int, percent: int) -> DataFrame:
    """nodes (sid, rep, n, sig) to sid, comp of those that have links."""
    posts = nodes.select("sid", F.posexplode("sig").alias("at", "v")).select("sid", F.shiftleft(F.col("at").cast("long"), 32).bitwiseOR(F.col("v").cast("long").bitwiseAND(0xFFFFFFFF)).alias("k"))
    often = scratch.store(posts.groupBy("k").agg(F.count("*").alias("f")).where("f >= 2"), "often")
    free(docs.sparkSession)
    shared = posts.join(often, "k").groupBy("sid").agg(F.array_sort(F.collect_list(F.struct("f", "k"))).alias("x")).where(F.size("x") >= matches)
    prefix = shared.select("sid", F.explode(F.slice("x", F.lit(1), F.size("x") - (matches - 1))).alias("y")).select("sid", F.col("y.k").alias("k"))
    lists = scratch.store(prefix, "prefix")
    scratch.drop("often")
    alone = scratch.store(lists.groupBy("k").agg(F.count("*").alias("f")).where("f >= 2").select("k"), "several")
    lists = scratch.store(lists.join(alone, "k").join(nodes.select("sid", "n"), "sid"), "lists")
    scratch.drop("prefix", "several", collect=False)
    # every member meets the pivot it collides with most, of the pivots of its lists
    pivot = scratch.store(lists.groupBy("k").agg(F.min(F.struct("sid", "n")).alias("p")).select("k", F.col("p.sid").alias("p"), F.col("p.n").alias("m")), "pivots")
    fit = (F.col("sid") != F.col("p")) & (100 * F.least("n", "m") >= percent * F.greatest("n", "m"))
    met = lists.join(pivot, "k").where(fit).select("sid", "p").distinct()
    both = met.join(nodes.select("sid", F.col("sig").alias("x")), "sid").join(nodes.select(F.col("sid").alias("p"), F.col("sig").alias("y")), "p")
    hits = both.select("sid", "p", F.size(F.filter(F.zip_with("x", "y", lambda x, y: x == y), lambda z: z)).alias("hits")).where(F.col("hits") >= matches)
    best = scratch.store(hits.groupBy("sid").agg(F.max(F.struct("hits", "p")).alias("z")).select(F.col("sid").alias("b"), F.col("z.p").alias("a")), "pairs")
    scratch.drop("pivots")  # and the shuffles so far: texts come next
    wanted = best.select(F.col("a").alias("sid")).unionByName(best.select(F.col("b").alias("sid"))).distinct()
    texts = scratch.store(_texts(wanted, nodes, docs, key, text), "texts")
    edges = scratch.store(confirm(best, texts, size, percent).where("linked").select("a", "b"), "edges")
    scratch.drop("texts", "pairs")
    # each has one pivot, which is less: these are trees
    comp = scratch.store(rooted(edges.select("a", "b"), scratch, "trees"), "comp")
    # lists whose members are in several components still need their members compared
    near = lists.join(comp.withColumnRenamed("node", "sid"), "sid", "left").withColumn("c", F.coalesce("comp", "sid")).drop("comp")
    near = scratch.store(near, "near")
    mixed = scratch.store(near.groupBy("k").agg(F.min("c").alias("x"), F.max("c").alias("y")).where("x <> y").select("k"), "mixed")
    opened = scratch.store(near.join(mixed, "k"), "open")
    scratch.drop("lists", "near", "mixed", collect=False)
    candidates = scratch.store(collide(opened, nodes, scratch, matches, percent), "candidates")
    if candidates.limit(1).count():
        group = components(candidates, scratch, "groups").select(F.col("node").alias("sid"), F.col("comp").alias("g"))
        members = scratch.store(opened.select("sid", "n", "c").distinct().join(group, "sid"), "members")
        texts = scratch.store(_texts(members.select("sid"), nodes, docs, key, text), "texts")
        more = scratch.store(compare(members, texts, scratch, size, percent), "more")
        if more.limit(1).count():
            comp = scratch.store(components(edges.unionByName(more), scratch, "all"), "linked")
        scratch.drop("members", "texts", "more")
    scratch.drop("open", "once", "listed", "k-shape", "g-shape", "candidates", "edges", collect=False)
    return comp.withColumnRenamed("node", "sid")


def _texts(sids: DataFrame, nodes: DataFrame, docs: DataFrame, key: str, text: str) -> DataFrame:
    """sid, text of the given nodes."""
    wanted = sids.join(nodes, "sid").select("sid", F.col(f"rep.{key}").alias("_treefold_k"), F.col(f"rep.{TAG}").alias("_treefold_t"))
    return docs.join(wanted, F.col(key).eqNullSafe(F.col("_treefold_k")) & (F.col(TAG) == F.col("_treefold_t"))).select("sid", F.col(text).alias("text")).dropDuplicates(["sid"])


def dealt(members: DataFrame, scratch: Scratch, by: str, block_rows: int, block_shingles: int | None = None) -> DataFrame:
    """members (by, sid, n, c) of each group dealt to pairs of blocks of bounded size, so that any two members of different
    components c meet in one: by, i, j, bin, asks, sid, n, c. Of a group's largest component no two members meet. Groups of
    one block share bins of about `block_rows` members; blocks of others have a bin each, numbered below 0."""
    each = members.groupBy(by, "c").agg(F.count("*").alias("m"), F.sum("n").alias("s"))
    total = each.groupBy(by).agg(F.max(F.struct("m", "c", "s")).alias("z"), F.sum("m").alias("m"), F.sum("s").alias("s"))
    many = lambda m, s: F.greatest(F.ceil(m / block_rows), F.ceil(s / block_shingles) if block_shingles else F.lit(1)).cast("int")
    shape = total.select(by, F.col("z.c").alias("main"), "m", "s", many(F.col("m") - F.col("z.m"), F.col("s") - F.col("z.s")).alias("p"), many(F.col("m"), F.col("s")).alias("q"))
    shape = scratch.store(shape, f"{by}-shape")  # so that Spark can split the members of a large group
    small = shape.where("p = 1 and q = 1").agg(F.sum("m").alias("m"), F.sum("s").alias("s")).first()
    bins = max(1, -(-(small["m"] or 0) // block_rows), -(-(small["s"] or 0) // block_shingles) if block_shingles else 1)
    rows = members.join(shape.drop("m", "s"), by)
    own = lambda salt, n: F.pmod(F.xxhash64("sid", F.lit(salt)), F.col(n)).cast("int")
    whole = F.when((F.col("p") == 1) & (F.col("q") == 1), F.pmod(F.xxhash64(by), F.lit(bins))).otherwise(-1 - F.col(by).bitwiseAND((1 << 62) - 1))
    left = rows.where("c <> main").select(by, own(1, "p").alias("i"), F.explode(F.sequence(F.lit(0), F.col("q") - 1)).alias("j"), whole.alias("bin"), F.lit(True).alias("asks"), "sid", "n", "c")
    right = rows.select(by, F.explode(F.sequence(F.lit(0), F.col("p") - 1)).alias("i"), own(2, "q").alias("j"), whole.alias("bin"), F.lit(False).alias("asks"), "sid", "n", "c")
    return left.unionByName(right)


def blocks(pdf: pd.DataFrame, by: str) -> Iterator[pd.DataFrame]:
    """The groups in a bin."""
    pdf = pdf.sort_values(by, kind="stable")
    edges = np.flatnonzero(np.diff(pdf[by].to_numpy())) + 1
    for a, b in zip([0, *edges], [*edges, len(pdf)]):
        yield pdf.iloc[a:b]


def forest(pairs: Iterator[tuple[int, int]], sid: np.ndarray, names: np.ndarray) -> pd.DataFrame:
    """Of pairs of positions those that join two names not yet joined: a, b (of sid)."""
    top, edges = {}, []

    def root(x):
        while (up := top.setdefault(x, x)) != x:
            top[x] = x = top[up]
        return x

    for x, y in pairs:
        if (r := root(names[x])) != (q := root(names[y])):
            top[r] = q
            edges.append((min(sid[x], sid[y]), max(sid[x], sid[y])))
    return pd.DataFrame(edges, columns=["a", "b"]).astype("int64")


def collide(opened: DataFrame, nodes: DataFrame, scratch: Scratch, matches: int, percent: int, block_rows: int = 400) -> DataFrame:
    """opened (k, sid, n, c), posting lists with members of several components, to a, b: a spanning forest, block by block,
    of the pairs that collide in `matches` coordinates, are of different components, and may link by their sizes.

    Collisions are counted on signatures; no text takes part. Of lists with the same members one is taken.
    """
    bits = lambda salt: F.bit_xor(F.xxhash64("sid", F.lit(salt)))
    once = opened.groupBy("k").agg(F.count("*").alias("f"), bits(1).alias("x"), bits(2).alias("y")).groupBy("f", "x", "y").agg(F.min("k").alias("k")).select("k")
    members = scratch.store(opened.join(scratch.store(once, "once"), "k"), "listed")
    work = dealt(members, scratch, "k", block_rows).join(nodes.select("sid", "sig"), "sid")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k", kind="stable")
        sig, asks, k = np.stack(pdf["sig"].to_numpy()), pdf["asks"].to_numpy(), pdf["k"].to_numpy()
        sid, n, c = (pdf[x].to_numpy() for x in ("sid", "n", "c"))
        edges = np.flatnonzero(np.diff(k)) + 1
        lists = [(a + np.flatnonzero(asks[a:b]), a + np.flatnonzero(~asks[a:b])) for a, b in zip([0, *edges], [*edges, len(k)])]
        return forest(colliding(sig, n, c, lists, matches, percent), sid, sid)

    return work.groupBy("bin", "i", "j").applyInPandas(run, "a long, b long").distinct()


def colliding(sig: np.ndarray, n: np.ndarray, c: np.ndarray, lists: list[tuple[np.ndarray, np.ndarray]], matches: int, percent: int, at_once: int = 1 << 16) -> Iterator[tuple[int, int]]:
    """Pairs from the two sides of each list whose signatures collide often enough, of different components, of sizes that
    may link. They are looked at `at_once`."""
    pending: list[tuple[np.ndarray, np.ndarray]] = []

    def checked() -> Iterator[tuple[int, int]]:
        x, y = (np.concatenate(z) for z in zip(*pending)) if pending else (np.empty(0, np.int64),) * 2
        keep = (c[x] != c[y]) & (100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y]))
        x, y = x[keep], y[keep]
        for i in range(0, len(x), at_once):
            a, b = x[i : i + at_once], y[i : i + at_once]
            yield from zip(*(z[(sig[a] == sig[b]).sum(axis=1) >= matches].tolist() for z in (a, b)))

    size = 0
    for left, right in lists:
        pending.append((np.repeat(left, len(right)), np.tile(right, len(left))))
        size += len(left) * len(right)
        if size >= at_once:
            yield from checked()
            pending, size = [], 0
    yield from checked()


def compare(members: DataFrame, texts: DataFrame, scratch: Scratch, size: int, percent: int, block_rows: int = 400, block_shingles: int = 300_000) -> DataFrame:
    """members (sid, n, c, g) to edges a, b that join the components c of each group g wherever any two members link.

    Groups are dealt by hash to blocks of bounded size, and each pair of blocks is one task's work. Their intersections
    are products of 0/1 matrices over the shingles that occur twice. Of all links only a spanning forest is returned.
    """
    work = dealt(members, scratch, "g", block_rows, block_shingles).join(texts, "sid")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for one in blocks(pdf, "g"):
            found, asks = [shingles(x, size) for x in one["text"]], one["asks"].to_numpy()
            out.append(forest(linked_pairs(found, np.flatnonzero(asks), np.flatnonzero(~asks), percent), one["sid"].to_numpy(), one["c"].to_numpy()))
        return pd.concat(out)

    return work.groupBy("bin", "i", "j").applyInPandas(run, "a long, b long")


def linked_pairs(found: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int, width: int = 4096) -> Iterator[tuple[int, int]]:
    """Pairs from left and right that link."""
    n = np.array([len(x) for x in found])
    _, column, count = np.unique(np.concatenate(found), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(found)), n)
    often = np.cumsum(count >= 2) - 1  # new numbers of the shingles that occur twice
    keep = count[column] >= 2
    row, column = row[keep], often[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    inside = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        lo, hi = np.searchsorted(column, (at, at + width))
        m = np.zeros((len(found), width), np.float32)
        m[row[lo:hi], column[lo:hi] - at] = 1
        inside += m[left] @ m[right].T
    both = inside.astype(np.int64)
    ok = 100 * both >= percent * (n[left][:, None] + n[right][None, :] - both)
    for x, y in zip(*np.nonzero(ok)):
        yield left[x], right[y]


def _marked(df: DataFrame, scratch: Scratch, key: str, text: str, size: int = 5, percent: int = 80, coordinates: int = 64, matches: int = 34) -> DataFrame:
    """One row a document: the key, the tag, n, best (the key and tag that stand for its component)."""
    docs = tagged(only(df, key, text), key, text)
    each = scratch.store(sets(docs, key, text, size, coordinates), "sets")
    nodes = each.where("n > 0").groupBy("s1", "s2", "n").agg(F.min(F.struct(key, TAG)).alias("rep"), F.first("sig").alias("sig"))
    nodes = scratch.store(nodes.withColumn("sid", F.monotonically_increasing_id()), "nodes")
    each = scratch.store(each.drop("sig"), "rows")
    scratch.drop("sets")
    comp = link(nodes, docs, scratch, key, text, size, matches, percent)
    named = nodes.select("sid", "s1", "s2", "n", F.col("rep").alias("best")).join(comp, "sid", "left").withColumn("comp", F.coalesce("comp", "sid"))
    least = F.coalesce(F.min(F.when(F.col(f"best.{key}").isNotNull(), F.col("best"))), F.min("best"))  # a null key only if there is no other
    leaders = scratch.store(named.groupBy("comp").agg(least.alias("best")), "leaders")
    named = scratch.store(named.drop("best").join(leaders, "comp").select("s1", "s2", "n", "best"), "named")
    scratch.drop("nodes", "comp", "linked", "leaders")
    got = each.where("n > 0").join(named, ["s1", "s2", "n"]).select(key, TAG, "n", "best")
    return got.unionByName(each.where("n = 0").select(key, TAG, "n", F.struct(key, TAG).alias("best")))


def mark(df: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """One row a document: the key, n_shingles, component_id (the least key reachable), kept (whether that is its own)."""
    got = _marked(df, Scratch(df.sparkSession, "neardup"), key, text, **how).withColumn("component_id", F.col(f"best.{key}"))
    return got.select(key, F.col("n").alias("n_shingles"), "component_id", F.col(key).eqNullSafe(F.col("component_id")).alias("kept"))


def dedup(df: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The rows that stay, with all their columns: of each component one row, of its least key. Texts without words all stay."""
    scratch = Scratch(df.sparkSession, "neardup")
    own = F.col(key).eqNullSafe(F.col(f"best.{key}")) & (F.col(TAG) == F.col(f"best.{TAG}"))
    kept = _marked(df, scratch, key, text, **how).where(own).groupBy(key, TAG).agg(F.count("*").alias("_treefold_c"), F.max("n").alias("_treefold_n"))
    kept = scratch.store(kept, "kept")
    scratch.drop("rows", "named")
    rows, often = tagged(df, key, text), kept.where("_treefold_c > 1 and _treefold_n > 0").select(key, TAG)
    stay = _by_row(rows, kept.select(key, TAG), key, "left_semi")
    if not often.limit(1).count():
        return stay.drop(TAG)
    once = _by_row(stay, often, key, "left_semi").dropDuplicates([key, text])  # equal rows
    return _by_row(stay, often, key, "left_anti").unionByName(once).drop(TAG)
