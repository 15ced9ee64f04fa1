"""Every operator against brute force on small tables with nulls, empty and long texts, ties, repeated rows, no rows, and
extra columns whose names the operators use themselves."""

import hashlib
import random
import re
import zlib
from array import array
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from treefold.llm import ann, exactdup, langid, linecrf, neardup, packing, queries, revisit, substring, toxicity, wordbpe
from treefold.llm.common import Scratch, shares

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, sid long, _t int, _k string, fp long, row long"
WORDS = [a + b + c for a in ("ba", "de", "ki", "lo", "mu") for b in ("ra", "te", "si", "no", "pu") for c in ("", "n", "s", "th")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def table(spark, texts):
    """texts: (doc_id, text) pairs."""
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), i, 7, "k", 1, 2) for i, t in texts], SCHEMA)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    base, passage = prose(rng, 120), prose(rng, 60)
    out = [(1, None), (2, ""), (3, "   \n"), (4, "Word"), (5, "word"), (6, "wORD É"), (7, "word é"), (8, prose(rng, 20000)), (9, "x" * 30000)]
    out += [(10 + k, base) for k in range(6)] + [(20 + k, base.replace(" ", "  ", 1).upper()) for k in range(2)]
    for k in range(12):
        words = base.split()
        for _ in range(k):
            words[rng.randrange(len(words))] = "edit%d" % rng.randrange(99)
        out.append((30 + k, " ".join(words)))
    out += [(50 + k, f"{prose(rng, 40)} {passage} {prose(rng, 30)}") for k in range(5)]
    out += [(60, passage + "\t" + passage), (61, "a b c"), (62, "a b c"), (63, "a b c d"), (64, "again " * 200), (65, "\x1cnul\x00 \x85  x <|endoftext|>İ")]
    out += [(70, "twice the same row"), (70, "twice the same row"), (71, "one key"), (71, "two texts")]
    return out


# --- 1


def test_toxicity(spark):
    rng = random.Random(1)
    data = []
    for i in range(300):
        words = prose(rng, 60).split()
        for _ in range((i % 3 == 0) * (1 + i % 8)):
            words.insert(rng.randrange(60), rng.choice(("vile", "rotten", "foul")))
        data.append((i, " ".join(words)))
    docs = table(spark, [*data, (900, None), (901, ""), (0, data[0][1])])
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0), "x") for i in range(200)] + [(None, 1, 1, "x"), (900, None, None, "x")], "doc_id long, quality int, toxic int, text string")
    model = toxicity.fit(docs, labels)
    got = [r for r in toxicity.severity(docs, model).collect()]
    assert len(got) == 303
    held = {r["doc_id"]: r for r in got if 200 <= r["doc_id"] < 300}
    assert all(held[i]["toxic"] == (i % 3 == 0) for i in held)
    assert np.mean([held[i]["severity"] for i in held if i % 24 == 15]) > np.mean([held[i]["severity"] for i in held if i % 24 == 0])
    assert all(0 <= r["severity"] <= 2 for r in got) and not [r for r in got if r["doc_id"] > 899 and r["toxic"]]
    kept = toxicity.keep(docs, model)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in got if not r["toxic"]}
    assert toxicity.fit(docs, labels.where("toxic = 0")) is None
    assert toxicity.severity(docs.where("false"), None).count() == 0 and toxicity.keep(docs, None).count() == 303


def test_ordinal_gradient():
    rng = np.random.default_rng(0)
    ids = [rng.choice(6, rng.integers(0, 4), replace=False) for _ in range(2000)]
    true = np.array([2.0, -1, 0, 1, 3, -2])
    z = np.array([true[i].sum() for i in ids]) + rng.logistic(size=2000)
    w, cut = toxicity.fit_ordinal(ids, 6, (z > 0.5).astype(int) + (z > 2), 3, steps=800, decay=0)
    assert np.abs(w - true).max() < 0.4 and np.abs(cut - [0.5, 2]).max() < 0.3


def test_ordinal_fit_is_the_maximum():
    rng = np.random.default_rng(5)
    ids = [rng.choice(5, rng.integers(0, 4), replace=False) for _ in range(300)]
    y, weight = rng.integers(0, 3, 300), rng.integers(1, 5, 300).astype(float)
    w, cut = toxicity.fit_ordinal(ids, 5, y, 3, steps=3000, rate=0.02, decay=0.01, weight=weight)

    def value(w, cut):
        below = lambda k, z: 1.0 if k == 2 else 0.0 if k < 0 else 1 / (1 + np.exp(z - cut[k]))
        each = [np.log(below(k, w[i].sum()) - below(k - 1, w[i].sum())) for i, k in zip(ids, y)]
        return np.dot(weight / weight.mean(), each) / 300 - 0.005 * (w**2).sum()

    best = value(w, cut)
    for _ in range(50):
        assert value(w + rng.normal(size=5) * 0.03, cut + rng.normal(size=2) * 0.03) < best


def test_severity_is_that_of_the_definition(spark):
    rng = random.Random(2)
    model = toxicity.Ordinal(["vile", "rott*", "kitef", "ß"], np.array([1.5, 0.75, -2.0, 0.5]), np.array([1.0, 2.25]))
    texts = [(1, None), (2, ""), (3, "Vile, VILE vile_7"), (4, "rotten kitef ROTTER"), (5, "rott ß"), (6, prose(rng, 30000) + " vile!"), (7, "ﬀ \x00 \u2028vile\u2028")]
    for r in toxicity.severity(table(spark, texts), model).collect():
        words = set(re.findall(r"[^\W\d_]+", (dict(texts)[r["doc_id"]] or "").lower()))
        z = 1.5 * ("vile" in words) + 0.75 * any(w.startswith("rott") and len(w) > 4 for w in words) - 2 * ("kitef" in words) + 0.5 * ("ß" in words)
        above = [1 / (1 + np.exp(t - z)) for t in (1.0, 2.25)]
        assert abs(r["severity"] - sum(above)) < 1e-12 and r["toxic"] == (above[0] >= 0.5)
        assert r["grade"] == int(np.argmax([1 - above[0], above[0] - above[1], above[1]]))


def test_toxicity_at_the_real_rate(spark):
    rng = random.Random(12)
    chance = {0: 0.3, 1: 0.9}  # of the word, by label; one row in ten is toxic
    data = [(i, prose(rng, 12) + (" vile" if rng.random() < chance[int(i % 10 == 0)] else "")) for i in range(3000)]
    docs, labels = table(spark, data), spark.createDataFrame([(i, int(i % 10 == 0)) for i, _ in data], "doc_id long, toxic int")
    seen = table(spark, [(1, "vile")])
    want = np.mean([i % 10 == 0 for i, t in data if "vile" in t])
    for rows in (8000, 600):
        model = toxicity.fit(docs, labels, fit_rows=rows)
        assert not toxicity.severity(seen, model).first()["toxic"] and abs(toxicity.Scorer(model).above("vile")[0] - want) < 0.1


# --- 2 and 8


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.vocabulary())


def test_bpe(spark, texts, library):
    docs = table(spark, texts)
    got = wordbpe.round_trip(docs, queries.vocabulary(), digests=True).collect()
    assert len(got) == len(texts)
    want = Counter()
    for i, t in texts:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want[i, tuple(ids), library.decode(ids, skip_special_tokens=False)] += 1
    assert Counter((r["doc_id"], tuple(r["ids"]), r["decoded"]) for r in got) == want
    r = next(r for r in got if r["doc_id"] == 65)
    assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, r["ids"])).encode()).hexdigest() and r["decoded_sha256"] == hashlib.sha256(r["decoded"].encode()).hexdigest()
    assert wordbpe.round_trip(docs.where("false"), queries.vocabulary()).count() == 0


def test_bpe_random(library):
    bpe, rng = wordbpe.WordBPE(queries.vocabulary(), room=500), random.Random(3)
    pool = "abcdeéÉßİıſ ŉ'sT're0123²½ªº中文字ÀΣσς́̈\x1c\x85\xa0  <|endoftext|>\t\n!?$***😀×÷"
    for _ in range(3000):
        t = "".join(rng.choice(pool) for _ in range(rng.randint(0, 70)))
        assert array("I", bpe.encode(t)).tolist() == library.encode(t, add_special_tokens=False).ids
    for w in ("therewithal" * 9, "a" * 200):
        assert bpe.merge_long(bpe.symbols(w)) == [library.id_to_token(i) for i in library.encode(w, add_special_tokens=False).ids]
    assert any(len(bpe.fragments(bpe.visible(w))) > 1 for w in ("中文字", "тест", "naïveté"))


def best_fit_decreasing(sizes, room):
    return packing.from_nothing(sizes, packing.longest_first(sizes, np.arange(len(sizes))), room)


def test_packing(spark, texts, library):
    docs = table(spark, texts)
    got = packing.run(docs, queries.vocabulary(), room=64, ids=True, shard_rows=100).cache()
    rows = got.collect()
    want = Counter()
    for i, t in texts:
        ids = library.encode(t or "", add_special_tokens=False).ids + [1]
        for n, at in enumerate(range(0, len(ids), 64)):
            part = ids[at : at + 64]
            want[i, n, at, len(part), zlib.crc32(array("I", part).tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in bins.values():
        ends = [0, *np.cumsum([n for _, n in sorted(b)])]
        assert [at for at, _ in sorted(b)] == ends[:-1] and ends[-1] <= 64
    sizes = np.array([r["length"] for r in rows])
    assert len(bins) <= len(best_fit_decreasing(sizes, 64).fill)
    made = {r["sequence_id"]: len(r["ids"]) for r in packing.sequences(got).collect()}
    assert made == {k: sum(n for _, n in b) for k, b in bins.items()}
    assert packing.run(docs.where("false"), queries.vocabulary()).count() == 0


def whole(held, lengths, room):
    """Every item stands once, and the fillings are those of the items."""
    return len(held.label) == len(lengths) and held.label.min() == 0 and (np.bincount(held.label, lengths) == held.fill).all() and 0 < held.fill.min() <= held.fill.max() <= room


def test_genetic_operators():
    rng = np.random.default_rng(2)
    lengths = rng.integers(20, 61, 200)
    a, b = (packing.from_nothing(lengths, rng.permutation(200), 100) for _ in "ab")
    child = packing.crossover(lengths, a, b, 100, rng, share=0.2)
    come = [set(np.flatnonzero(b.label == k)) for k in range(len(b.fill))]
    assert sum(set(np.flatnonzero(child.label == k)) in come for k in range(len(child.fill))) >= len(b.fill) // 10  # whole bins of b
    for x in (a, b, child, packing.mutate(lengths, child, 100, rng), packing.read_labels(lengths, child.label)):
        assert whole(x, lengths, 100)
    one = packing.from_nothing(np.array([5]), np.array([0]), 100)
    assert whole(packing.evolve(np.array([5]), 100, [one], 1, 3, 5)[0], np.array([5]), 100)


def test_evolution_decides_the_packing():
    lengths = np.random.default_rng(0).integers(20, 61, 1500)
    plain = best_fit_decreasing(lengths, 100)
    first = [packing.evolve(lengths, 100, [], seed, 4, 60) for seed in range(3)]
    assert all(made == 60 and won > 0 and whole(x, lengths, 100) for x, made, won in first)
    assert min(len(x.fill) for x, _, _ in first) < len(plain.fill)
    start = [x for x, _, _ in first]
    alone = [packing.evolve(lengths, 100, [start[k]], 9 + k, 4, 60)[0] for k in range(3)]
    moved = [packing.evolve(lengths, 100, [start[k], start[k - 1]], 9 + k, 4, 60)[0] for k in range(3)]  # with the elite of the island before
    score = lambda x: packing.fitness(x, 100)
    assert any((a.label != m.label).any() for a, m in zip(alone, moved)) and max(map(score, moved)) > max(map(score, start))


def test_packing_evolves_where_best_fit_meets_the_bound(spark, tmp_path):
    rng = random.Random(3)
    data = [(k, rng.randint(1, 4000)) for k in range(3000)]
    found, stats = spark.createDataFrame(data, "_row long, length long"), {}
    got = packing.pack(found, Scratch(spark, "test"), 4096, shard_rows=700, generations=20, stats=stats).collect()
    bins = len({r["sequence_id"] for r in got})
    assert len(got) == 3000 and bins <= len(best_fit_decreasing(np.array([n for _, n in data]), 4096).fill) * 1.02  # in shards of 700
    assert stats["crossed"] >= 5 * 3 * 2 * 20 and stats["won"] > 0
    alike = spark.createDataFrame([(k, 1) for k in range(500)], "_row long, length long")
    assert packing.pack(alike, Scratch(spark, "test"), 10**6, shard_rows=100).select("sequence_id").distinct().count() <= 8


# --- 3


def fold(t):
    return (t or "").encode().lower()


@pytest.mark.parametrize("block", [16, 16384])
def test_exact(spark, texts, block):
    got = exactdup.mark(table(spark, texts), block=block).collect()
    groups = {}
    for i, t in texts:
        groups.setdefault(fold(t), []).append(i)
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == Counter((i, max(groups[fold(t)]), len(groups[fold(t)]), hashlib.sha256(fold(t)).hexdigest()) for i, t in texts)
    assert Counter(r["text_sha256"] for r in got if r["kept"]) == Counter(hashlib.sha256(t).hexdigest() for t in groups)


def test_exact_dedup(spark, texts):
    docs = table(spark, texts)
    kept = exactdup.dedup(docs)
    assert kept.columns == docs.columns
    assert Counter(fold(r["text"]) for r in kept.collect()) == Counter({fold(t) for _, t in texts})
    assert exactdup.dedup(docs.where("false")).count() == 0 and exactdup.mark(docs.where("false")).count() == 0
    odd = spark.createDataFrame([(None, "A"), (None, "a"), (3, "a")], "doc_id long, text string")
    assert [(r["doc_id"], r["keep_id"]) for r in exactdup.mark(odd).collect() if r["kept"]] == [(3, 3)]


# --- 9


def brute_windows(texts, window):
    words = [fold_words(t) for _, t in texts]
    count = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (i, _), w in zip(texts, words):
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if count[tuple(w[k : k + window])] > 1:
                gone[k : k + window] = [True] * window
        out.append((i, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    return Counter(out)


def fold_words(t):
    return (t or "").encode().split()


@pytest.mark.parametrize("window,gram,batches,fan", [(35, 10, 3, 3), (7, 3, 4, 2)])
def test_substring(spark, texts, window, gram, batches, fan):
    got = substring.mark(table(spark, texts), window=window, gram=gram, batches=batches, fan=fan)
    assert Counter(map(tuple, got.collect())) == brute_windows(texts, window)


def test_substring_texts(spark, texts):
    docs = table(spark, texts)
    got = substring.remove(docs)
    assert got.columns == docs.columns and got.count() == len(texts)
    by = {r["doc_id"]: r for r in got.collect()}
    assert by[4]["text"] == "Word" and by[1]["text"] is None and by[8]["text"] == dict(texts)[8] and by[8]["_t"] == 7 and by[8]["_k"] == "k"
    assert by[10]["text"] == "" and len(by[51]["text"].split()) <= 70
    assert substring.mark(docs.where("false")).count() == 0


def brute_batch(history, batch, window):
    """The batch's texts without the words of windows that also start elsewhere, in it or in history."""
    count = Counter(tuple(w[i : i + window]) for _, t in [*history, *batch] for w in [fold_words(t)] for i in range(len(w) - window + 1))
    out = Counter()
    for i, t in batch:
        w = fold_words(t)
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if count[tuple(w[k : k + window])] > 1:
                gone[k : k + window] = [True] * window
        out[i, b" ".join(x for x, g in zip(w, gone) if not g)] += 1
    return out


def test_index_outlives_the_call(spark, texts, tmp_path):
    rng, path = random.Random(40), str(tmp_path / "index")
    shuffled = rng.sample(texts, len(texts))
    batches = [shuffled[:20], [(900, "nothing that repeats")], shuffled[20:40], shuffled[40:], [], [(901, shuffled[5][1]), (902, prose(rng, 60))]]
    history = []
    for k, batch in enumerate(batches):
        rows = table(spark, batch)
        got = substring.extend(rows, path, table(spark, history) if k else None, window=12, gram=4, fan=2)
        assert got.columns == rows.columns
        assert Counter((r["doc_id"], b" ".join(fold_words(r["text"]))) for r in got.collect()) == brute_batch(history, batch, 12), k
        history += batch
    index = substring.Index.open(spark, path, 4, 2, window=12, gram=4, key="doc_id")
    assert len(index.runs) < len(batches) and max(t for _, t in index.runs) >= 2 and len(index.made) == len(batches)
    with pytest.raises(ValueError, match="was made with"):
        substring.extend(rows, path, None, window=13, gram=4)


def test_compaction_merges_runs(spark):
    index = substring.Index(Scratch(spark, "runs"), 4, fan=3)
    for k in range(3):
        index.add(spark.range(10 * k, 100).select(F.col("id").alias("fp")))
    index.compact()
    [(run, tier)] = index.runs
    assert tier == 1 and {tuple(r) for r in spark.table(run).collect()} == {(x, 1 + (x >= 10) + (x >= 20)) for x in range(100)} and spark.table(run).count() == 100
    index.close()


def test_a_call_writes_few_files(spark, texts, monkeypatch):
    """No run is compacted that nothing reads, and lists of keys don't get a file for each partition of a shuffle."""
    files, tiers, store, write = {}, [], Scratch.store, substring.Index.write

    def stored(self, df, name, *by, **how):
        out = store(self, df, name, *by, **how)
        files[name] = len(out.inputFiles())
        return out

    monkeypatch.setattr(Scratch, "store", stored)
    monkeypatch.setattr(substring.Index, "write", lambda self, counts, tier: tiers.append(tier) or write(self, counts, tier))
    docs = table(spark, texts)
    held = {"spark.sql.shuffle.partitions": "160", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        got = Counter(map(tuple, substring.mark(docs, window=12, gram=4).collect()))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == brute_windows(texts, 12)
    assert tiers == [0, 0, 0] and not [n for n in files if n.startswith("shared")]
    assert max(files[n] for n in ("hits-shared", "several", "twice", "gone")) <= 40, files


def test_a_batch_that_failed_can_come_again(spark, tmp_path):
    path, rng = str(tmp_path / "index"), random.Random(41)
    passage = prose(rng, 50)
    first, second = [(1, f"{passage} one")], [(2, f"two {passage}")]
    substring.extend(table(spark, first), path, None, window=12, gram=4)
    index = substring.Index.open(spark, path, 4, 3, window=12, gram=4, key="doc_id")
    index.add(index.keep(substring.post(substring.tagged(table(spark, second), "doc_id", "text"), "doc_id", "text", 12, 4)))  # never saved
    for batch, left in ((second, "two"), ([(3, f"three {passage}")], "three")):
        spark.sql(f"DROP TABLE IF EXISTS {index.runs[0][0]}")  # as in another session
        got = substring.extend(table(spark, batch), path, table(spark, first), window=12, gram=4)
        assert [r["text"] for r in got.collect()] == [left]
        first += batch


def test_fingerprints_that_collide(spark, texts, monkeypatch):
    """Whatever has one fingerprint is still told apart by the other hash."""

    def few(self, words):
        a, b = real(self, words)
        return a % np.uint64(3), b

    real = substring.WordHashes.of
    monkeypatch.setattr(substring.WordHashes, "of", few)
    same, other = [b"a%d" % i for i in range(60)], [b"b%d" % i for i in range(60)]
    hashes = substring.WordHashes()
    got = [substring.regions(*hashes.of(w), 12, 4) for w in (same, other, same)]
    assert set(got[0][0]) & set(got[1][0]) and (got[0][1] == got[2][1]).all() and not set(got[0][1]) & set(got[1][1])


# --- 10


def brute_links(texts, size, percent):
    sets = []
    for _, t in texts:
        w = fold(t).split()
        sets.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    comp = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                comp = [comp[a] if c == comp[b] else c for c in comp]
    least = {c: min(texts[k][0] for k in range(len(texts)) if comp[k] == c) for c in set(comp)}
    return Counter((texts[k][0], len(sets[k]), least[comp[k]]) for k in range(len(texts)))


@pytest.mark.parametrize("size", [4, 5])
def test_near(spark, texts, size):
    got = neardup.mark(table(spark, texts), size=size).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute_links(texts, size, 80)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_dedup(spark, texts):
    docs = table(spark, texts)
    assert neardup.dedup(docs).columns == docs.columns
    assert neardup.mark(docs.where("false")).count() == 0 and neardup.mark(docs.where("doc_id < 4")).count() == 3


def test_near_dedup_repeated_keys(spark):
    rng = random.Random(21)
    a, b, c, d = (prose(rng, 80) for _ in range(4))
    rows = [(1, a), (2, a + " more"), (2, b), (3, c), (3, c), (4, ""), (4, ""), (5, d), (5, d + " more")]
    got = Counter((r["doc_id"], r["text"]) for r in neardup.dedup(table(spark, rows)).collect())
    last = [t for i, t in got if i == 5]
    assert len(last) == 1 and got == Counter([(1, a), (2, b), (3, c), (4, ""), (4, ""), (5, last[0])])


def test_blocks_find_what_pairs_find():
    rng = np.random.default_rng(1)
    found = [np.unique(rng.integers(0, 60, 50).astype(np.uint64)) for _ in range(40)]
    pairs = {(a, b) for a in range(20) for b in range(20, 40) if 100 * len(np.intersect1d(found[a], found[b])) >= 50 * len(np.union1d(found[a], found[b]))}
    assert pairs and set(neardup.linked_pairs(found, np.arange(20), np.arange(20, 40), 50, width=7)) == pairs


def test_collisions_are_counted_by_coordinate():
    rng = np.random.default_rng(3)
    sig, n, c = rng.integers(0, 3, (60, 64)), rng.integers(90, 130, 60), rng.integers(0, 9, 60)
    want = {(a, b) for a in range(25) for b in range(60) if (sig[a] == sig[b]).sum() >= 24 and c[a] != c[b] and 100 * min(n[a], n[b]) >= 80 * max(n[a], n[b])}
    for at_once in (7, 1 << 16):
        lists = [(np.arange(9), np.arange(60)), (np.arange(9, 25), np.arange(31)), (np.arange(9, 25), np.arange(31, 60))]
        assert want and set(neardup.colliding(sig, n, c, lists, 24, 80, at_once)) == want


@pytest.mark.parametrize("rows", [2, 5, 400])
def test_any_two_members_of_different_components_meet(spark, rows):
    rng = random.Random(rows)
    data = [(g, 100 * g + s, 10, rng.choice((1, 1, 1, s))) for g in range(3) for s in range(12)]
    got = neardup.dealt(spark.createDataFrame(data, "g long, sid long, n long, c long"), Scratch(spark, "test"), "g", rows, 60 if rows == 5 else None).collect()
    assert all(len({(r["g"], r["i"], r["j"]) for r in got if r["bin"] == b}) <= (3 if b >= 0 else 50) and len({r["g"] for r in got if r["bin"] == b}) <= (3 if b >= 0 else 1) for b in {r["bin"] for r in got})
    met, blocks = set(), {}
    for r in got:
        blocks.setdefault((r["g"], r["i"], r["j"]), ([], []))[r["asks"]].append((r["sid"], r["c"]))
    for theirs, asks in blocks.values():
        met |= {frozenset((a, b)) for a, x in asks for b, y in theirs if x != y}
    assert met == {frozenset((a[1], b[1])) for a in data for b in data if a[0] == b[0] and a[3] != b[3]}


def test_components(spark, tmp_path):
    rng = random.Random(17)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(40)] + [(2000, 2000 + i) for i in range(50)]
    top = {x: x for e in edges for x in e}
    for _ in edges:
        for a, b in edges:
            top[a] = top[b] = min(top[a], top[b])
    got = neardup.components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "test"), "x").collect()
    assert {r["node"]: r["comp"] for r in got} == {x: t for x, t in top.items() if any(x in e and e[0] != e[1] for e in edges)} and len(got) == len({r["node"] for r in got})
    assert neardup.components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "test"), "y").count() == 0


def test_families_that_hardly_differ(spark):
    """Links that are found only when members of a list are compared with each other, not with its pivot."""
    rng = random.Random(31)
    texts = []
    for family in range(4):
        base = prose(rng, 150).split()
        for k in range(25):
            words = list(base)
            for at in rng.sample(range(150), 4 + k % 6):
                words[at] = "edit%d" % rng.randrange(10**6)
            texts.append((family * 100 + k, " ".join(words)))
    got = neardup.mark(table(spark, texts), size=4).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute_links(texts, 4, 80)
    assert len({r["component_id"] for r in got}) > 8


# --- 4


def test_revisits(spark):
    rng, rows = random.Random(9), []
    for k in range(400):
        kind = rng.choice(("response", "revisit", "revisit"))
        url = rng.choice(("http://www.A.com/x/", "https://a.com/x?utm_source=1#f", "a.com:443/x", "http://b.org/?b=2&a=1", "http://b.org?a=1&b=2", None))
        rows.append((k, url, rng.choice((None, *range(60))), rng.choice((kind, kind, kind, None)), rng.choice((None, '"e1"', 'W/"e1"', '"e2"')), rng.choice((None, "d1", "d2")), rng.choice((None, "s1", "s1", "s2")), rng.choice((None, {"A": "1", "Content-Length": str(k)}, {"a": "2", "B": "3"}, {"SET": "1", "Set": "2", "b": "4", "set": str(k)}))))
    schema = "id long, url string, ts long, kind string, etag string, last_modified string, digest string, headers map<string,string>"
    listed = [(*r[:7], r[7] and list(r[7].items())) for r in rows]  # a map would lose the order
    caps = spark.createDataFrame(listed, schema.replace("map<string,string>", "array<struct<key:string,value:string>>")).withColumn("headers", F.map_from_entries("headers"))
    caps = caps.withColumn("r", F.lit(1)).withColumn("slice", F.lit("x"))
    canon = lambda u: {None: None, "b": "b.org?a=1&b=2"}.get(u and u[7], "a.com/x")
    tag = lambda x: x and re.sub("^W/", "", x)
    want = {}
    for i, url, ts, kind, etag, lm, digest, _ in rows:
        if kind == "response":
            continue
        before = [r for r in rows if r[3] == "response" and r[2] is not None and ts is not None and r[2] < ts and canon(r[1]) == canon(url)]
        if not before:
            want[i] = (None, "no_response")
            continue
        r = max(before, key=lambda r: (r[2], r[0]))
        strong = [a == b for a, b in ((tag(etag), tag(r[4])), (digest, r[6])) if a is not None and b is not None]
        dates = [lm == r[5]] if lm is not None and r[5] is not None else []
        test = strong or dates
        want[i] = (r[0], "unchecked" if not test else "resolved" if all(test) else "mismatch")
    for slices in (1, 7, 256):
        got = revisit.resolve(caps, slices).collect()
        assert {r["id"]: (r["response_id"], r["status"]) for r in got} == want and len(got) == len(want)
    by = {r[0]: r for r in rows}
    for r in got:
        if r["status"] == "resolved":
            fields = [{k.lower(): v for k, v in (by[i][7] or {}).items()} for i in (r["response_id"], r["id"])]
            assert r["headers"] == fields[0] | {k: v for k, v in fields[1].items() if k != "content-length"}
    assert revisit.resolve(caps.where("false")).count() == 0


def test_one_hot_url_at_odd_times(spark):
    """Ties, repeated rows, one capture long before all others, and nulls in every column."""
    schema = "id long, url string, ts long, kind string, etag string, last_modified string, digest string, headers map<string,string>"
    rows = [(0, "u.org", -(10**15), "response", "first", None, None, None)]
    rows += [(k, "u.org", 1000 + k // 4, "response" if k % 4 == 0 else "revisit", None, None, None, None) for k in range(1, 800)]
    rows += [(900, "u.org", 1500, "response", "a", None, "d1", None), (900, "u.org", 1500, "response", "b", None, None, None), (901, "u.org", 1501, "revisit", "b", None, None, None)]
    rows += [(902, "u.org", 1501, "revisit", "b", None, None, None)] * 2 + [(None, None, None, None, None, None, None, None), (903, None, 5, "revisit", None, None, None, {})]
    got = revisit.resolve(spark.createDataFrame(rows, schema), 16).collect()
    by = Counter((r["id"], r["response_id"], r["status"]) for r in got)
    full = {}
    for k in range(1, 800):
        if k % 4 == 0:
            full[1000 + k // 4] = k
    for k in range(1, 800):
        if k % 4:
            before = [t for t in full if t < 1000 + k // 4]
            assert by[k, full[max(before)] if before else 0, "unchecked"] == 1
    assert by[901, 900, "resolved"] == 1 and by[902, 900, "resolved"] == 2 and by[None, None, "no_response"] == 1 and by[903, None, "no_response"] == 1
    assert next(r["digest"] for r in got if r["id"] == 901) is None  # of two responses with one id and time, that with the larger validators


# --- 5


def test_neighbours(spark):
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(8, 16)) * 3
    x = (centre[rng.integers(0, 8, 1200)] + rng.normal(size=(1200, 16))).astype(np.float32)
    x[100] = x[99]
    data = [(int(i), v.tolist(), 0) for i, v in enumerate(x)]
    data += [(2000, None, 0), (2020, [0.0] * 16, 0), (2040, [float("nan")] * 16, 0), (2060, [None] * 16, 0), (2080, [float("inf")] * 16, 0)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, part int")
    got = ann.search(df, df.where("vec_id % 20 = 0"), parts=8, block=200).collect()
    found = {}
    for r in got:
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(found) == set(range(0, 1200, 20))
    x, hits = x.astype(float), 0
    for q, rows in found.items():
        rows.sort()
        score = (x * x[q]).sum(1)
        best = [i for i in np.lexsort((np.arange(1200), -score)) if i != q][:20]
        hits += len(set(best) & {i for _, i, _ in rows})
        assert [k for k, _, _ in rows] == list(range(1, 21)) and all(abs(score[i] - s) < 1e-9 for _, i, s in rows)
        assert [(-s, i) for _, i, s in rows] == sorted((-s, i) for _, i, s in rows)
    assert hits >= 0.9 * 20 * len(found)
    assert ann.search(df.where("false"), df.where("false")).count() == 0
    few = ann.search(df.where("vec_id < 5"), df.where("vec_id = 0")).collect()
    assert len(few) == 4
    for n in (1, 2, 20, 21, 25, 40):
        some = df.where(f"vec_id < {n}")
        assert ann.search(some, some).count() == n * min(20, n - 1), n


def exact(data, queries, top):
    """(query, rank, id) by comparing everything."""
    out = Counter()
    for q, v in queries:
        best = sorted((-sum(a * b for a, b in zip(v, x)), i) for i, x in data if i != q)[:top]
        out.update((q, k + 1, i) for k, (_, i) in enumerate(best))
    return out


def test_odd_vectors(spark):
    rng = np.random.default_rng(7)
    data = [(int(i), v.tolist()) for i, v in enumerate((rng.normal(size=(60, 4)) * 2).round() / 2 + 0.25)]  # sums are exact
    data += [(7, [0.5, 0.5, 0.5, 0.5]), (7, [-1.0, 0.0, 2.0, 0.125]), (8, data[8][1]), (100, data[3][1]), (101, data[3][1])]  # repeated ids, rows and vectors
    odd = [(200, [1.0]), (201, [1.0] * 9), (202, []), (203, [5.0] * 3)]
    df = spark.createDataFrame(data + odd, "vec_id long, embedding array<double>")
    asked = [x for x in data if x[0] in (3, 7, 8, 100)]
    got = ann.search(df, df.where("vec_id in (3, 7, 8, 100, 200, 203)"), top=5, recall=1.0).collect()
    assert Counter((r["query_id"], r["rank"], r["vec_id"]) for r in got) == exact(data, asked, 5)


def test_products_that_overflow(spark):
    data = [(i, [1e200 * (1 if i < 8 else -1), 1.0 + i, 1e-200]) for i in range(12)] + [(20, [1e-180, 3.0, 1.0]), (21, [0.0, 2.0, 1e300])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    got = ann.search(df, df, top=3).collect()
    by = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        by.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert len(by) == 14 and all(len(x) == 3 for x in by.values())
    assert by[5] == [(0, np.inf), (1, np.inf), (2, np.inf)] and by[9] == [(8, np.inf), (10, np.inf), (11, np.inf)] and by[21][0] == (20, 1e300 + 6.0)


def test_recall_on_the_given_vectors(spark):
    for sf in ("sf0.001", "sf0.1"):
        rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").collect()]
        ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
        got = {}
        for r in queries.Q["op5_learned_partitions"](spark, f"/root/testdata/{sf}").collect():
            got.setdefault(r["query_id"], set()).add(r["vec_id"])
        hits = 0
        for q in np.flatnonzero(ids % 20 == 0):
            s = (x * x[q]).sum(axis=1)
            hits += len(got[ids[q]] & set(ids[[i for i in np.lexsort((ids, -s)) if i != q][:20]].tolist()))
        assert hits >= 0.9 * 20 * len(got) and len(got) == (ids % 20 == 0).sum()


def test_parts_are_balanced():
    x = np.random.default_rng(1).normal(size=(640, 8))
    label = ann.balanced_parts(x, ann.neighbour_graph(x, 5), 8)
    assert np.bincount(label, minlength=8).max() <= 92


# --- 6 and 7


def test_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = queries.Q["op6_language_id"](spark, "/root/testdata/sf0.001").join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got) and len(got) == docs.count()
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.95 and all(0 <= r["score"] <= 1 for r in got)
    model = langid.fit(docs)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !? ½"), (4, "the the the"), (4, "the the the")], "doc_id long, text string").withColumn("lang_pred", F.lit(0))
    assert [r["lang_pred"] for r in langid.predict(odd, model).orderBy("doc_id").collect()] == ["und", "und", "und", "en", "en"]
    assert langid.fit(docs.where("false")) is None and langid.predict(odd, None).where("lang_pred <> 'und'").count() == 0


def test_rare_language(spark):
    rng, other = random.Random(5), ("xoz", "wyv", "zuxy", "quoj", "vywo", "jyx")
    data = [(i, prose(rng, 30), "aa") for i in range(3000)] + [(5000 + i, " ".join(rng.choice(other) for _ in range(30)), "zz") for i in range(3)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string")
    for how in ({"fit_rows": 100}, {}):
        model = langid.fit(docs, **how)
        assert model.languages == ["aa", "zz"] and {w for w, at in model.places[0].items() if model.logs[at, 1] > model.logs[at, 0]} & set(other), how
        assert [r["lang_pred"] for r in langid.predict(docs.where("doc_id >= 5000"), model).collect()] == ["zz"] * 3
    assert shares({"a": 900, "b": 3, "c": 500}, 100) == {"a": 49, "b": 3, "c": 48} and shares({"a": 9, "b": 90}, 4, 5) == {"a": 5, "b": 5}


def test_language_scores_are_those_of_the_definition(spark):
    rng = random.Random(14)
    data = [(i, " ".join(prose(rng, 1) + rng.choice(("x", "ya", "")) * (i % 2) for _ in range(12)), "ab"[i % 2] * 2) for i in range(60)]
    model = langid.fit(spark.createDataFrame(data, "doc_id long, text string, lang string"))
    count = Counter()
    for _, t, lang in data:
        for w in t.split():
            count[lang, 0, w] += 1
            count.update((lang, n, f"^{w}$"[i : i + n]) for n in range(1, 5) for i in range(len(w) + 3 - n))
    count = Counter({k: c for k, c in count.items() if c >= 2 or k[1] in (1, 2)})
    known = [{k[2] for k in count if k[1] == n} for n in range(5)]
    total = {(lang, n): sum(c for k, c in count.items() if k[:2] == (lang, n)) for lang in ("aa", "bb") for n in range(5)}

    def log(lang, n, g):
        return np.log((count[lang, n, g] + 0.1) / (total[lang, n] + 0.1 * len(known[n])))

    def word(lang, w):
        if w in known[0]:
            return log(lang, 0, w)
        p, out = f"^{w}$", 0
        for i in range(len(p)):
            n = next((n for n in (4, 3, 2, 1) if i + n <= len(p) and p[i : i + n] in known[n]), None)
            out += log(lang, n, p[i : i + n]) * 0.7 ** (4 - n) if n else 0
        return out / len(p)

    texts = [(1, "Baran, quxo!"), (2, "Zzya kitex-lon ßß ñ"), (3, "bara" * 40), (4, "mupuya " * 3000), (5, "?"), (6, data[1][1])]
    got = {r["doc_id"]: r for r in langid.predict(spark.createDataFrame(texts, "doc_id long, text string"), model).collect()}
    for i, t in texts:
        found = re.findall(r"[^\W\d_]+", t.lower())
        if not found:
            assert got[i]["lang_pred"] == "und" and got[i]["score"] == 0
            continue
        z = {lang: sum(word(lang, w) for w in found) / len(found) ** 0.5 for lang in ("aa", "bb")}
        best = max(z, key=z.get)
        assert got[i]["lang_pred"] == best and abs(got[i]["score"] - 1 / sum(np.exp(v - z[best]) for v in z.values())) < 1e-9, t


def test_chunk_cache_is_bounded(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "uno dos tres " + "a" * i, "es") for i in range(9)] + [(20, "one two three", "en")], "doc_id long, text string, lang string")
    model = langid.fit(docs)
    want = langid.Chunks(model).total(" ".join(WORDS * 3))
    monkeypatch.setattr(langid, "HELD", 10)
    small = langid.Chunks(model)
    assert np.allclose(small.total(" ".join(WORDS * 3)), want) and len(small.place) <= 20


def test_predictions_on_no_rows(spark):
    docs = spark.createDataFrame([(1, "uno dos", "es"), (2, "one two", "en")], "doc_id long, text string, lang string")
    none = docs.where("false")
    assert langid.predict(none, langid.fit(docs)).count() == 0 and linecrf.score(none, None).count() == 0


def test_quality(spark):
    sf = "/root/testdata/sf0.01"
    lab = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = queries.Q["op7_quality_crf"](spark, sf).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    held = [(r["predicted"], lab[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in lab]
    assert np.mean([a == b for a, b in held]) > 0.95 and all(r["predicted"] == (r["score"] >= 0.5) for r in got)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "\n\n\n"), (4, "x" * 10**5), (4, "y\n" * 5000)], "doc_id long, text string")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = linecrf.fit(docs, labels, fit_rows=200)
    assert all(0 <= r["score"] <= 1 for r in linecrf.score(odd, model).collect())
    assert linecrf.fit(docs, labels.where("quality = 1")) is None and linecrf.score(odd, None).where("score <> 0.5").count() == 0


def test_marginals_are_those_of_all_labellings():
    rng = np.random.default_rng(2)
    unary, table_ = rng.normal(size=(5, 2)), rng.normal(size=(2, 2))
    weight = {}
    for code in range(32):
        y = [(code >> k) & 1 for k in range(5)]
        weight[tuple(y)] = np.exp(sum(unary[k, v] for k, v in enumerate(y)) + sum(table_[a, b] for a, b in zip(y, y[1:])))
    want = [sum(v for y, v in weight.items() if y[k]) / sum(weight.values()) for k in range(5)]
    assert np.allclose(linecrf.marginals(unary, table_), want)


def test_chain_of_all_documents_is_each_of_them_alone():
    rng, size = np.random.default_rng(6), (1, 7, 300, 2, 90)
    z, fresh, table_ = rng.normal(size=sum(size)) * 3, np.zeros(sum(size), bool), rng.normal(size=(2, 2))
    ends = np.cumsum(size)
    fresh[ends - size] = True
    last = np.roll(fresh, -1)
    odds = linecrf.forward(z, fresh, table_) + linecrf.forward(z[::-1], last[::-1], table_.T)[::-1] - z
    alone = [linecrf.marginals(np.stack((-x / 2, x / 2), axis=1), table_) for x in np.split(z, ends[:-1])]
    assert np.allclose(1 / (1 + np.exp(-odds)), np.concatenate(alone))


def log_likelihood(seqs, y, label, w, table, decay):
    """Of whole labellings, by trying them all; documents of both labels weigh the same."""
    total, at = 0.0, 0
    for own, k in zip(seqs, y):
        n, x = len(own), linecrf.beside(own)
        z = x @ w
        value = lambda v: sum((z[i] / 2 if b else -z[i] / 2) for i, b in enumerate(v)) + sum(table[a, b] for a, b in zip(v, v[1:]))  # noqa: B023, E731
        every = [value([(c >> i) & 1 for i in range(n)]) for c in range(1 << n)]
        total += 0.5 / (y == k).sum() / n * (value(label[at : at + n]) - np.logaddexp.reduce(every))
        at += n
    return total - decay / 2 * ((w**2).sum() + (table**2).sum())


def test_training_finds_the_maximum():
    rng = np.random.default_rng(9)
    y = np.array([0, 1, 0, 1, 1, 0, 1])
    seqs = [rng.normal(size=(n, linecrf.OWN)) for n in (1, 4, 5, 2, 3, 4, 1)]
    label = np.where(rng.random(20) < 0.3, 1 - np.repeat(y, [len(s) for s in seqs]), np.repeat(y, [len(s) for s in seqs]))
    w, table = linecrf.train(seqs, y, label, steps=3000, rate=0.02, decay=0.05)
    best = log_likelihood(seqs, y, label, w, table, 0.05)
    assert best > log_likelihood(seqs, y, label, 0 * w, 0 * table, 0.05) + 0.05
    for _ in range(40):
        dw, dt = rng.normal(size=w.shape) * 0.02, rng.normal(size=(2, 2)) * 0.02
        assert log_likelihood(seqs, y, label, w + dw, table + dt, 0.05) < best


def test_a_document_is_the_weighted_mean_of_its_lines():
    rng = np.random.default_rng(10)
    crf = linecrf.Crf(rng.normal(size=3 * linecrf.OWN), rng.normal(size=(2, 2)), 0.7, -0.2)
    text = "one line\n\nA longer Line, 12!\none line\nß ü"
    x, length = linecrf.features(text)
    assert length.tolist() == [len(t.encode()) + 1 for t in text.split("\n")]
    z, total = x @ crf.weights, Counter()
    for c in range(1 << 5):
        v = [(c >> i) & 1 for i in range(5)]
        p = np.exp(sum(z[i] * (b - 0.5) for i, b in enumerate(v)) + sum(crf.table[a, b] for a, b in zip(v, v[1:])))
        total.update({i: p * b for i, b in enumerate(v)} | {"all": p})
    mean = sum(total[i] / total["all"] * length[i] for i in range(5)) / length.sum()
    assert abs(crf.mean(x, length) - mean) < 1e-9
    assert abs(crf.score(text) - 1 / (1 + np.exp(-(0.7 * np.log(mean / (1 - mean)) - 0.2)))) < 1e-9


def test_good_lines_of_bad_documents(spark):
    rng = random.Random(18)
    data = [(str(i), "\n".join(prose(rng, 8) if i % 2 or k < 6 else "## 12 %% 99 $$" for k in range(12))) for i in range(60)]
    docs = spark.createDataFrame(data, "doc_id string, text string")
    crf = linecrf.fit(docs, spark.createDataFrame([(str(i), i % 2) for i in range(60)], "doc_id string, quality int"))
    x, _ = linecrf.features(data[0][1])
    z = x @ crf.weights
    assert ((linecrf.marginals(np.stack((-z / 2, z / 2), axis=1), crf.table) > 0.5) == [True] * 6 + [False] * 6).all()


def test_quality_learns_from_all_lines(spark):
    rng = random.Random(8)
    clean = lambda n: [prose(rng, 8) for _ in range(n)]
    junk = lambda n: ["$$ 99 ## 12 %% " * rng.randint(2, 4) for _ in range(n)]
    data = [(i, "\n".join(clean(60) + (junk(60) if i % 2 else clean(60)))) for i in range(120)]  # all alike up to line 60
    docs = table(spark, data)
    labels = spark.createDataFrame([(i, (i + 1) % 2) for i in range(80)], "doc_id long, quality int")
    got = {r["doc_id"]: r["predicted"] for r in linecrf.score(docs, linecrf.fit(docs, labels)).collect()}
    assert all(got[i] == (i + 1) % 2 for i in range(80, 120))


def test_quality_at_the_real_rate(spark):
    rng = random.Random(13)
    chance = {0: 0.9, 1: 0.3}  # of a junk text, by label; one document in ten is bad
    data = [(i, "## 12 %% 99 $$" if rng.random() < chance[int(i % 10 > 0)] else prose(rng, 8)) for i in range(2000)]
    docs, labels = table(spark, data), spark.createDataFrame([(i, int(i % 10 > 0)) for i, _ in data], "doc_id long, quality int")
    want = np.mean([i % 10 > 0 for i, t in data if "#" in t])
    for rows in (4000, 400):
        got = linecrf.fit(docs, labels, fit_rows=rows).score("## 12 %% 99 $$")
        assert got >= 0.5 and abs(got - want) < 0.12


# --- the pipeline


def test_pipeline(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, now, sf).cache()
        assert after.columns == docs.columns, name
        before = [(r["doc_id"], r["text"]) for r in now.collect()]
        kept = {r["doc_id"]: r["text"] for r in after.collect()}
        if name == "exact_dedup":
            groups = {}
            for i, t in before:
                groups[fold(t)] = max(i, groups.get(fold(t), -1))
            assert set(kept) == set(groups.values())
        elif name == "near_dedup":
            assert set(kept) == {i for i, _, c in brute_links(before, 5, 80) if i == c}
        elif name == "substring_dedup":
            assert {(i, hashlib.sha256(b" ".join(fold_words(t))).hexdigest()) for i, t in kept.items()} == {(i, h) for i, _, _, h in brute_windows(before, 35)}
        now = after
    packed = corpus_pipeline.STAGES[-1][1](spark, now, sf)
    assert packed.select("doc_id").distinct().count() == now.count()


@pytest.fixture(scope="module")
def odd_corpus(spark, texts, tmp_path_factory):
    """Documents with nulls in every column, repeated rows and ids, long texts, toxic ones, clashing columns; labels."""
    sf, rng = str(tmp_path_factory.mktemp("odd")), random.Random(51)
    rows = [(i, t, "en", "s", None if t is None else len(t), i, 7, "k", 1, 2) for i, t in texts]
    rows += [(None, None, None, None, None, None, None, None, None, None), (None, "no id", None, "s", 5, 1, None, None, None, 1), (80, texts[10][1], None, None, None, 0, 0, "", 0, 0)]
    for k in range(200):
        t = prose(rng, 30) + " vile rotten" * (k % 5 == 0)
        rows.append((1000 + k, t, "en", "s", len(t), 0, 0, "", 0, 0))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(1000 + k, 1, int(k % 5 == 0)) for k in range(150)] + [(None, None, 1), (1000, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    return sf


def test_pipeline_on_odd_rows(spark, odd_corpus):
    docs = spark.read.parquet(f"{odd_corpus}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, odd_corpus).cache()
        assert after.dtypes == docs.dtypes, name
        before, kept = ([(r["doc_id"], r["text"]) for r in x.collect()] for x in (docs, after))
        if name == "toxicity":
            assert Counter(kept) == Counter(x for x in before if "vile" not in (x[1] or ""))
        elif name == "exact_dedup":
            assert Counter(fold(t) for _, t in kept) == Counter({fold(t) for _, t in before})
            assert all((i is None) <= (max((j is not None) for j, u in before if fold(u) == fold(t)) == 0) for i, t in kept)
        elif name == "near_dedup":
            empty = [x for x in before if not fold_words(x[1])]
            assert Counter(x for x in kept if not fold_words(x[1])) == Counter(empty)
            known = [(i, t) for i, t in before if i is not None]
            want = [(i, n, c) for (i, n, c), k in brute_links(known, 5, 80).items() if n and i == c]
            assert {i for i, t in kept if i is not None and fold_words(t)} == {i for i, _, _ in want}
        else:
            assert Counter((i, hashlib.sha256(b" ".join(fold_words(t))).hexdigest()) for i, t in kept) == Counter({(i, h): 0 for i, _, _, h in brute_windows(before, 35)}) + Counter([(i, h) for (i, _, _, h), k in brute_windows(before, 35).items() for _ in range(k)])
            assert all(r["n_chars"] == len(r["text"]) for r in after.where("text is not null").collect())
        docs = after
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, odd_corpus)
    assert packed.where("piece = 0").count() == docs.count()


def test_pipeline_on_no_rows(spark, odd_corpus):
    docs = spark.read.parquet(f"{odd_corpus}/documents.parquet").where("false")
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, odd_corpus)
        assert after.count() == 0 and (name == "packing" or after.dtypes == docs.dtypes)
