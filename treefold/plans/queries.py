"""The registered queries over the driver's tables, each with DuckDB SQL where SQL can express it.

Virtual trees: T1 flat (docs/<doc_id>), T2 two snapshots (s1|s2/<source>/<lang>/<doc_id>), T3 orders as directories,
T4 an incremental pair of snapshots of T1.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from treefold.functions import hashing, paths
from treefold.operators import analyze, incremental, merkle
from treefold.operators import clean as cleaning
from treefold.sources import tables

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- trees


def t1(spark: SparkSession, sf_dir: str, algorithm: str = "SHA256") -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return tables.leaves(d, F.concat(F.lit("docs/"), F.col("doc_id").cast("string")), F.col("text"), algorithm)


def t2_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    snap = F.explode(F.when(F.col("doc_id") % 50 == 7, F.array(F.lit("s1"))).otherwise(F.array(F.lit("s1"), F.lit("s2"))))
    d = d.withColumn("s", snap)
    return tables.leaves(d, F.concat_ws("/", "s", "source", "lang", F.col("doc_id").cast("string")), F.col("text"))


def t2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.tree(t2_leaves(spark, sf_dir)).withColumn("ord", F.col("path"))


def t5(spark: SparkSession, sf_dir: str, edited: bool = False) -> DataFrame:
    """One tree, every ninth leaf of which is neither file, directory nor link; edited: every 70th file has other content."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    if edited:
        d = d.withColumn("text", F.when(F.col("doc_id") % 70 == 11, F.concat("text", F.lit(" changed"))).otherwise(F.col("text")))
    odd = F.col("doc_id") % 9 == 4
    found = tables.leaves(d, F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")), F.when(~odd, F.col("text")))
    found = found.withColumn("file_type", F.when(F.col("hash").isNull(), "Other").otherwise(F.col("file_type"))).withColumn("size", F.coalesce("size", F.lit(0).cast("long")))
    return merkle.tree(found.withColumn("hash", F.coalesce("hash", F.lit(hashing.NULL_HASH)))).withColumn("ord", F.col("path"))


def t3_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    li = li.withColumn("n", F.row_number().over(w))
    name = F.concat_ws("/", F.lit("orders"), F.col("l_orderkey").cast("string"), F.col("n").cast("string"))
    return tables.leaves(li, name, F.col("l_partkey").cast("string"))


def t4(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = F.concat(F.lit("docs/"), F.col("doc_id").cast("string"))
    previous = tables.leaves(d.where("doc_id % 50 <> 7"), path, F.col("text"))
    edited = F.col("doc_id") % 70 == 11
    text = F.when(edited, F.concat("text", F.lit(" changed"))).otherwise(F.col("text"))
    moved = F.when(edited | (F.col("doc_id") % 30 == 5), F.lit(1)).otherwise(F.lit(0))
    return tables.leaves(d.where("doc_id % 40 <> 3"), path, text, modified=moved), previous


T2_SQL = """
leaves AS (
  SELECT s || '/' || source || '/' || lang || '/' || doc_id AS path, sha256(text) AS h, strlen(text)::BIGINT AS size
  FROM documents, (VALUES ('s1'), ('s2')) v(s) WHERE s = 's1' OR doc_id % 50 <> 7),
d3 AS (SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS path, sha256(unhex(string_agg(h, '' ORDER BY h))) AS h, count(*) AS size,
  string_agg('SHA256:' || h, '|' ORDER BY h) AS children FROM leaves GROUP BY 1),
d2 AS (SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS path, sha256(unhex(string_agg(h, '' ORDER BY h))) AS h, count(*) AS size,
  string_agg('SHA256:' || h, '|' ORDER BY h) AS children FROM d3 GROUP BY 1),
d1 AS (SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS path, sha256(unhex(string_agg(h, '' ORDER BY h))) AS h, count(*) AS size,
  string_agg('SHA256:' || h, '|' ORDER BY h) AS children FROM d2 GROUP BY 1),
b AS (
  SELECT path, 'File' AS file_type, size, 'SHA256:' || h AS hash, '' AS children FROM leaves
  UNION ALL SELECT path, 'Directory', size, 'SHA256:' || h, children FROM d3
  UNION ALL SELECT path, 'Directory', size, 'SHA256:' || h, children FROM d2
  UNION ALL SELECT path, 'Directory', size, 'SHA256:' || h, children FROM d1)"""

PARENT_SQL = "CASE WHEN path IN ('', '/') THEN NULL WHEN instr(path, '/') = 0 THEN '' WHEN regexp_full_match(path, '/[^/]+') THEN '/' ELSE regexp_extract(path, '^(.*)/[^/]*$', 1) END"

SETS_SQL = f"""{T2_SQL},
hot AS (SELECT hash FROM b GROUP BY hash HAVING count(*) >= 2),
cand AS (SELECT path, hash, {PARENT_SQL} AS parent FROM b WHERE hash IN (SELECT hash FROM hot)),
keep AS (SELECT path, hash FROM cand c WHERE NOT EXISTS (SELECT 1 FROM b p WHERE p.path = c.parent AND p.hash IN (SELECT hash FROM hot))),
g AS (SELECT file_type AS ftype, size, hash, min(path) AS rep, string_agg(path, '|' ORDER BY path) AS conflicting, count(*) AS n
  FROM b GROUP BY hash, size, file_type, children HAVING count(*) >= 2),
out AS (SELECT g.* FROM g JOIN keep ON keep.path = g.rep AND keep.hash = g.hash)"""

COMPLETE_SQL = f"""{T2_SQL},
g AS (SELECT file_type AS ftype, size, hash, children, string_agg(path, '|' ORDER BY path) AS conflicting, count(*) AS n
  FROM b GROUP BY hash, size, file_type, children HAVING count(*) >= 2),
twice AS (SELECT b.path FROM b JOIN g ON b.hash = g.hash AND b.size = g.size AND b.file_type = g.ftype AND b.children = g.children),
keep AS (SELECT DISTINCT b.hash, b.size, b.file_type, b.children FROM b WHERE {PARENT_SQL} IS NULL OR {PARENT_SQL} NOT IN (SELECT path FROM twice)),
out AS (SELECT g.ftype, g.size, g.hash, g.conflicting, g.n FROM g JOIN keep k ON k.hash = g.hash AND k.size = g.size AND k.file_type = g.ftype AND k.children = g.children)"""

T4_SQL = """
prev AS (SELECT 'docs/' || doc_id AS path, 'File' AS file_type, 0 AS modified, strlen(text)::BIGINT AS size, 'SHA256:' || sha256(text) AS hash FROM documents WHERE doc_id % 50 <> 7),
src AS (SELECT doc_id, CASE WHEN doc_id % 70 = 11 THEN text || ' changed' ELSE text END AS text, CASE WHEN doc_id % 70 = 11 OR doc_id % 30 = 5 THEN 1 ELSE 0 END AS modified FROM documents WHERE doc_id % 40 <> 3),
cur AS (SELECT 'docs/' || doc_id AS path, 'File' AS file_type, modified, strlen(text)::BIGINT AS size, 'SHA256:' || sha256(text) AS hash FROM src)"""


def t5_sql(name: str, text: str) -> str:
    level = lambda src: f"""SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS path, 'Directory' AS file_type, count(*) AS size,
  'SHA256:' || sha256(unhex(coalesce(string_agg(split_part(hash, ':', 2), '' ORDER BY hash) FILTER (hash <> 'NULL:00'), ''))) AS hash,
  string_agg(hash, '|' ORDER BY hash = 'NULL:00', hash) AS children FROM {src} GROUP BY 1"""  # noqa: E731
    return f"""
{name}0 AS (SELECT source || '/' || lang || '/' || doc_id AS path, CASE WHEN doc_id % 9 = 4 THEN 'Other' ELSE 'File' END AS file_type, CASE WHEN doc_id % 9 = 4 THEN 0 ELSE strlen({text})::BIGINT END AS size,
  CASE WHEN doc_id % 9 = 4 THEN 'NULL:00' ELSE 'SHA256:' || sha256({text}) END AS hash, '' AS children FROM documents),
{name}1 AS ({level(name + '0')}),
{name}2 AS ({level(name + '1')}),
{name} AS (SELECT * FROM {name}0 UNION ALL SELECT * FROM {name}1 UNION ALL SELECT * FROM {name}2)"""


T5_SQL = t5_sql("b", "text")
T5_PAIR_SQL = t5_sql("prev", "text") + "," + t5_sql("cur", "CASE WHEN doc_id % 70 = 11 THEN text || ' changed' ELSE text END")


def _flat(df: DataFrame, *arrays: str) -> DataFrame:
    for a in arrays:
        df = df.withColumn(a, F.concat_ws("|", a))
    return df


# --- hashing


def _leaf(algorithm: str) -> Callable:
    return lambda spark, sf: t1(spark, sf, algorithm).select("path", "size", "hash")


for _a in hashing.ALGORITHMS:
    Q[f"leaf_{_a.lower()}"] = _leaf(_a)
SQL["leaf_sha256"] = "SELECT 'docs/' || doc_id AS path, strlen(text)::BIGINT AS size, 'SHA256:' || sha256(text) AS hash FROM documents"
SQL["leaf_sha1"] = "SELECT 'docs/' || doc_id AS path, strlen(text)::BIGINT AS size, 'SHA1:' || sha1(text) AS hash FROM documents"
SQL["leaf_null"] = "SELECT 'docs/' || doc_id AS path, strlen(text)::BIGINT AS size, 'NULL:00' AS hash FROM documents"


@query("SELECT 'docs/' || doc_id AS path, 'SHA256' AS hash_type, octet_length(unhex(sha256(text)))::INT AS n_bytes, 'SHA256:' || sha256(text) AS canonical FROM documents")
def hash_parse(spark, sf_dir):
    loud = F.upper(F.col("hash"))
    return t1(spark, sf_dir).select("path", hashing.hash_type(F.col("hash")).alias("hash_type"), F.octet_length(hashing.hash_bytes(F.col("hash"))).alias("n_bytes"), hashing.parse(loud).alias("canonical"))


@query("SELECT page_id, 'SHA256:' || sha256(url) AS hash, strlen(url)::BIGINT AS size FROM pages")
def symlink_hash(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", hashing.link_digest(F.col("url"), "SHA256").alias("hash"), F.octet_length("url").cast("long").alias("size"))


# --- paths


@query(f"SELECT url AS path, {PARENT_SQL.replace('path', 'url')} AS parent FROM pages")
def path_parent(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(F.col("url").alias("path"), paths.parent(F.col("url")).alias("parent"))


@query("SELECT source || '/' || lang || '/' || doc_id AS path, 3 AS depth FROM documents")
def path_child(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("source", "lang", F.col("doc_id").cast("string").alias("name"))
    p = paths.child(paths.child(paths.child(F.lit(""), F.col("source")), F.col("lang")), F.col("name"))
    return d.select(p.alias("path"), paths.depth(p).alias("depth"))


@query("SELECT page_id, regexp_replace(regexp_replace(url, '/+', '/', 'g'), '/$', '') AS path, len(string_split(regexp_replace(regexp_replace(url, '/+', '/', 'g'), '/$', ''), '/'))::INT AS depth FROM pages")
def path_depth(spark, sf_dir):
    p = paths.normalize(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", p.alias("path"), paths.depth(p).alias("depth"))


# --- Merkle hashes


@query(
    "SELECT 'orders/' || l_orderkey AS path, count(*) AS size, 'SHA256:' || sha256(unhex(string_agg(h, '' ORDER BY h))) AS hash, string_agg('SHA256:' || h, '|' ORDER BY h) AS children "
    "FROM (SELECT l_orderkey, sha256(l_partkey::VARCHAR) AS h FROM lineitem) GROUP BY l_orderkey"
)
def merkle_level1(spark, sf_dir):
    return _flat(merkle.fold_level(t3_leaves(spark, sf_dir).select("path", "hash"), "SHA256"), "children").select("path", "size", "hash", "children")


@query(f"WITH {T2_SQL} SELECT path, file_type, size, hash, children FROM b")
def merkle_tree(spark, sf_dir):
    return _flat(t2(spark, sf_dir), "children").select("path", "file_type", "size", "hash", "children")


@query(f"WITH {T5_SQL} SELECT path, file_type, size, hash, children FROM b")
def merkle_tree_with_others(spark, sf_dir):
    """A NULL child adds no bytes to its directory's hash, but counts."""
    return _flat(t5(spark, sf_dir), "children").select("path", "file_type", "size", "hash", "children")


# --- logs


@query("SELECT user_id AS path, event_id AS ord, event_type AS file_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def keep_last(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("path"), F.col("event_id").alias("ord"), F.col("event_type").alias("file_type"))
    return incremental.keep_last(e)


@query(
    "SELECT doc_id, file_type, hash FROM (SELECT doc_id, CASE WHEN doc_id % 5 = 2 THEN 'Other' ELSE 'File' END AS file_type, CASE WHEN doc_id % 5 = 2 THEN 'NULL:00' WHEN doc_id % 3 = 0 THEN 'SHA1:' || sha1(text) "
    "ELSE 'SHA256:' || sha256(text) END AS hash FROM documents) WHERE split_part(hash, ':', 1) = 'SHA256' OR (file_type = 'Other' AND split_part(hash, ':', 1) = 'NULL')"
)
def hash_type_guard(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    other = F.col("doc_id") % 5 == 2
    h = F.when(other, F.lit(hashing.NULL_HASH)).when(F.col("doc_id") % 3 == 0, hashing.digest(F.col("text"), "SHA1")).otherwise(hashing.digest(F.col("text"), "SHA256"))
    d = d.select("doc_id", F.when(other, F.lit("Other")).otherwise(F.lit("File")).alias("file_type"), h.alias("hash"))
    return d.where(hashing.type_guard(F.col("hash"), F.col("file_type"), "SHA256"))


@query(f"WITH {T4_SQL} SELECT c.path, p.hash FROM cur c JOIN prev p ON p.path = c.path AND p.file_type = c.file_type AND p.modified = c.modified AND p.size = c.size")
def cache_hits(spark, sf_dir):
    cur, prev = t4(spark, sf_dir)
    return incremental.split_cached(cur.select("path", "file_type", "modified", "size"), prev)[0].select("path", "hash")


@query(f"WITH {T5_PAIR_SQL} SELECT c.path, c.file_type, p.hash FROM cur c JOIN prev p ON p.path = c.path AND p.file_type = c.file_type AND p.size = c.size AND (c.file_type <> 'Directory' OR p.children = c.children)")
def cache_hits_of_all_types(spark, sf_dir):
    """Files, others and directories; a directory only with the same children."""
    now, before = t5(spark, sf_dir, edited=True), t5(spark, sf_dir)
    return incremental.split_cached(now.select("path", "file_type", "modified", "size", "children"), before)[0].select("path", "file_type", "hash")


@query(f"WITH {T4_SQL} SELECT c.* FROM cur c WHERE NOT EXISTS (SELECT 1 FROM prev p WHERE p.path = c.path AND p.modified = c.modified AND p.size = c.size AND p.hash = c.hash)")
def changed_records(spark, sf_dir):
    cur, prev = t4(spark, sf_dir)
    return incremental.changed_records(cur, prev).select("path", "file_type", F.col("modified").cast("int").alias("modified"), "size", "hash")


@query(
    f"WITH {T4_SQL} SELECT coalesce(c.path, p.path) AS path, CASE WHEN p.path IS NULL THEN 'added' WHEN c.path IS NULL THEN 'removed' WHEN c.hash <> p.hash THEN 'changed' "
    "WHEN c.modified <> p.modified OR c.size <> p.size THEN 'touched' ELSE 'cached' END AS status FROM cur c FULL JOIN prev p ON p.path = c.path"
)
def snapshot_status(spark, sf_dir):
    return incremental.snapshot_status(*t4(spark, sf_dir))


@query(f"WITH {T4_SQL} SELECT path, hash, size FROM prev UNION ALL SELECT path, hash, size FROM cur")
def append_union(spark, sf_dir):
    cur, prev = t4(spark, sf_dir)
    return incremental.append(prev, cur).select("path", "hash", "size")


@query(
    f"WITH {T4_SQL}, log AS (SELECT 1 AS ord, * FROM prev UNION ALL SELECT 2, * FROM cur), live AS (SELECT path, CASE WHEN path LIKE '%9' THEN 'Symlink' ELSE 'File' END AS t FROM cur) "
    "SELECT l.path, l.hash, l.ord FROM log l JOIN live v ON v.path = l.path AND v.t = l.file_type QUALIFY row_number() OVER (PARTITION BY l.path ORDER BY ord DESC) = 1"
)
def clean_live(spark, sf_dir):
    cur, prev = t4(spark, sf_dir)
    log = incremental.append(prev.withColumn("ord", F.lit(1)), cur.withColumn("ord", F.lit(2)))
    live = cur.select("path", F.when(F.col("path").endswith("9"), "Symlink").otherwise("File").alias("file_type"))
    return cleaning.clean(log, live, root="docs").select("path", "hash", "ord")


# --- analysis


@query(f"WITH {T2_SQL} SELECT hash, count(*) AS n FROM b GROUP BY hash HAVING count(*) >= 2")
def hot_hashes(spark, sf_dir):
    return analyze.hot_hashes(t2(spark, sf_dir))


@query(f"WITH {SETS_SQL} SELECT c.path, c.hash FROM cand c LEFT JOIN keep k ON k.path = c.path WHERE k.path IS NULL")
def parent_suppressed(spark, sf_dir):
    b = t2(spark, sf_dir)
    g = analyze.groups(b)
    cand = b.join(g.hot.select("hash"), "hash", "left_semi").select("path", "hash")
    return cand.join(analyze.unsuppressed(g).select("path"), "path", "left_anti").select("path", "hash")


@query(f"WITH {SETS_SQL} SELECT ftype, size, hash, conflicting, n FROM out")
def duplicate_sets(spark, sf_dir):
    return _flat(analyze.duplicate_sets(t2(spark, sf_dir)), "conflicting")


@query(f"WITH {COMPLETE_SQL} SELECT ftype, size, hash, conflicting, n FROM out")
def duplicate_sets_complete(spark, sf_dir):
    return _flat(analyze.duplicate_sets(t2(spark, sf_dir), "complete"), "conflicting")


@query(f"""WITH {T5_SQL},
hot AS (SELECT hash FROM b GROUP BY hash HAVING count(*) >= 2),
keep AS (SELECT path FROM b c WHERE hash IN (SELECT hash FROM hot) AND file_type <> 'Other' AND NOT EXISTS (SELECT 1 FROM b p WHERE p.path = {PARENT_SQL.replace('path', 'c.path')} AND p.file_type <> 'Other' AND p.hash IN (SELECT hash FROM hot))),
g AS (SELECT file_type AS ftype, size, hash, min(path) AS rep, string_agg(path, '|' ORDER BY path) AS conflicting, count(*) AS n FROM b WHERE file_type <> 'Other' GROUP BY hash, size, file_type, children HAVING count(*) >= 2)
SELECT ftype, size, hash, conflicting, n FROM g WHERE rep IN (SELECT path FROM keep)""")
def duplicate_sets_with_others(spark, sf_dir):
    """Nodes that are neither file, directory nor link all have one hash and are never reported."""
    return _flat(analyze.duplicate_sets(t5(spark, sf_dir)), "conflicting")


@query(f"WITH {SETS_SQL} SELECT hash, rep, path, position FROM (SELECT hash, rep, unnest(string_split(conflicting, '|')) AS path, unnest(generate_series(1, n))::INT AS position FROM out)")
def set_members(spark, sf_dir):
    return analyze.ranked(t2(spark, sf_dir)).select("hash", "rep", "path", "position")


@query(
    f"WITH {SETS_SQL} SELECT count(*) AS sets, coalesce(sum(size * (n - 1)), 0)::BIGINT AS redundant_units, coalesce(sum(CASE WHEN ftype = 'File' THEN size * (n - 1) END), 0)::BIGINT AS redundant_bytes, "
    "coalesce(sum(CASE WHEN ftype = 'Directory' THEN n - 1 END), 0)::BIGINT AS redundant_directories, coalesce(sum(size * (n - 1)), 0)::BIGINT // 1073741824 AS redundant_gib FROM out"
)
def redundant_summary(spark, sf_dir):
    return analyze.summary(t2(spark, sf_dir))


@query("SELECT 'File' AS ftype, strlen(any_value(text))::BIGINT AS size, 'SHA256:' || sha256(text) AS hash, string_agg('docs/' || doc_id, '|' ORDER BY 'docs/' || doc_id) AS conflicting, count(*) AS n FROM documents GROUP BY sha256(text) HAVING count(*) >= 2")
def exact_documents(spark, sf_dir):
    """Which documents are exact duplicates? The flagship, over the flat tree."""
    flat = t1(spark, sf_dir).withColumn("ord", F.col("path"))
    return _flat(analyze.duplicate_sets(flat), "conflicting")
