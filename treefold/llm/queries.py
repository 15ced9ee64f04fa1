"""The registered queries of this package, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query()
def op2_bpe(spark, sf_dir):
    """Encodes and decodes every whole text of documents."""
    from treefold.llm import wordbpe

    return wordbpe.round_trip(table(spark, sf_dir, "documents"), vocabulary(), ids=False, decoded=False, digests=True)


@query()
def op8_best_fit_packing(spark, sf_dir):
    """Packs all documents into sequences of at most 4096 tokens."""
    from treefold.llm import packing

    return packing.run(table(spark, sf_dir, "documents"), vocabulary())


@query(
    "SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256 "
    "FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents) WINDOW w AS (PARTITION BY t)"
)
def op3_block_naming(spark, sf_dir):
    """Exact duplicates among all documents."""
    from treefold.llm import exactdup

    return exactdup.mark(table(spark, sf_dir, "documents"))


@query(
    r"WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents), p AS (SELECT doc_id, unnest(ws) AS word, unnest(generate_series(1, len(ws))) AS pos, len(ws) AS n FROM w), "
    "s AS (SELECT doc_id, pos, word, CASE WHEN pos + 34 <= n THEN string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING) END AS k FROM p), "
    "d AS (SELECT k FROM s WHERE k IS NOT NULL GROUP BY k HAVING count(*) > 1), f AS (SELECT doc_id, pos, word, (k IS NOT NULL AND k IN (SELECT k FROM d))::INT AS dup FROM s), "
    "c AS (SELECT doc_id, pos, word, max(dup) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM f), "
    "g AS (SELECT doc_id, sum(gone)::BIGINT AS n_removed, string_agg(CASE WHEN gone = 0 THEN word END, ' ' ORDER BY pos) AS kept FROM c GROUP BY doc_id) "
    "SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN g ON g.doc_id = w.doc_id"
)
def op9_substring_index(spark, sf_dir):
    """Words of documents that lie in a repeated 35-word window."""
    from treefold.llm import substring

    return substring.mark(table(spark, sf_dir, "documents"), window=35)


@query(
    r"WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents), "
    "sh AS (SELECT DISTINCT doc_id, hash(s) AS s FROM (SELECT doc_id, unnest(CASE WHEN len(ws) >= 4 THEN list_transform(generate_series(1, len(ws) - 3), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3]) "
    "WHEN len(ws) > 0 THEN [len(ws) || ' words: ' || array_to_string(ws, ' ')] ELSE [] END) AS s FROM w)), n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id), "
    "j AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL), "
    "e AS (SELECT a, b FROM j JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)), "
    "both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e), "
    "r AS (WITH RECURSIVE reach(a, b) AS (SELECT a, b FROM both_ways UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a) SELECT a, min(b) AS m FROM reach GROUP BY a) "
    "SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(r.m, w.doc_id)) AS component_id, w.doc_id = least(w.doc_id, coalesce(r.m, w.doc_id)) AS kept FROM w LEFT JOIN n USING (doc_id) LEFT JOIN r ON r.a = w.doc_id"
)
def op10_signature_join(spark, sf_dir):
    """Components of near-duplicate documents, by distinct 4-word shingles."""
    from treefold.llm import neardup

    return neardup.mark(table(spark, sf_dir, "documents"), size=4, percent=80)


def fold(n: int):
    """crc32 of doc_id as text, modulo n."""
    from pyspark.sql import functions as F

    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % n


@query()
def op1_toxicity(spark, sf_dir):
    """Expected severity of every whole text; fitted on the labelled rows."""
    from treefold.llm import toxicity

    docs = table(spark, sf_dir, "documents")
    return toxicity.severity(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


@query()
def op6_language_id(spark, sf_dir):
    """The language of every whole text; learned from the labelled rows that aren't held out."""
    from treefold.llm import langid

    docs = table(spark, sf_dir, "documents")
    held = fold(4) == 2
    model = langid.fit(docs.where(~held))
    return langid.predict(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score")


@query()
def op7_quality_crf(spark, sf_dir):
    """The quality of every whole text; learned from the labels that aren't held out."""
    from treefold.llm import linecrf

    docs = table(spark, sf_dir, "documents")
    held = fold(3) == 1
    model = linecrf.fit(docs, table(spark, sf_dir, "labels").where(~held))
    return linecrf.score(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")


def captures(pages):
    """A crawl log of all pages: each was fetched in full once, and asked for again before or after that.

    Page p is fetched at 2p, or a second time as a revisit at 2p + 1 + 2 * (p % 5); every 11th revisit comes before its
    page. Every 7th has another entity tag, every 13th none, and the URL is written in another way.
    """
    from pyspark.sql import functions as F

    p, url = F.col("page_id"), F.col("url")
    tag, digest = F.concat(F.lit('"'), F.md5("html"), F.lit('"')), F.concat(F.lit("sha1:"), F.sha1("html"))
    date = F.concat(F.lit("day "), (p % 31).cast("string"))
    first = F.map_from_arrays(F.array(F.lit("Content-Type"), F.lit("Content-Length"), F.lit("ETag"), F.lit("Cache-Control"), F.lit("X-Served")), F.array(F.lit("text/html"), F.octet_length("html").cast("string"), tag, F.lit("max-age=60"), F.concat(F.lit("node"), (p % 3).cast("string"))))
    again = F.map_from_arrays(F.array(F.lit("content-length"), F.lit("cache-control"), F.lit("Date"), F.lit("Connection")), F.array(F.lit("0"), F.concat(F.lit("max-age="), (p % 9).cast("string")), date, F.lit("close")))
    response = F.struct((2 * p).alias("id"), url.alias("url"), (2 * p).alias("ts"), F.lit("response").alias("kind"), tag.alias("etag"), date.alias("last_modified"), digest.alias("digest"), first.alias("headers"))
    changed = F.when(p % 13 == 0, F.lit(None).cast("string")).when(p % 7 == 0, F.concat(F.lit('"other-'), p.cast("string"), F.lit('"'))).otherwise(F.concat(F.lit("W/"), tag))
    revisit = F.struct(
        (2 * p + 1).alias("id"), F.concat(url, F.lit("#seen")).alias("url"), F.when(p % 11 == 0, 2 * p - 1).otherwise(2 * p + 1 + 2 * (p % 5)).alias("ts"), F.lit("revisit").alias("kind"),
        changed.alias("etag"), date.alias("last_modified"), F.lit(None).cast("string").alias("digest"), again.alias("headers"),
    )
    return pages.select("page_id", "url", "html").select(F.explode(F.array(response, revisit)).alias("c")).select("c.*")


CANONICAL_SQL = r"""regexp_replace(regexp_replace(lower(regexp_extract(bare, '^[^/?]*')), '^www\.', ''), ':(80|443)$', '') || regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/+$', '')
  || CASE WHEN len(parts) > 0 THEN '?' || array_to_string(parts, '&') ELSE '' END"""


@query(
    r"""WITH u AS (SELECT page_id AS p, html, regexp_replace(string_split(trim(url), '#')[1], '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS bare FROM pages),
q AS (SELECT p, html, bare, list_sort(list_filter(string_split(regexp_extract(bare, '\?(.*)$', 1), '&'), lambda x: x <> '' AND string_split(x, '=')[1] NOT IN ('fbclid', 'gclid', 'ref', 'utm_campaign', 'utm_content', 'utm_medium', 'utm_source', 'utm_term'))) AS parts FROM u),
c AS (SELECT p, html, """ + CANONICAL_SQL + r""" AS canonical FROM q),
res AS (SELECT 2 * p AS id, 2 * p AS ts, canonical, '"' || md5(html) || '"' AS etag, 'day ' || (p % 31) AS lm, 'sha1:' || sha1(html) AS digest, p, strlen(html) AS len FROM c),
rev AS (SELECT 2 * p + 1 AS id, CASE WHEN p % 11 = 0 THEN 2 * p - 1 ELSE 2 * p + 1 + 2 * (p % 5) END AS ts, canonical,
  CASE WHEN p % 13 = 0 THEN NULL WHEN p % 7 = 0 THEN '"other-' || p || '"' ELSE '"' || md5(html) || '"' END AS etag, 'day ' || (p % 31) AS lm, p FROM c),
j AS (SELECT v.id, v.canonical, v.ts, r.id AS response_id, r.ts AS response_ts, v.p, r.p AS rp, r.len, r.digest AS rdigest, r.etag AS retag,
  CASE WHEN r.id IS NULL THEN 'no_response' WHEN v.etag IS NOT NULL THEN CASE WHEN v.etag = r.etag THEN 'resolved' ELSE 'mismatch' END WHEN v.lm = r.lm THEN 'resolved' ELSE 'mismatch' END AS status
  FROM rev v ASOF LEFT JOIN res r ON v.canonical = r.canonical AND v.ts > r.ts)
SELECT id, canonical, ts, response_id, response_ts, status, CASE WHEN status = 'resolved' THEN rdigest END AS digest,
  CASE WHEN status = 'resolved' THEN 'cache-control: max-age=' || (p % 9) || chr(10) || 'content-length: ' || len || chr(10) || 'content-type: text/html' || chr(10) || 'date: day ' || (p % 31) || chr(10) || 'etag: ' || retag || chr(10) || 'x-served: node' || (rp % 3)
  ELSE 'Connection: close' || chr(10) || 'Date: day ' || (p % 31) || chr(10) || 'cache-control: max-age=' || (p % 9) || chr(10) || 'content-length: 0' END AS headers FROM j"""
)
def op4_warc_revisits(spark, sf_dir):
    """Resolves the revisits of a crawl log of all pages."""
    from treefold.llm import revisit

    found = revisit.resolve(captures(table(spark, sf_dir, "pages")))
    return found.withColumn("headers", revisit.header_text(found["headers"]))


@query()
def op5_learned_partitions(spark, sf_dir):
    """The 20 nearest of every vector whose id is divisible by 20."""
    from treefold.llm import ann

    rows = table(spark, sf_dir, "embeddings")
    return ann.search(rows, rows.where("vec_id % 20 = 0"))


@query()
def pipeline(spark, sf_dir):
    """All stages of the corpus pipeline."""
    return corpus_pipeline.run(spark, sf_dir)
