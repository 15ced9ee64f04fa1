"""Resolution of WARC revisit records that say "not modified".

Each revisit is joined as of its time, by canonical URL, to the latest earlier full response. Its validators are checked
against that response's, and its headers are merged into the stored ones where RFC 9111 (section 3.2) permits it.

Captures: id, url, ts (any integer clock), kind ('response' or 'revisit'), etag, last_modified, digest, headers
(map<string,string>). Of responses with one URL and time, the one with the largest id counts as the latest (and among those
the one with the largest validators); a response at the revisit's own time isn't earlier. Header names that differ only in
case are one field, whose last value counts.

One URL may hold a third of all captures, at any times. Captures are first aggregated to one row per URL and time. Times are
cut into `slices` with about as many captures each: the latest response of each slice is a partial aggregate, what is carried
from slice to slice is a window over at most `slices` rows a URL, and the as-of window inside a slice is over (URL, slice).
Only ids, validators and headers travel, never payloads.

Nulls: a null URL is its own group; a null kind or time is kept as unresolved ('no_response'); null headers are empty;
a null validator can't be compared. Status: 'resolved' (a validator agrees), 'mismatch' (the strong validators differ),
'unchecked' (none can be compared), 'no_response' (nothing earlier). Repeated rows are resolved each. Extra columns are
dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treefold.llm.common import Scratch, only

#: Fields that describe the stored body or one connection, which a 304 response may not replace.
KEPT = ("content-encoding", "content-length", "content-md5", "content-range", "content-type", "connection", "keep-alive", "proxy-authenticate", "proxy-authentication-info", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade")
#: Query parameters that only track visits.
TRACKING = ("fbclid", "gclid", "ref", "utm_campaign", "utm_content", "utm_medium", "utm_source", "utm_term")


def canonical_url(url: Column) -> Column:
    """Lower-case host without www., no scheme, default port or fragment, sorted query without tracking, no last slash."""
    bare = F.regexp_replace(F.split(F.trim(url), "#")[0], "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(bare, "^[^/?]*", 0))
    host = F.regexp_replace(F.regexp_replace(host, r"^www\.", ""), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    parts = F.array_sort(F.filter(F.split(query, "&"), lambda x: (x != "") & ~F.split(x, "=")[0].isin(*TRACKING)))
    return F.concat(host, path, F.when(F.size(parts) > 0, F.concat(F.lit("?"), F.array_join(parts, "&"))).otherwise(F.lit("")))


def weak(etag: Column) -> Column:
    """An entity tag as the weak comparison sees it."""
    return F.regexp_replace(etag, "^W/", "")


def lower_names(headers: Column) -> Column:
    """The fields with names in lower case; of fields that are then the same, the last."""
    entries = F.coalesce(F.map_entries(headers), F.expr("cast(array() as array<struct<key:string,value:string>>)"))
    names = F.array_distinct(F.transform(entries, lambda e: F.lower(e["key"])))
    value = lambda k: F.element_at(F.filter(entries, lambda e: F.lower(e["key"]) == k), -1)["value"]
    return F.map_from_arrays(names, F.transform(names, value))


def merged_headers(stored: Column, fresh: Column) -> Column:
    """The stored fields with those the 304 response may replace; names in lower case."""
    fresh = F.map_filter(lower_names(fresh), lambda k, _: ~k.isin(*KEPT))
    stored = F.map_filter(lower_names(stored), lambda k, _: ~F.map_contains_key(fresh, k))
    return F.map_concat(stored, fresh)


def resolve(captures: DataFrame, slices: int = 256) -> DataFrame:
    """One row a revisit: id, canonical, ts, response_id, response_ts, status, digest (of the body it stands for), headers."""
    scratch = Scratch(captures.sparkSession, "revisit")
    c = only(captures, "id", "url", "ts", "kind", "etag", "last_modified", "digest", "headers").withColumn("canonical", canonical_url(F.col("url")))
    full = F.struct("ts", "id", "etag", "last_modified", "digest", F.map_entries("headers").alias("headers"))
    moments = c.where("ts is not null").groupBy("canonical", "ts").agg(F.max(F.when(F.col("kind") == "response", full)).alias("r"))
    moments = scratch.store(moments, "moments")
    cuts = moments.agg(F.percentile_approx("ts", [k / slices for k in range(1, slices)], 100 * slices).alias("q")).first()["q"] if slices > 1 else []
    cut = F.array(*[F.lit(x) for x in sorted(set(cuts or []))])
    moments = moments.withColumn("slice", F.size(F.filter(cut, lambda x: x <= F.col("ts"))) if cuts else F.lit(0))
    last = moments.where("r is not null").groupBy("canonical", "slice").agg(F.max("r").alias("r"))
    # each slice's latest response is carried to the slices behind it
    slots = moments.select("canonical", "slice").distinct().join(last.withColumnsRenamed({"canonical": "_c", "slice": "_s"}), F.col("canonical").eqNullSafe(F.col("_c")) & (F.col("slice") == F.col("_s")), "left")
    before = Window.partitionBy("canonical").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = slots.select(F.col("canonical").alias("_c"), F.col("slice").alias("_s"), F.last("r", ignorenulls=True).over(before).alias("carried"))
    inside = Window.partitionBy("canonical", "slice").orderBy("ts").rowsBetween(Window.unboundedPreceding, -1)
    near = moments.withColumn("near", F.last("r", ignorenulls=True).over(inside)).join(carried, F.col("canonical").eqNullSafe(F.col("_c")) & (F.col("slice") == F.col("_s")), "left")
    earlier = scratch.store(near.select(F.col("canonical").alias("_c"), F.col("ts").alias("_t"), F.coalesce("near", "carried").alias("r")).where("r is not null"), "earlier")
    asked = c.where(F.coalesce(F.col("kind"), F.lit("")) != "response")
    found = asked.join(earlier, F.col("canonical").eqNullSafe(F.col("_c")) & (F.col("ts") == F.col("_t")), "left")
    tags = weak(F.col("etag")) == weak(F.col("r.etag"))
    body = F.col("digest") == F.col("r.digest")
    dates = F.col("last_modified") == F.col("r.last_modified")
    status = (
        F.when(F.col("r").isNull(), "no_response")
        .when(tags.isNotNull() | body.isNotNull(), F.when(F.coalesce(tags, F.lit(True)) & F.coalesce(body, F.lit(True)), "resolved").otherwise("mismatch"))
        .when(dates.isNotNull(), F.when(dates, "resolved").otherwise("mismatch"))
        .otherwise("unchecked")
    )
    found = found.withColumn("status", status)
    ok = F.col("status") == "resolved"
    headers = F.when(ok, merged_headers(F.map_from_entries("r.headers"), F.col("headers"))).otherwise(F.col("headers"))
    return found.select("id", "canonical", "ts", F.col("r.id").alias("response_id"), F.col("r.ts").alias("response_ts"), "status", F.when(ok, F.col("r.digest")).otherwise(F.col("digest")).alias("digest"), headers.alias("headers"))


def header_text(headers: Column) -> Column:
    """The fields as sorted lines."""
    return F.array_join(F.array_sort(F.transform(F.map_entries(headers), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))), "\n")
