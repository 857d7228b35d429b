"""Not-modified revisit resolution for web archives (operator 3).

A revisit record says that a page has not changed; it is resolved by the latest earlier full
response of the same canonical url, if the validators agree (entity tags compared weakly;
without one on both sides, equal Last-Modified). The resolved record carries the response's
headers, updated by those of the revisit that a not-modified answer may change.

The as-of join is one window per (canonical url, time slot): a slot's first look at
earlier slots comes from the last response of each slot, a small aggregate, so a url with a
third of all records is spread over its slots. Bodies are not moved; records hold digests.

Defined results: records with a null url or time are returned unresolved (``no_url``); of
responses at one time the largest ``record_id`` is the latest; a response at the very time of
the revisit is not earlier; repeated rows give repeated rows; null header maps are empty; an
empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Headers of a not-modified answer that update the stored ones (lower case); those that
#: describe the body or the connection stay as stored.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary", "age", "warning")
SLOT = 4096


def canonical(url: Column) -> Column:
    """Scheme, ``www.``/``m.``, port 80 or 443, query, fragment, ``.html`` and closing slashes
    removed, host in lower case."""
    bare = F.regexp_replace(F.regexp_replace(url, r"(?s)[?#].*$", ""), r"(?s)^[^/]*?://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, r"(?s)^([^/]*)", 1)), r"^(www|m)\.|:(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"(?s)^[^/]*(.*)$", 1), r"(\.html)?/*$", "")
    return F.concat(host, path)


def weak(tag: Column) -> Column:
    return F.regexp_replace(tag, "^W/", "")


def resolve(records: DataFrame, slot: int = SLOT) -> DataFrame:
    """``records`` (record_id long, url, ts long, kind ``response``/``revisit``, headers
    map<string,string> with lower-case names, digest) -> per revisit: record_id,
    canonical_url, ts, response_id, response_ts, digest, outcome, headers."""
    empty = F.create_map().cast("map<string,string>")
    x = records.select("record_id", "ts", "kind", "digest", canonical(F.col("url")).alias("curl"), F.coalesce("headers", empty).alias("headers"))
    x = x.withColumn("slot", F.floor(F.col("ts") / slot))
    full = F.when(F.col("kind") == "response", F.struct("ts", "record_id", "digest", "headers"))
    x = x.withColumn("full", full)
    known = x.where("curl is not null and ts is not null")
    # Latest response of earlier slots, from one row for each slot that has one.
    slots = known.where("full is not null").groupBy("curl", "slot").agg(F.max_by("full", F.struct("ts", "record_id")).alias("best"))
    slots = slots.unionByName(known.where("kind = 'revisit'").groupBy("curl", "slot").agg(F.lit(None).cast(x.schema["full"].dataType).alias("best")))
    slots = slots.groupBy("curl", "slot").agg(F.max_by("best", F.struct("best.ts", "best.record_id")).alias("best"))
    before = W.partitionBy("curl").orderBy("slot").rowsBetween(W.unboundedPreceding, -1)
    slots = slots.withColumn("carried", F.last("best", ignorenulls=True).over(before)).select("curl", "slot", "carried")
    earlier = W.partitionBy("curl", "slot").orderBy("ts").rangeBetween(W.unboundedPreceding, -1)
    latest = F.max(F.when(F.col("full").isNotNull(), F.struct("ts", "record_id"))).over(earlier)
    y = known.withColumn("_at", latest).where("kind = 'revisit'").drop("full")
    # The window gives the key of the response inside the slot; its record is fetched by it.
    inside = known.where("full is not null").select("curl", "slot", F.struct("ts", "record_id").alias("_at"), "full")
    inside = inside.groupBy("curl", "slot", "_at").agg(F.max_by("full", F.xxhash64("full.digest")).alias("full"))
    y = y.join(inside, ["curl", "slot", "_at"], "left").join(slots, ["curl", "slot"], "left")
    y = y.withColumn("found", F.coalesce("full", "carried"))
    mine, theirs = F.col("headers"), F.col("found.headers")
    tag, their_tag = mine["etag"], theirs["etag"]
    date, their_date = mine["last-modified"], theirs["last-modified"]
    agree = F.when(tag.isNotNull() & their_tag.isNotNull(), weak(tag) == weak(their_tag)).when(
        date.isNotNull() & their_date.isNotNull(), date == their_date).otherwise(F.lit(False))
    outcome = F.when(F.col("found").isNull(), F.lit("no_response")).when(agree, F.lit("resolved")).otherwise(F.lit("validator_mismatch"))
    update = F.map_filter(mine, lambda k, v: k.isin(*PERMITTED))
    kept = F.map_filter(theirs, lambda k, v: ~F.map_contains_key(update, k))
    y = y.withColumn("outcome", outcome)
    ok = F.col("outcome") == "resolved"
    y = y.select("record_id", F.col("curl").alias("canonical_url"), "ts", F.when(ok, F.col("found.record_id")).alias("response_id"),
                 F.when(ok, F.col("found.ts")).alias("response_ts"), F.when(ok, F.col("found.digest")).alias("digest"), "outcome",
                 F.when(ok, F.map_concat(kept, update)).otherwise(mine).alias("headers"))
    lost = x.where("kind = 'revisit' and (curl is null or ts is null)").select(
        "record_id", F.col("curl").alias("canonical_url"), "ts", F.lit(None).cast("long").alias("response_id"),
        F.lit(None).cast("long").alias("response_ts"), F.lit(None).cast("string").alias("digest"), F.lit("no_url").alias("outcome"), "headers")
    return y.unionByName(lost)


def records_of_pages(pages: DataFrame) -> DataFrame:
    """Archive records that stand for ``pages`` (page_id, url, html), one page after the
    other: each page is a full response at ``2 * page_id`` (entity tag and digest from its
    content) and, later on, a revisit; where an id is a multiple of 5 the tag seen by the
    revisit is another content's, and of 7 the revisit has a date only."""
    digest = F.md5(F.coalesce("html", F.lit("")))
    day = F.concat(F.lit("day "), F.pmod(F.col("page_id"), F.lit(28)).cast("string"))
    tag = F.concat(F.lit('"'), F.substring(digest, 1, 16), F.lit('"'))
    base = pages.select("page_id", "url", digest.alias("digest"), day.alias("day"), tag.alias("tag"))
    response = base.select(
        (F.col("page_id") * 2).alias("record_id"), "url", (F.col("page_id") * 2).alias("ts"), F.lit("response").alias("kind"), "digest",
        F.create_map(F.lit("etag"), "tag", F.lit("last-modified"), "day", F.lit("content-type"), F.lit("text/html"),
                     F.lit("date"), F.concat(F.lit("t"), (F.col("page_id") * 2).cast("string"))).alias("headers"))
    later = F.col("page_id") * 2 + 1 + F.pmod(F.col("page_id"), F.lit(11)) * 1000
    seen = F.when(F.col("page_id") % 5 == 0, F.lit('"stale"')).otherwise(F.concat(F.lit("W/"), F.col("tag")))
    common = [F.lit("last-modified"), F.col("day"), F.lit("content-type"), F.lit("message/http"), F.lit("date"), F.concat(F.lit("t"), later.cast("string"))]
    revisit = base.select(
        (F.col("page_id") * 2 + 1).alias("record_id"), "url", later.alias("ts"), F.lit("revisit").alias("kind"), F.lit(None).cast("string").alias("digest"),
        F.when(F.col("page_id") % 7 == 0, F.create_map(*common)).otherwise(F.create_map(F.lit("etag"), seen, *common)).alias("headers"))
    return response.unionByName(revisit)


def oracle() -> str:
    """DuckDB SQL for the query over ``records_of_pages(pages)``."""
    return r"""
WITH base AS (
  SELECT page_id, url, md5(coalesce(html, '')) AS digest, 'day ' || CAST(((page_id % 28) + 28) % 28 AS VARCHAR) AS day,
    '"' || substr(md5(coalesce(html, '')), 1, 16) || '"' AS tag,
    regexp_replace(regexp_replace(url, '[?#].*$', '', 's'), '^[^/]*?://', '', 's') AS bare FROM pages),
urls AS (
  SELECT *, regexp_replace(lower(regexp_extract(bare, '^([^/]*)', 1)), '^(www|m)\.|:(80|443)$', '', 'g')
    || regexp_replace(regexp_extract(bare, '^[^/]*(.*)$', 1, 's'), '(\.html)?/*$', '') AS curl FROM base),
res AS (SELECT page_id * 2 AS record_id, page_id * 2 AS ts, curl, digest, day, tag FROM urls),
rev AS (
  SELECT page_id * 2 + 1 AS record_id, page_id * 2 + 1 + (((page_id % 11) + 11) % 11) * 1000 AS ts, curl, day,
    CASE WHEN page_id % 7 = 0 THEN NULL WHEN page_id % 5 = 0 THEN '"stale"' ELSE tag END AS tag FROM urls),
ranked AS (
  SELECT v.*, r.record_id AS response_id, r.ts AS response_ts, r.digest, r.day AS r_day, r.tag AS r_tag,
    row_number() OVER (PARTITION BY v.record_id ORDER BY r.ts DESC NULLS LAST, r.record_id DESC) AS rn
  FROM rev v LEFT JOIN res r ON v.curl = r.curl AND r.ts < v.ts),
judged AS (
  SELECT *, CASE WHEN curl IS NULL OR ts IS NULL THEN 'no_url' WHEN response_id IS NULL THEN 'no_response'
    WHEN CASE WHEN tag IS NOT NULL THEN tag = r_tag ELSE day = r_day END THEN 'resolved' ELSE 'validator_mismatch' END AS outcome
  FROM ranked WHERE rn = 1)
SELECT record_id, curl AS canonical_url, ts,
  CASE WHEN outcome = 'resolved' THEN response_id END AS response_id, CASE WHEN outcome = 'resolved' THEN response_ts END AS response_ts,
  CASE WHEN outcome = 'resolved' THEN digest END AS digest, outcome,
  CASE WHEN tag IS NULL THEN CASE WHEN outcome = 'resolved' THEN r_tag END WHEN tag = '"stale"' THEN tag ELSE 'W/' || tag END AS etag,
  day AS last_modified, CASE WHEN outcome = 'resolved' THEN 'text/html' ELSE 'message/http' END AS content_type,
  't' || CAST(ts AS VARCHAR) AS date
FROM judged"""
