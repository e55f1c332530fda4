"""WARC: revisit records that a server answered with 304 Not Modified, resolved to the response they stand for.

A revisit is joined as of its time with the latest earlier full response of its canonical URL. Its validators must agree with that
response's; then the headers that a 304 may carry replace the stored ones (RFC 9110, 15.4.5).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import stored

# Header fields that a 304 response updates, and query parameters that name no resource.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
TRACKING = r"^(utm_[a-z]+|ref|gclid|fbclid|sessionid)="
#: Time buckets of the as-of join: a URL's captures are dealt to as many tasks at most.
BUCKETS = 256


def canonical_url(url: Column) -> Column:
    """Host in small letters without www., path without a last slash, query sorted without tracking parameters; no scheme, default port or fragment. Null stays null."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(bare, r"^[^/?]*", 0)), r":(80|443)$", ""), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda x: (x != "") & ~F.regexp_like(F.lower(x), F.lit(TRACKING))))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def header_map(block: Column) -> Column:
    """Header lines as a map of small-letter names; a name's repeated values are joined by a comma and a space. Lines without a colon are left out."""
    lines = F.filter(F.split(F.coalesce(block, F.lit("")), "\r?\n"), lambda x: F.instr(x, ":") > 1)
    pairs = F.transform(lines, lambda x: F.struct(F.lower(F.trim(F.substring_index(x, ":", 1))).alias("k"), F.trim(F.regexp_replace(x, "^[^:]*:", "")).alias("v")))
    names = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    return F.map_from_arrays(names, F.transform(names, lambda n: F.array_join(F.transform(F.filter(pairs, lambda p: p["k"] == n), lambda p: p["v"]), ", ")))


def as_of(asks: DataFrame, facts: DataFrame, key: str, at: str, fact: str, buckets: int = BUCKETS) -> DataFrame:
    """(key, at, fact) for each distinct (key, at) of asks: the fact of the latest strictly earlier time of its key, the largest one of that time; null if none.

    Keys are dealt by time as well: within a bucket by a window, across buckets by a window over each bucket's last fact, of which a key has
    at most `buckets`. A key with most of the rows is thus spread, and only distinct points of time are ordered. Null keys or times match nothing.
    `at` is a whole number. Repeated rows count once. Empty asks: no rows; empty facts: nulls.
    """
    points = facts.where(F.col(key).isNotNull() & F.col(at).isNotNull()).groupBy(key, at).agg(F.max(fact).alias("fact"))
    wanted = asks.where(F.col(key).isNotNull() & F.col(at).isNotNull()).groupBy(key, at).agg(F.lit(True).alias("asked"))
    both = points.select(key, at, "fact", F.lit(False).alias("asked")).unionByName(wanted.select(key, at, F.lit(None).cast(points.schema["fact"].dataType).alias("fact"), "asked"))
    both = stored(both.groupBy(key, at).agg(F.max("fact").alias("fact"), F.max("asked").alias("asked")), "points")
    ends = both.where("fact IS NOT NULL").agg(F.min(at).alias("a"), F.max(at).alias("b")).head()
    low, high = ends["a"] or 0, ends["b"] or 0
    width = max(1, (high - low) // buckets + 1)
    both = both.withColumn("bucket", F.greatest(F.lit(-1), F.least(F.lit(buckets), F.floor((F.col(at) - low) / width))).cast("int"))
    last = both.where("fact IS NOT NULL").groupBy(key, "bucket").agg(F.max_by("fact", at).alias("last"))
    spans = both.select(key, "bucket").distinct().join(last, [key, "bucket"], "left")
    carried = spans.withColumn("carried", F.last("last", ignorenulls=True).over(Window.partitionBy(key).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))).drop("last")
    own = F.last("fact", ignorenulls=True).over(Window.partitionBy(key, "bucket").orderBy(at).rowsBetween(Window.unboundedPreceding, -1))
    found = both.withColumn("own", own).where("asked").join(carried, [key, "bucket"], "left")
    return found.select(key, at, F.coalesce("own", "carried").alias("fact"))


def resolve_revisits(records: DataFrame) -> DataFrame:
    """One row per revisit of records (record_id, url, at, kind 'response' or 'revisit', status, headers: map of small-letter names, digest), each row of records a record of its own.

    Result: record_id, url, canonical, at, verdict, target_id, target_at, digest, headers. The target is the latest earlier response of status 200 with
    the same canonical URL (of equal times the largest record_id). verdict: 'resolved'; 'no response' if there is none; 'changed' if the validators
    disagree: entity tags are compared weakly where both have one, else Last-Modified where both have one; 'no validator' if they share none.
    Only resolved rows have a digest and the merged headers: the target's, with those a 304 may carry replaced. A null URL or time finds no response.
    Repeated response rows are one; of rows with one record_id but other contents the least digest counts. Repeated revisits get a row each. Headers of any
    length are carried as they are. Empty table: no rows. Other columns are not read.
    """
    rows = stored(records.select("record_id", "url", "at", "kind", "status", "headers", "digest", canonical_url(F.col("url")).alias("canonical")), "records")
    full = rows.where("kind = 'response' AND status = 200")
    asks = rows.where("kind = 'revisit'").drop("digest", "status", "kind")
    found = as_of(asks.select("canonical", "at"), full.select("canonical", "at", F.struct("at", "record_id").alias("record")), "canonical", "at", "record")
    asks = asks.join(found, ["canonical", "at"], "left").select("*", F.col("fact.record_id").alias("target_id"), F.col("fact.at").alias("target_at")).drop("fact")
    # a map can't be compared: of rows of one record and time, the headers go with the least digest
    first = F.min_by(F.struct("headers", "digest"), F.struct("digest", F.array_sort(F.map_entries("headers")).cast("string"))).alias("first")
    target = full.groupBy(F.col("record_id").alias("target_id"), F.col("at").alias("target_at"), "canonical").agg(first)
    target = target.select("target_id", "target_at", "canonical", F.col("first.headers").alias("stored"), F.col("first.digest").alias("digest"))
    out = asks.join(target, ["target_id", "canonical", "target_at"], "left")
    tag = lambda h: F.regexp_replace(F.try_element_at(h, F.lit("etag")), r"^W/", "")
    since = lambda h: F.try_element_at(h, F.lit("last-modified"))
    a, b = F.col("headers"), F.col("stored")
    verdict = (
        F.when(F.col("target_id").isNull(), "no response")
        .when(tag(a).isNotNull() & tag(b).isNotNull(), F.when(tag(a) == tag(b), "resolved").otherwise("changed"))
        .when(since(a).isNotNull() & since(b).isNotNull(), F.when(since(a) == since(b), "resolved").otherwise("changed"))
        .otherwise("no validator")
    )
    fresh = F.map_filter(a, lambda k, _: k.isin(*PERMITTED))
    merged = F.map_concat(F.map_filter(b, lambda k, _: ~F.array_contains(F.map_keys(fresh), k)), fresh)
    ok = F.col("verdict") == "resolved"
    return out.withColumn("verdict", verdict).select(
        "record_id", "url", "canonical", "at", "verdict", "target_id", "target_at", F.when(ok, F.col("digest")).alias("digest"), F.when(ok, merged).alias("headers")
    )


def header_text(headers: Column) -> Column:
    """A header map as sorted 'name: value' lines."""
    return F.array_join(F.array_sort(F.transform(F.map_entries(headers), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))), "\n")


def capture_log(pages: DataFrame) -> DataFrame:
    """Records of a crawl of pages (page_id, url, html): each page's full response, and a later (or, for every seventh, earlier) conditional request answered 304.

    Entity tags are digests of the body; of every five revisits one has another tag and one has none but Last-Modified. The header blocks are those of an
    HTTP message in a WARC record.
    """
    day = F.lpad((F.col("page_id") % 28 + 1).cast("string"), 2, "0")
    modified = F.concat(F.lit("Last-Modified: 2020-01-"), day)
    body = F.md5(F.coalesce("html", F.lit("")).cast("binary"))
    kind = F.col("page_id") % 5
    first = F.concat_ws("\r\n", F.concat(F.lit('ETag: "'), body, F.lit('"')), modified, F.lit("Content-Type: text/html"), F.lit("Cache-Control: max-age=60"), F.concat(F.lit("Date: "), (F.col("page_id") * 10).cast("string")))
    tag = F.when(kind == 0, F.lit('ETag: "other"')).when(kind != 1, F.concat(F.lit('ETag: W/"'), body, F.lit('"')))
    again_at = F.col("page_id") * 10 + F.when(F.col("page_id") % 7 == 0, -5).otherwise(5)
    again = F.concat_ws("\r\n", tag, modified, F.lit("Cache-Control: max-age=600"), F.lit("Content-Type: text/plain"), F.concat(F.lit("Date: "), again_at.cast("string")))
    record = lambda n, at, name, status, block, digest: F.struct((F.col("page_id") * 2 + n).alias("record_id"), at.cast("long").alias("at"), F.lit(name).alias("kind"), F.lit(status).alias("status"), header_map(block).alias("headers"), digest.alias("digest"))
    both = F.array(record(0, F.col("page_id") * 10, "response", 200, first, body), record(1, again_at, "revisit", 304, again, F.lit(None).cast("string")))
    return pages.select("url", F.explode(both).alias("r")).select("url", "r.*")


#: The rows of resolve_revisits(capture_log(pages)), headers as text.
ORACLE = r"""
WITH p AS (
  SELECT page_id, url, md5(coalesce(html, '')) AS body, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS bare FROM pages
), c AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(bare, '^[^/?]*', 0)), ':(80|443)$', ''), '^www\.', '') AS host,
    regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
    list_sort(list_filter(string_split(regexp_extract(bare, '\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(lower(x), '^(utm_[a-z]+|ref|gclid|fbclid|sessionid)='))) AS q
  FROM p
), k AS (
  SELECT *, host || path || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS canonical,
    '2020-01-' || lpad(CAST(page_id % 28 + 1 AS VARCHAR), 2, '0') AS modified, page_id * 10 + CASE WHEN page_id % 7 = 0 THEN -5 ELSE 5 END AS again FROM c
), f AS (
  SELECT a.page_id, b.page_id AS target, b.body AS tbody, b.modified AS tmodified,
    row_number() OVER (PARTITION BY a.page_id ORDER BY b.page_id DESC) AS rn
  FROM k a LEFT JOIN k b ON a.canonical = b.canonical AND b.page_id * 10 < a.again
), v AS (
  SELECT k.*, f.target, f.tbody, f.tmodified,
    CASE WHEN f.target IS NULL THEN 'no response'
      WHEN k.page_id % 5 = 1 THEN CASE WHEN k.modified = f.tmodified THEN 'resolved' ELSE 'changed' END
      WHEN CASE WHEN k.page_id % 5 = 0 THEN 'other' ELSE k.body END = f.tbody THEN 'resolved' ELSE 'changed' END AS verdict
  FROM k JOIN f ON k.page_id = f.page_id WHERE f.rn = 1
)
SELECT page_id * 2 + 1 AS record_id, url, canonical, CAST(again AS BIGINT) AS at, verdict, target * 2 AS target_id, target * 10 AS target_at,
  CASE WHEN verdict = 'resolved' THEN tbody END AS digest,
  CASE WHEN verdict = 'resolved' THEN 'cache-control: max-age=600' || chr(10) || 'content-type: text/html' || chr(10) || 'date: ' || CAST(again AS VARCHAR) || chr(10)
    || 'etag: ' || CASE WHEN page_id % 5 = 1 THEN '' ELSE 'W/' END || '"' || tbody || '"' || chr(10) || 'last-modified: ' || tmodified END AS headers
FROM v
"""
