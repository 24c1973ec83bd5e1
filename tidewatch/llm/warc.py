"""Not-modified revisits: an as-of join by canonical URL to the latest earlier full response.

A revisit record (HTTP 304) has no body. It is resolved to the latest full response (HTTP 200) of the
same canonical URL before it, by (time, record id). If both name an ETag, these must be equal by weak
comparison; else if both name Last-Modified, the revisit's must not be later. The resolved record has the
response's body and headers, updated by the revisit's, except for those that a 304 must not change.

One URL may hold a third of all records. So records are dealt out by sorted ranges of (URL, time, record
id), of about equal numbers of rows whatever the times are: inside a range a window finds the latest
response; what a URL has last in earlier ranges comes from one row for each URL and range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.scratch import keep
from .common import partitions

# Headers that describe a stored body or one connection; a 304 does not replace them.
KEPT_HEADERS = ("connection", "content-encoding", "content-length", "content-md5", "content-range", "content-type", "keep-alive", "proxy-authenticate", "proxy-authorization", "te", "trailer", "transfer-encoding", "upgrade")
TRACKING = r"^(utm_[^=]*|gclid|fbclid|ref)(=|$)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def canonical_url(url: Column) -> Column:
    """Host lower-cased without "www.", "m." and a default port; path without a final "/", "index.html" or ".html";
    query without tracking parameters, its parts sorted; no scheme, user and fragment. Null for null."""
    bare = F.regexp_replace(F.regexp_replace(url, r"(?s)#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.translate(F.regexp_extract(bare, r"^[^/?]*", 0), UPPER, LOWER)
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":(80|443)?$", ""), r"^(www|m)\.", "")
    rest = F.substring(bare, F.length(F.regexp_extract(bare, r"^[^/?]*", 0)) + 1, F.length(bare))
    path = F.regexp_replace(F.regexp_replace(F.regexp_extract(rest, r"^[^?]*", 0), r"(/index)?\.html?$", ""), r"/+$", "")
    query = F.array_sort(F.filter(F.split(F.regexp_extract(rest, r"(?s)\?(.*)$", 1), "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    return F.concat(host, path, F.when(F.size(query) > 0, F.concat(F.lit("?"), F.array_join(query, "&"))).otherwise(""))


def lower_keys(headers: Column) -> Column:
    """A header map with lower-case names, the last of equal names; null is empty."""
    pairs = F.transform(F.map_entries(F.coalesce(headers, F.expr("cast(map() as map<string,string>)"))), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    last = F.aggregate(pairs, F.expr("cast(array() as array<struct<key:string,value:string>>)"), lambda acc, e: F.concat(F.filter(acc, lambda x: x["key"] != e["key"]), F.array(e)))
    return F.map_from_entries(last)


def merged_headers(stored: Column, fresh: Column) -> Column:
    """stored, with those of fresh that a 304 may change."""
    allowed = F.map_filter(fresh, lambda k, v: ~k.isin(*KEPT_HEADERS))
    return F.map_concat(F.map_filter(stored, lambda k, v: ~F.map_contains_key(allowed, k)), allowed)


def _weak(tag: Column) -> Column:
    return F.regexp_replace(F.trim(tag), r"^W/", "")


def _http_time(text: Column) -> Column:
    return F.try_to_timestamp(F.regexp_replace(F.trim(text), r"^[A-Za-z]{3}, | GMT$", ""), F.lit("dd MMM yyyy HH:mm:ss"))


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Revisits of records (record_id, url, time, status, headers map, body) with what they resolve to.

    Returns record_id, canonical_url, time, source_id (the response's record, null without one), state
    ("resolved", "etag_mismatch", "modified_later" or "no_response"), headers and body_id (record whose body it has;
    both null unless resolved). Every 304 row comes back once, repeated rows too. A null time or URL is resolved by
    nothing and resolves nothing; ties of time go by record_id (null first); malformed dates do not check. Bodies are
    not moved: join body_id to the records for them. Other columns are ignored."""
    seen = records.select("record_id", canonical_url(F.col("url")).alias("canonical_url"), F.col("time").cast("timestamp").alias("time"), F.col("status").alias("_status"), lower_keys(F.col("headers")).alias("headers"))
    usable = F.col("canonical_url").isNotNull() & F.col("time").isNotNull()
    seen = seen.where(((F.col("_status") == 200) & usable) | (F.col("_status") == 304))
    rest = F.when(usable, F.lit(0)).otherwise(F.xxhash64("record_id", "time", "canonical_url"))
    key = F.struct(F.col("time"), F.col("record_id"))
    response = F.when(F.col("_status") == 200, F.struct("time", "record_id", "headers"))
    seen = seen.withColumns({"_usable": usable, "_rest": rest, "_key": key, "_response": response})
    dealt = seen.repartitionByRange(4 * partitions(records), "_usable", "_rest", "canonical_url", "time", "record_id")
    seen = keep(dealt.withColumn("_cell", F.spark_partition_id()), "captures")  # written, so that a range stays what it is
    usable = F.col("_usable")
    place = ["canonical_url", "_cell"]
    inside = Window.partitionBy(*place).orderBy("_key", F.col("_status").desc()).rowsBetween(Window.unboundedPreceding, -1)
    found = seen.withColumn("_near", F.last("_response", ignorenulls=True).over(inside)).where("_status = 304")
    ends = seen.where(usable & (F.col("_status") == 200)).groupBy(*place).agg(F.max_by("_response", "_key").alias("_last"))
    asked = found.where(usable & F.col("_near").isNull()).select(*place).distinct().withColumn("_last", F.lit(None).cast(ends.schema["_last"].dataType))
    # One row a cell: what a cell's revisits find is the last response of the cells before it.
    cells = ends.unionByName(asked).groupBy(*place).agg(F.first("_last", ignorenulls=True).alias("_last"))
    ahead = Window.partitionBy("canonical_url").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.where("canonical_url is not null").withColumn("_before", F.last("_last", ignorenulls=True).over(ahead)).where("_before is not null").select(*place, "_before")
    rows = found.join(cells, place, "left").withColumn("_from", F.when(usable, F.coalesce("_near", "_before")))
    old, new = F.col("_from.headers"), F.col("headers")
    etags = (_weak(old["etag"]), _weak(new["etag"]))
    dates = (_http_time(old["last-modified"]), _http_time(new["last-modified"]))
    state = (
        F.when(F.col("_from").isNull(), "no_response")
        .when(etags[0].isNotNull() & etags[1].isNotNull(), F.when(etags[0] == etags[1], "resolved").otherwise("etag_mismatch"))
        .when(dates[1] > dates[0], "modified_later")
        .otherwise("resolved")
    )
    rows = rows.withColumn("state", state)
    good = F.col("state") == "resolved"
    return rows.select(
        "record_id", "canonical_url", "time", F.col("_from.record_id").alias("source_id"), "state",
        F.when(good, merged_headers(old, new)).alias("headers"), F.when(good, F.col("_from.record_id")).alias("body_id"),
    )
