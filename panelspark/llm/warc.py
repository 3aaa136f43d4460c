"""Not-modified revisits resolved to the full responses that they confirm.

A revisit of the server-not-modified kind has no body. It stands for the latest full response
of the same canonical url captured strictly earlier, if its validators agree, with the headers
that a not-modified response may update taken from the revisit.

The as-of join is cut by ranges of (url, time), so one url may hold any share of the captures:
each slice finds the latest earlier response inside itself, and one row for each url and slice
carries the latest response on to later slices. All captures of one url at one time share a slice.

Statuses: ``resolved``; ``validator_mismatch``; ``no_validator`` when the revisit has neither an
entity tag nor a date of modification; ``unresolved`` when no earlier response exists. An entity
tag decides alone when the revisit has one, by weak comparison (a leading W/ does not count).

Edge cases, all defined: a null url, a url without a host, or a null time resolves to nothing;
captures at the very time of the revisit are not earlier; of several responses at one latest time
the greatest record id is taken; repeated revisits are each resolved; null headers are none; an
empty table gives an empty result. Further columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelspark.llm import url_filter
from panelspark.session import written

#: Header fields that a not-modified response may update.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")


def canonical(url: Column) -> Column:
    """Host and resource without scheme, www, default port, fragment and closing slash; null without a host."""
    rest = url_filter.after_scheme(url)
    host = F.regexp_replace(url_filter.host_of(rest), r"^www[.]|:(80|443)$", "")
    path = F.regexp_replace(url_filter.path_of(rest), r"/$", "")
    return F.when(host != "", F.concat(host, path, F.regexp_extract(rest, url_filter.QUERY, 1)))


def _entries(headers: Column) -> Column:
    """Headers as an ordered array of (name, value), names in lower case; the last of equal names wins."""
    named = F.transform(F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>"))),
                        lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    later = lambda e, i: ~F.exists(F.slice(named, i + 2, F.size(named)), lambda x: x["key"] == e["key"])
    return F.array_sort(F.filter(named, later))


def _header(entries: Column, name: str) -> Column:
    return F.try_element_at(F.filter(entries, lambda e: e["key"] == name), F.lit(1))["value"]


def _opaque(tag: Column) -> Column:
    return F.regexp_replace(tag, "^W/", "")


def merged(stored: Column, update: Column) -> Column:
    """Stored headers, with the permitted ones of the update in place of their own."""
    allowed = F.filter(update, lambda e: e["key"].isin(*PERMITTED))
    kept = F.filter(stored, lambda e: ~F.exists(allowed, lambda x: x["key"] == e["key"]))
    return F.map_from_entries(F.array_sort(F.concat(kept, allowed)))


def latest_earlier(records: DataFrame) -> DataFrame:
    """Adds ``found``, the greatest ``mark`` at an earlier ``ts`` of the same ``key``.

    records: key and ts not null, mark null but for rows that can be found, its first field ts.
    """
    sliced = written(records.repartitionByRange("key", "ts").withColumn("slice", F.spark_partition_id()), "captures")
    earlier = W.partitionBy("key", "slice").orderBy("ts").rangeBetween(W.unboundedPreceding, -1)
    carried = (
        sliced.where("mark is not null").groupBy("key", "slice").agg(F.max("mark").alias("mark"))
        .unionByName(sliced.select("key", "slice").distinct().withColumn("mark", F.lit(None).cast(records.schema["mark"].dataType)))
        .groupBy("key", "slice").agg(F.max("mark").alias("mark"))
        .withColumn("before", F.max("mark").over(W.partitionBy("key").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)))
        .where("before is not null").select(F.col("key").alias("k"), F.col("slice").alias("s"), "before"))
    here = sliced.withColumn("inside", F.max("mark").over(earlier))
    return here.join(carried, (F.col("key") == F.col("k")) & (F.col("slice") == F.col("s")), "left").withColumn(
        "found", F.coalesce("inside", "before")).drop("k", "s", "slice", "inside", "before")


def resolve(records: DataFrame) -> DataFrame:
    """(record_id, url, ts, status, response_id, response_ts, headers) of every revisit.

    records: record_id, type (response or revisit), url, ts (whole number), headers (map).
    """
    rows = records.where(F.col("type").isin("response", "revisit")).select(
        "record_id", "type", "url", F.col("ts").cast("long").alias("ts"), canonical(F.col("url")).alias("key"),
        _entries(F.col("headers")).alias("own"))
    able = F.col("key").isNotNull() & F.col("ts").isNotNull()
    mark = F.when(F.col("type") == "response", F.struct("ts", "record_id", F.col("own").alias("headers")))
    found = latest_earlier(rows.where(able).withColumn("mark", mark)).where("type = 'revisit'").select(
        "record_id", "url", "ts", "own", "found")
    rest = rows.where(~able & (F.col("type") == "revisit")).select(
        "record_id", "url", "ts", "own", F.lit(None).cast(found.schema["found"].dataType).alias("found"))
    both = found.unionByName(rest)
    stored = F.col("found.headers")
    tag, changed = _header(F.col("own"), "etag"), _header(F.col("own"), "last-modified")
    agrees = F.when(tag.isNotNull(), _opaque(tag) == _opaque(_header(stored, "etag"))).when(
        changed.isNotNull(), changed == _header(stored, "last-modified"))
    status = (
        F.when(F.col("found").isNull(), "unresolved").when(tag.isNull() & changed.isNull(), "no_validator")
        .when(F.coalesce(agrees, F.lit(False)), "resolved").otherwise("validator_mismatch"))
    fine = F.col("status") == "resolved"
    return both.withColumn("status", status).select(
        "record_id", "url", "ts", "status", F.when(fine, F.col("found.record_id")).alias("response_id"),
        F.when(fine, F.col("found.ts")).alias("response_ts"), F.when(fine, merged(stored, F.col("own"))).alias("headers"))


def captures_of(pages: DataFrame) -> DataFrame:
    """Captures derived from crawled pages, as the pages table holds no archive records.

    Every page is a full response; some are captured again with another body. Every page is also
    revisited, with validators that agree, differ, are weak, partial or missing as the first digit of the
    body's digest has it.
    """
    digest = F.md5(F.coalesce("html", F.lit("")).cast("binary"))
    base = pages.select("page_id", "url", digest.alias("d"), (F.col("page_id") * 1000).alias("at"),
                        F.substring(digest, 1, 1).alias("x"))
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    first, second = quoted(F.substring("d", 1, 16)), quoted(F.substring("d", 17, 16))
    changed = F.concat(F.lit("day "), F.col("page_id").cast("string"))

    def capture(name: str, kind: str, url: Column, ts: Column, headers: dict[str, Column]) -> Column:
        pairs = [x for k, v in headers.items() for x in (F.lit(k), v.cast("string"))]
        return F.struct(
            F.concat(F.lit(name), F.col("page_id").cast("string")).alias("record_id"), F.lit(kind).alias("type"),
            url.alias("url"), ts.alias("ts"),
            F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull()).alias("headers"))

    def response(name: str, ts: Column, tag: Column) -> Column:
        return capture(name, "response", F.col("url"), ts, {
            "Content-Type": F.lit("text/html"), "ETag": tag, "Last-Modified": changed, "Date": ts, "Server": F.lit("origin")})

    x = F.col("x")
    seen = F.when(x.isin("5", "6"), second).otherwise(first)
    tag = F.when(x == "0", F.lit('"other"')).when(x.isin("1", "2", "7"), F.lit(None)).when(
        x == "3", F.concat(F.lit("W/"), seen)).otherwise(seen)
    date = F.when(x == "1", F.lit(None)).when(x == "7", F.lit("day 0")).otherwise(changed)
    when = F.when(x == "4", F.col("at") - 500).otherwise(F.col("at") + 500)
    revisit = capture("v", "revisit", F.concat("url", F.lit("#again")), when, {
        "ETag": tag, "Last-Modified": date, "Date": when, "Cache-Control": F.lit("max-age=60"), "Server": F.lit("edge")})
    all_of = F.array(response("a", F.col("at"), first), F.when(x.isin("5", "6"), response("b", F.col("at") + 200, second)), revisit)
    return base.select("page_id", F.explode(all_of).alias("c")).where("c is not null").select("page_id", "c.*")
