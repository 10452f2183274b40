"""Crawl records: not-modified revisits resolved against the latest earlier full response of the same canonical URL."""

from pyspark.sql import Window, functions as F

from commentlake.operators.scale import in_order
from commentlake.session import materialize

# Headers of a 304 that do not replace those of the stored response.
KEPT_HEADERS = ("connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive",
                "proxy-authenticate", "proxy-authorization", "te", "trailer", "transfer-encoding", "upgrade")


def canonical_url(url):
    """Host without www and default port, path without a last slash, sorted query without tracking parameters; no fragment.

    Scheme and host are compared without case, http and https as one. A null URL has none.
    """
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, "^[^/?]*", 0)), "(^www[.])|(:(80|443)$)", "")
    path = F.regexp_replace(F.regexp_extract(bare, "^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.regexp_extract(bare, "[?](.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike("^(utm_[a-z]+|ref|fbclid|gclid)(=|$)")))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def _lowered(headers):
    """Header names lowered; of names that differ in case only, the value that sorts last."""
    pairs = F.array_sort(F.transform(F.map_entries(headers), lambda e: F.struct(F.lower(F.trim(e["key"])).alias("k"), e["value"].alias("v"))))
    last = F.filter(pairs, lambda e, i: F.coalesce(F.get(pairs, i + 1)["k"] != e["k"], F.lit(True)))
    return F.map_from_entries(F.transform(last, lambda e: F.struct(e["k"], e["v"])))


def _tag(value):
    """Weak comparison: the W/ prefix does not count."""
    return F.regexp_replace(F.trim(value), "^W/", "")


def resolve_revisits(records):
    """A row per revisit (status 304): what it refers to, how that was decided, and the headers it stands for.

    `records` has record_id, url, ts, status, headers (map of strings), digest. The referred record is the latest one with
    status 200 and the same canonical URL that comes earlier by (ts, record_id). The outcome is `resolved` when the revisit's
    ETag weakly equals the response's or, if the revisit has none, its Last-Modified does; `changed` when the validator differs;
    `no validator` when there is none to compare; `no response` when nothing full came earlier. A resolved revisit
    has the response's digest and its headers, replaced by the revisit's but for those a 304 may not change.

    Records with null URL, ts or id are not ordered: their revisits are `no response`, and they serve no other. Null headers
    are none. Rows that repeat a record id are ordered by digest. No records give no rows; other columns are not read.

    Scale: rows are dealt by ranges of (URL, ts, id), so a hot URL spans many tasks; what a task needs from earlier ones is the
    last full response of one URL, one row per task, which is broadcast. Only headers and digests move, never bodies.
    """
    records = records.select(
        "record_id", canonical_url(F.col("url")).alias("canonical"), "ts", "status", "digest",
        F.coalesce(_lowered(F.col("headers")), F.expr("cast(map() as map<string,string>)")).alias("headers"))
    usable = records.where("record_id is not null and canonical is not null and ts is not null")
    full = F.when(F.col("status") == 200, F.struct(F.col("record_id").alias("id"), F.col("digest").alias("digest"),
                                                    F.col("headers").alias("headers")))
    placed = in_order(usable.where("status in (200, 304)"), ["canonical", "ts", "record_id", "digest"]).withColumn("full", full)

    at = F.struct("canonical", "_pos")
    ends = placed.groupBy("_part").agg(
        F.min("canonical").alias("first_url"), F.max("canonical").alias("last_url"),
        F.max_by("full", F.when(F.col("full").isNotNull(), at)).alias("f"),
        F.max(F.when(F.col("full").isNotNull(), F.col("canonical"))).alias("f_url"))
    offer = F.when(F.col("f_url") == F.col("last_url"), F.struct(F.col("last_url").alias("url"), F.col("f").alias("full")))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = materialize(ends.withColumn("c", F.last(offer, ignorenulls=True).over(before)).where("c.url = first_url")
                          .select("_part", F.col("first_url").alias("canonical"), F.col("c.full").alias("carried")))
    inside = Window.partitionBy("_part", "canonical").orderBy("_pos").rowsBetween(Window.unboundedPreceding, -1)
    seen = placed.withColumn("near", F.last("full", ignorenulls=True).over(inside)) \
        .join(F.broadcast(carried), ["_part", "canonical"], "left").withColumn("found", F.coalesce("near", "carried"))
    rest = records.where("record_id is null or canonical is null or ts is null").withColumn("found", F.lit(None).cast(
        seen.schema["found"].dataType))
    cols = ["record_id", "canonical", "ts", "status", "headers", "found"]
    revisits = seen.select(*cols).unionByName(rest.select(*cols)).where("status = 304")

    own, other = F.col("headers"), F.col("found.headers")
    tag, when = _tag(own["etag"]), F.trim(own["last-modified"])
    compared = F.when(tag.isNotNull(), tag == _tag(other["etag"])).when(when.isNotNull(), when == F.trim(other["last-modified"]))
    outcome = F.when(F.col("found").isNull(), "no response").when(tag.isNull() & when.isNull(), "no validator") \
        .when(F.coalesce(compared, F.lit(False)), "resolved").otherwise("changed")
    news = F.map_filter(own, lambda k, v: ~k.isin(*KEPT_HEADERS) & v.isNotNull())
    merged = F.map_concat(F.map_filter(other, lambda k, v: ~F.map_contains_key(news, k)), news)
    resolved = F.col("outcome") == "resolved"
    return revisits.withColumn("outcome", outcome).select(
        "record_id", F.col("canonical").alias("canonical_url"), "ts", "outcome",
        F.when(resolved, F.col("found.id")).alias("refers_to"), F.when(resolved, F.col("found.digest")).alias("digest"),
        F.when(resolved, merged).alias("headers"))


def header_text(headers):
    """The headers as sorted "name: value" lines joined by a bar."""
    lines = F.transform(F.map_entries(headers), lambda e: F.concat(e["key"], F.lit(": "), F.coalesce(e["value"], F.lit(""))))
    return F.array_join(F.array_sort(lines), "|")


def records_of_pages(pages):
    """Four crawl records per page: a response, then revisits and, for every third page, a changed response.

    Pages carry no crawl history, so the history is derived from the page id and the page's own digest.
    """
    k, p = F.col("k"), F.col("page_id")
    digest = F.md5(F.when((k == 3) & (p % 3 == 0), F.concat(F.col("html"), F.lit("v2"))).otherwise(F.col("html")))
    status = F.when((k == 0) | ((k == 3) & (p % 3 == 0)), 200).otherwise(304)
    url = F.when(k % 2 == 0, F.col("url")).otherwise(
        F.concat("url", F.when(F.contains("url", F.lit("?")), "&").otherwise("?"), F.lit("utm_medium=feed")))
    ts = F.lit(1_700_000_000) + (p % 1000) * 3600 + k * 86_400 - F.when((k == 1) & (p % 7 == 0), 172_800).otherwise(0)
    etag = F.concat(F.lit('"'), F.substring(F.md5("html"), 1, 12), F.lit('"'))
    stamp = F.concat(F.lit("day "), (p % 365).cast("string"))
    full = F.map_from_arrays(
        F.array(*map(F.lit, ("Content-Type", "Content-Length", "ETag", "Last-Modified", "Server"))),
        F.array(F.lit("text/html"), F.length("html").cast("string"),
                F.when(k == 3, F.lit('"v2"')).otherwise(etag), stamp, F.lit("one")))
    short = F.map_from_arrays(
        F.array(*map(F.lit, ("ETag", "Last-Modified", "Content-Length", "Cache-Control", "Server"))),
        F.array(F.when(k == 1, etag).when(k == 3, F.concat(F.lit("W/"), etag)).when(p % 5 == 0, F.lit('"other"')),
                F.when((k == 2) & (p % 11 != 0), stamp), F.lit("0"), F.concat(F.lit("max-age="), (p % 60).cast("string")),
                F.when(k == 1, F.lit("two"))))
    short = F.map_filter(short, lambda name, v: v.isNotNull())
    rows = pages.select("page_id", "url", "html", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k"))
    return rows.select((p * 4 + k).alias("record_id"), url.alias("url"), ts.cast("long").alias("ts"), status.alias("status"),
                       digest.alias("digest"), F.when(status == 200, full).otherwise(short).alias("headers"))
