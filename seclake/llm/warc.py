"""Not-modified revisits of web archives, resolved to the full response they stand for.

A revisit record with the "server not modified" profile has no body of its own.
It is joined *as of* its time, by canonical URL, to the latest earlier full
response, its validators are checked against that response, and the headers that
a 304 may update are merged into the stored ones.

One URL may hold any share of all records, so the as-of join sorts no whole URL:
records are parted by URL and time bucket, every part looks back inside itself,
and only its last full response is carried on to later parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Query parameters that only track visitors.
TRACKING = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "ref"]
#: Fields that describe the stored body, or one connection; a 304 never replaces them.
NOT_UPDATED = [
    "connection", "content-encoding", "content-length", "content-md5", "content-range", "content-type",
    "keep-alive", "proxy-authenticate", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade",
]
FULL_TYPES = ["response"]
REVISIT_TYPES = ["revisit"]


def canonical_url(url: Column) -> Column:
    """Key under which captures of one page meet; null stays null.

    Scheme, user info, ``www.``, default port, fragment, tracking parameters, the
    order of parameters and a slash at the end don't count, nor does the case of
    the host.
    """
    bare = F.regexp_replace(F.trim(url), r"(?s)#.*$", "")
    rest = F.regexp_replace(bare, r"^(?i)[a-z][a-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(rest, r"(?s)^([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":(80|443)?$", ""), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"(?s)^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.regexp_extract(rest, r"(?s)^[^?]*\?(.*)$", 1)
    pairs = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(F.substring_index(p, "=", 1)).isin(TRACKING)))
    return F.concat(host, path, F.when(F.size(pairs) > 0, F.concat(F.lit("?"), F.array_join(pairs, "&"))).otherwise(""))


def header(headers: Column, name: str) -> Column:
    """Last value of a header, its name in any case; null if there is none."""
    found = F.filter(headers, lambda h: F.lower(h["name"]) == name)
    return F.try_element_at(found, F.lit(-1))["value"]


def merged_headers(stored: Column, fresh: Column) -> Column:
    """Stored headers, each replaced by the fresh ones of its name, and the other fresh ones; sorted by name.

    Fields of ``NOT_UPDATED`` stay as they are stored and are not added.
    """
    allowed = F.filter(F.coalesce(fresh, F.array().cast("array<struct<name:string,value:string>>")), lambda h: h["name"].isNotNull() & ~F.lower(h["name"]).isin(NOT_UPDATED))
    names = F.transform(allowed, lambda h: F.lower(h["name"]))
    left = F.filter(F.coalesce(stored, F.array().cast("array<struct<name:string,value:string>>")), lambda h: h["name"].isNotNull() & ~F.array_contains(names, F.lower(h["name"])))
    lowered = F.transform(F.concat(left, allowed), lambda h: F.struct(F.lower(h["name"]).alias("name"), h["value"].alias("value")))
    return F.array_sort(lowered)


def validator_check(stored_tag: Column, tag: Column, stored_date: Column, date: Column) -> Column:
    """Which validator vouches for the stored response: ``etag``, ``last_modified``, ``none`` (a 304 without any), or null if they differ.

    Entity tags compare weakly: ``W/`` does not count.  A date is asked only
    where the revisit has no tag, as a tag is the stronger word.
    """
    weak = lambda t: F.regexp_replace(F.trim(t), r"^W/", "")
    return (
        F.when(tag.isNotNull(), F.when(weak(tag) == weak(stored_tag), "etag"))
        .when(date.isNotNull(), F.when(F.trim(date) == F.trim(stored_date), "last_modified"))
        .otherwise("none")
    )


def resolve_revisits(records: DataFrame, bucket_seconds: int = 86_400) -> DataFrame:
    """``record_id, canonical, status, refers_to, validated_by, payload_digest, headers`` for every record.

    ``records`` has ``record_id, url, ts, type, status_code, headers`` (array of
    name, value) and ``payload_digest``; bodies don't take part, a body is found by
    ``refers_to``.  status is

    * ``full``: a full response (type response, code 200), which refers to itself;
    * ``resolved``: a revisit whose response was found and validated; digest and merged headers are those of that response;
    * ``changed``: the latest earlier response has other validators;
    * ``unmatched``: no earlier response of that URL, or the record has no URL or no time;
    * ``other``: any other record.

    Earlier means a smaller (ts, record_id).  Records that repeat both look at the
    same earlier ones.  Further columns are dropped; no rows: no rows.
    """
    ready = records.select(
        "record_id", canonical_url(F.col("url")).alias("canonical"), "ts", F.lower("type").alias("type"), "status_code", "headers", "payload_digest"
    )
    is_full = F.coalesce(F.col("type").isin(FULL_TYPES) & (F.col("status_code") == 200), F.lit(False))
    is_revisit = F.coalesce(F.col("type").isin(REVISIT_TYPES), F.lit(False))
    flagged = ready.withColumns({"is_full": is_full, "is_revisit": is_revisit})
    dated = F.col("canonical").isNotNull() & F.col("ts").isNotNull() & F.col("record_id").isNotNull()
    taking = flagged.where(dated & (is_full | is_revisit)).withColumn("part", F.floor(F.unix_micros("ts") / (bucket_seconds * 1_000_000)))
    stored = F.struct("ts", "record_id", "headers", "payload_digest")
    own = F.when(F.col("is_full"), stored)

    # the latest full response inside the part; a range frame leaves out rows of the same time and id
    inside = Window.partitionBy("canonical", "part").orderBy("ts", "record_id")
    place = taking.withColumn("own", own).withColumn("rank", F.rank().over(inside))
    before = F.last("own", ignorenulls=True).over(Window.partitionBy("canonical", "part").orderBy("rank").rangeBetween(Window.unboundedPreceding, -1))
    near = place.withColumn("near", before).drop("own", "rank")

    # the latest full response of all earlier parts: one row per URL and part
    parts = taking.groupBy("canonical", "part").agg(F.max_by(own, F.when(F.col("is_full"), F.struct("ts", "record_id"))).alias("latest"))
    earlier = Window.partitionBy("canonical").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.select("canonical", "part", F.last("latest", ignorenulls=True).over(earlier).alias("carried"))
    found = near.join(carried, ["canonical", "part"]).withColumn("stored", F.coalesce("near", "carried")).drop("near", "carried", "part")
    none = F.lit(None).cast(found.schema["stored"].dataType)
    rest = flagged.where(~F.coalesce(dated, F.lit(False)) | ~(F.col("is_full") | F.col("is_revisit"))).withColumn("stored", none)

    both = found.unionByName(rest)
    by = validator_check(
        header(F.col("stored.headers"), "etag"), header(F.col("headers"), "etag"),
        header(F.col("stored.headers"), "last-modified"), header(F.col("headers"), "last-modified"),
    )
    status = (
        F.when(F.col("is_full"), "full").when(~F.col("is_revisit"), "other").when(F.col("stored").isNull(), "unmatched")
        .when(F.col("by").isNull(), "changed").otherwise("resolved")
    )
    judged = both.withColumn("by", by).withColumn("status", status)
    resolved = F.col("status") == "resolved"
    return judged.select(
        "record_id", "canonical", "status",
        F.when(resolved, F.col("stored.record_id")).when(F.col("status") == "full", F.col("record_id")).alias("refers_to"),
        F.when(resolved, F.col("by")).alias("validated_by"),
        F.when(resolved, F.col("stored.payload_digest")).when(F.col("status") == "full", F.col("payload_digest")).alias("payload_digest"),
        F.when(resolved, merged_headers(F.col("stored.headers"), F.col("headers"))).otherwise(merged_headers(F.col("headers"), F.lit(None).cast("array<struct<name:string,value:string>>"))).alias("headers"),
    )
