"""Resolving "not modified" revisit records of a web archive against full responses.

A revisit stands for a 304 answer: it has headers but no payload of its own. It resolves
to the latest earlier full response of the same canonical URL, if its validators agree:
the entity tag where the revisit has one (compared weakly), else the date of last
modification. The stored headers are then updated by those of the revisit that may be
updated; fields that describe the payload or the connection are not (``NOT_UPDATED``).

Responses and revisits are ordered within time slices of a URL, so a URL with a large share
of all captures is spread over its slices; the last response of each slice, one row, is
carried on to the slices after it. Nothing but headers and digests is shuffled.

Defined cases: "earlier" is strictly by capture time; of responses at the same time the one
with the larger id counts; null URLs, times and headers resolve to nothing or are empty;
header names are compared in lower case, of names that then clash the first counts; a
revisit without validators is ``unchecked`` but resolved; repeated records are resolved each; an
empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICE_SECONDS = 6 * 3600
#: Fixed by the caching rules of HTTP: what a 304 answer must not change.
NOT_UPDATED = ["connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive", "proxy-authenticate",
               "proxy-authorization", "te", "trailer", "transfer-encoding", "upgrade"]
#: Query parameters that do not tell resources apart.
IGNORED_PARAMETERS = "^(utm_[a-z]+|ref|sessionid|sid)(=|$)"
_PARTS = r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?(?:[^/?#@]*@)?([^/?#:]*)(:[0-9]+)?([^?#]*)(?:\?([^#]*))?"


def canonical_url(url: Column) -> Column:
    """Host in lower case without ``www.``, port unless usual, path without its last slash, sorted parameters; no scheme, no fragment."""
    part = lambda i: F.regexp_extract(url, _PARTS, i)
    host = F.regexp_replace(F.lower(part(1)), r"^www\.", "")
    port = F.when(part(2).isin(":80", ":443"), "").otherwise(part(2))
    path = F.regexp_replace(part(3), "/+$", "")
    kept = F.array_sort(F.filter(F.split(part(4), "&"), lambda p: (p != "") & ~F.regexp_like(p, F.lit(IGNORED_PARAMETERS))))
    return F.concat(host, port, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def _lowered(headers: Column) -> Column:
    """Entries with names in lower case; the first of equal names."""
    entries = F.coalesce(F.map_entries(headers), F.from_json(F.lit("[]"), "array<struct<key:string,value:string>>"))
    lower = F.transform(entries, lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    names = F.transform(lower, lambda e: e["key"])
    return F.filter(lower, lambda e, i: F.array_position(names, e["key"]) == i + 1)


def _value(entries: Column, name: str) -> Column:
    return F.get(F.filter(entries, lambda e: e["key"] == name), F.lit(0))["value"]


def _strong(tag: Column) -> Column:
    return F.regexp_replace(tag, "^[Ww]/", "")


def resolve_revisits(records: DataFrame, slice_seconds: int = SLICE_SECONDS) -> DataFrame:
    """``records``: record_id, record_type (response or revisit), url, captured_at, headers (map), payload_digest.

    Per revisit: record_id, url_key, response_id, outcome (resolved, unchecked, validator_mismatch or no_earlier_response),
    headers (merged, by name) and payload_digest. Other record types are left out.
    """
    rows = records.where(F.col("record_type").isin("response", "revisit")).select(
        "record_id", (F.col("record_type") == "response").alias("full"), canonical_url(F.col("url")).alias("url_key"),
        F.unix_micros("captured_at").alias("at"), _lowered(F.col("headers")).alias("entries"), "payload_digest")
    rows = rows.withColumn("slice", F.floor(F.col("at") / (slice_seconds * 1_000_000)))
    response = F.struct("at", "record_id", "payload_digest", "entries")
    timed = F.col("url_key").isNotNull() & F.col("at").isNotNull()
    in_slice = Window.partitionBy("url_key", "slice").orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("own", F.max(F.when(F.col("full") & timed, response)).over(in_slice)).where(~F.col("full"))
    last = rows.where(F.col("full") & timed).groupBy("url_key", "slice").agg(F.max(response).alias("last"))
    marks = last.unionByName(placed.where(timed & F.col("own").isNull()).select("url_key", "slice").distinct(), allowMissingColumns=True)
    marks = marks.groupBy("url_key", "slice").agg(F.max("last").alias("last"))
    earlier = Window.partitionBy("url_key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = marks.select("url_key", "slice", F.max("last").over(earlier).alias("carried")).where(F.col("carried").isNotNull())
    found = placed.join(carried, ["url_key", "slice"], "left").withColumn("hit", F.coalesce("own", "carried"))
    tag, date = _value(F.col("entries"), "etag"), _value(F.col("entries"), "last-modified")
    same = F.when(tag.isNotNull(), _strong(tag).eqNullSafe(_strong(_value(F.col("hit.entries"), "etag")))).otherwise(
        date.eqNullSafe(_value(F.col("hit.entries"), "last-modified")))
    outcome = (F.when(F.col("hit").isNull(), "no_earlier_response").when(tag.isNull() & date.isNull(), "unchecked")
               .when(same, "resolved").otherwise("validator_mismatch"))
    new = F.filter("entries", lambda e: ~e["key"].isin(*NOT_UPDATED))
    names = F.transform(new, lambda e: e["key"])
    merged = F.concat(F.filter("hit.entries", lambda e: ~F.array_contains(names, e["key"])), new)
    good = F.col("outcome").isin("resolved", "unchecked")
    return found.withColumn("outcome", outcome).select(
        "record_id", "url_key", F.when(good, F.col("hit.record_id")).alias("response_id"), "outcome",
        F.map_from_entries(F.array_sort(F.when(good, merged).otherwise(F.col("entries")))).alias("headers"),
        F.when(good, F.col("hit.payload_digest")).otherwise(F.col("payload_digest")).alias("payload_digest"))
