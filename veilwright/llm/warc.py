"""WARC: reading records, and resolving not-modified revisits to the responses they stand for.

A revisit (a 304 answer) names no body.  It is resolved by an as-of join on the canonical URL to
the latest earlier full response; its validators (ETag, Last-Modified) must not contradict that
response's, and headers that a 304 may update replace the stored ones.

Scale: only keys, times, validators and headers move; bodies stay where they are and are joined
by record id on demand.  Records of one URL and time are first reduced to one moment with partial
aggregation.  A URL that holds a large share of all records does not land in one task: moments
are cut at quantiles of time into slices, the last response of each slice is carried forward
over one summary row a slice, and the search runs inside (URL, slice).  Revisits get the answer
of their moment by an equi-join, in which adaptive execution may split a hot key.
"""

from __future__ import annotations

import datetime
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Headers that a not-modified answer may update (RFC 9110, 15.4.5), lower case.
UPDATABLE = ("cache-control", "content-location", "date", "etag", "expires", "vary", "last-modified")

#: Query parameters that only track where a visitor came from.
TRACKING = "^(utm_[a-z]+|ref|fbclid|gclid|sessionid)$"

SLICES = 128


def canonical_url(url: Column) -> Column:
    """Lower-case scheme and host, no default port, credentials, fragment or tracking parameters; sorted query; no trailing slash.

    Null stays null; text without ``scheme://`` only loses its fragment and outer white space.
    """
    plain = F.regexp_replace(F.trim(url), "#.*$", "")
    scheme = F.lower(F.regexp_extract(plain, "^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    rest = F.regexp_replace(plain, "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?@]*@)?", "")
    host = F.lower(F.regexp_extract(rest, "^([^/?]*)", 1))
    host = F.when(scheme == "http", F.regexp_replace(host, ":80$", "")).when(scheme == "https", F.regexp_replace(host, ":443$", "")).otherwise(host)
    path = F.regexp_replace(F.regexp_extract(rest, "^[^/?]*(/[^?]*)?", 1), "/+$", "")
    pairs = F.array_sort(F.filter(F.split(F.regexp_extract(rest, "\\?(.*)$", 1), "&"), lambda p: (p != "") & ~F.regexp_extract(p, "^([^=]*)", 1).rlike(TRACKING)))
    query = F.when(F.size(pairs) > 0, F.concat(F.lit("?"), F.array_join(pairs, "&"))).otherwise(F.lit(""))
    return F.when(scheme == "", plain).otherwise(F.concat(scheme, F.lit("://"), host, path, query))


def resolve_revisits(records: DataFrame, slices: int = SLICES) -> DataFrame:
    """All revisits of ``records`` with the response each stands for.

    ``records``: record_id, url, ts (orderable), kind ('response' or 'revisit'), etag,
    last_modified, headers (map of lower-case names); other columns and kinds are ignored.  Rows: record_id,
    canonical, status, response_id, headers.  Status is ``resolved``; ``no_response`` (no earlier
    response; also for a null URL or time); or ``validator_mismatch`` (a validator both carry
    differs), for which response_id stays null and headers are the revisit's own.  Of responses
    with one URL and time the larger record_id is the later; a response at the revisit's own time
    is not earlier.  Repeated rows are each resolved.  Empty table, no rows.
    """
    if not _integral(records):
        raise TypeError("ts must be an integral number (seconds or microseconds), so that 'earlier' is exact")
    r = records.select("record_id", canonical_url(F.col("url")).alias("canonical"), "ts", (F.col("kind") == "response").alias("full"), "etag", "last_modified", "headers", "kind").where("kind in ('response', 'revisit')").drop("kind")
    keyed = r.where("canonical is not null and ts is not null")
    response = F.struct("record_id", "etag", "last_modified", "headers")
    moments = keyed.groupBy("canonical", "ts").agg(F.max_by(F.when(F.col("full"), response), F.when(F.col("full"), F.col("record_id"))).alias("at"))
    bounds = keyed.agg(F.percentile_approx("ts", [k / slices for k in range(1, slices)])).first()[0] or []
    edges = F.array(*[F.lit(x).cast("long") for x in sorted(set(bounds))]) if bounds else F.array().cast("array<long>")
    moments = moments.withColumn("slice", F.size(F.filter(edges, lambda e: e < F.col("ts"))))

    latest = moments.where("at is not null").groupBy("canonical", "slice").agg(F.max_by("at", "ts").alias("last"))
    slices_of = moments.groupBy("canonical", "slice").count().drop("count")
    before = Window.partitionBy("canonical").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = slices_of.join(latest, ["canonical", "slice"], "left").select("canonical", "slice", F.last("last", ignorenulls=True).over(before).alias("carried"))
    inside = Window.partitionBy("canonical", "slice").orderBy("ts").rowsBetween(Window.unboundedPreceding, -1)
    near = moments.withColumn("near", F.last("at", ignorenulls=True).over(inside))
    asof = near.join(carried.hint("merge"), ["canonical", "slice"]).select("canonical", "ts", F.coalesce("near", "carried").alias("found"))
    matched = keyed.where("not full").join(asof.hint("merge"), ["canonical", "ts"])
    rest = r.where("not full and (canonical is null or ts is null)")
    matched = matched.select("record_id", "canonical", "etag", "last_modified", "headers", "found").unionByName(rest.select("record_id", "canonical", "etag", "last_modified", "headers", F.lit(None).cast(matched.schema["found"].dataType).alias("found")))

    def contradicts(name: str) -> Column:
        # validators of a not-modified answer are compared weakly (RFC 9110, 8.8.3.2)
        own, stored = (F.regexp_replace(F.col(c), "^W/", "") if name == "etag" else F.col(c) for c in (name, f"found.{name}"))
        return F.coalesce(own != stored, F.lit(False))

    status = F.when(F.col("found").isNull(), "no_response").when(contradicts("etag") | contradicts("last_modified"), "validator_mismatch").otherwise("resolved")
    return matched.withColumn("status", status).select(
        "record_id",
        "canonical",
        "status",
        F.when(F.col("status") == "resolved", F.col("found.record_id")).alias("response_id"),
        F.when(F.col("status") == "resolved", merged_headers(F.col("found.headers"), F.col("headers"))).otherwise(F.col("headers")).alias("headers"),
    )


def _integral(records: DataFrame) -> bool:
    return records.schema["ts"].dataType.typeName() in ("byte", "short", "integer", "long")


def merged_headers(stored: Column, new: Column) -> Column:
    """The stored headers with the permitted ones of a not-modified answer put in their place."""
    permitted = F.map_filter(new, lambda k, v: F.lower(k).isin(*UPDATABLE))
    kept = F.map_filter(stored, lambda k, v: ~F.coalesce(F.map_contains_key(permitted, k), F.lit(False)))
    return F.when(stored.isNull(), permitted).when(new.isNull(), stored).otherwise(F.map_concat(kept, permitted))


# ------------------------------------------------------------------------------------ file format

_LENGTH = re.compile(rb"^content-length:[ \t]*(\d+)", re.I | re.M)


_VERSION = re.compile(rb"WARC/\d+\.\d+\r\n")


def _unzipped(data: bytes, skipped: list[int]) -> Iterator[bytes]:
    """The contents of the gzip members; after a damaged one, as far as it could be read, the next member follows."""
    at = 0
    while at < len(data):
        member, out, begin = zlib.decompressobj(31), [], at
        try:
            while at < len(data) and not member.eof:
                out.append(member.decompress(data[at : at + 65536]))
                at += 65536
        except zlib.error:
            pass
        yield b"".join(out)
        if member.eof:
            at = min(at, len(data)) - len(member.unused_data)
            if at < len(data) and not data.startswith(b"\x1f\x8b", at):
                begin, at = at, data.find(b"\x1f\x8b\x08", at)
                at = len(data) if at < 0 else at
                skipped.append(at - begin)
        else:
            at = data.find(b"\x1f\x8b\x08", begin + 1)
            at = len(data) if at < 0 else at
            skipped.append(at - begin)


def read_records(data: bytes, skipped: list[int] | None = None) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header, content) of each record of a WARC file's bytes, gzipped or not.

    After a damaged record reading goes on at the next header; ``skipped`` gets the bytes of each gap
    (compressed ones for a damaged gzip member).
    """
    skipped = [] if skipped is None else skipped
    if data[:2] == b"\x1f\x8b":
        data = b"".join(_unzipped(data, skipped))
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        head = data[at:end] if end >= 0 and _VERSION.match(data, at) else b""
        length = _LENGTH.search(head)
        stop = end + 4 + int(length[1]) if length else len(data) + 1
        after = stop
        while data.startswith(b"\r\n", after):
            after += 2
        if stop > len(data) or not (after == len(data) or after - stop >= 4 or _VERSION.match(data, after)):
            following = _VERSION.search(data, at + 1)
            skipped.append((following.start() if following else len(data)) - at)
            at += skipped[-1]
            continue
        fields = {}
        for line in head.split(b"\r\n")[1:]:
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        yield fields, data[end + 4 : stop]
        at = after


RECORDS = "record_id string, url string, ts long, kind string, etag string, last_modified string, headers map<string,string>, archive string, content binary"


def _micros(date: str | None) -> int | None:
    try:
        return int(datetime.datetime.fromisoformat(date).timestamp() * 1_000_000)
    except (TypeError, ValueError):
        return None


def _http(block: bytes) -> tuple[dict[str, str], bytes]:
    """The header fields (lower-case names) and the body of an HTTP message."""
    head, _, body = block.partition(b"\r\n\r\n")
    lines = (line.decode("utf-8", "replace").partition(":") for line in head.split(b"\r\n")[1:])
    return {name.strip().lower(): value.strip() for name, colon, value in lines if colon}, body


def archive_records(files: DataFrame, id_col: str = "path", content_col: str = "content") -> DataFrame:
    """Rows of ``RECORDS`` from archives' bytes (such as ``binaryFile``), ready for ``resolve_revisits``.

    ``ts`` counts microseconds; a missing or unreadable date, address or header is null.  Null and empty
    archives give no rows; damaged records are passed over.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    rows = files.select(F.col(f"`{id_col}`").cast("string").alias("archive"), F.col(f"`{content_col}`").alias("content"))
    kind = to_arrow_schema(files.sparkSession.createDataFrame([], RECORDS).schema)

    def run(batches):
        for batch in batches:
            for archive, data in zip(batch.column(0), batch.column(1)):
                for fields, block in read_records(data.as_py() or b""):
                    headers, body = _http(block)
                    row = (fields.get("warc-record-id"), fields.get("warc-target-uri"), _micros(fields.get("warc-date")), fields.get("warc-type"), headers.get("etag"), headers.get("last-modified"), list(headers.items()), archive.as_py(), body)
                    yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, kind)], kind.names)

    return rows.mapInArrow(run, RECORDS)
