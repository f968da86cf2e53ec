"""WARC records, and revisits resolved to the responses that they confirm."""

from __future__ import annotations

import gzip
import zlib
from collections.abc import Iterator
from datetime import datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.checks import replace_each
from .common import last_before

#: Header fields that a 304 response may bring up to date; all others stay as stored.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")


#: Parameters that name a visit and not a page.
TRACKING = ("utm_[a-z]+", "fbclid", "gclid")


def canonical_url(url: Column, tracking: tuple[str, ...] = TRACKING) -> Column:
    """One name for the addresses of a page: no scheme, user, "www.", default port, fragment, tracking parameters or
    last slash; the host in lower case, parameters in order, escapes in capitals. Null stays null."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), r"#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(bare, r"^([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":(80|443)$", ""), r"^www\d*\.", "")
    rest = replace_each(F.regexp_replace(bare, r"^[^/?]*", ""), "%[0-9A-Fa-f]{2}", F.upper)
    path, query = F.regexp_extract(rest, r"^([^?]*)", 1), F.regexp_extract(rest, r"^[^?]*\?(.*)$", 1)
    own = F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(f"^({'|'.join(tracking)})(=|$)"))
    query = F.array_join(F.array_sort(own), "&")
    return F.concat(host, F.regexp_replace(path, r"/$", ""), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def _weak(tag: Column) -> Column:
    return F.regexp_replace(tag, r"^W/", "")


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Joins each not-modified revisit to the latest earlier full response of its canonical URL.

    records: record_id, url, ts, kind ("response" or "revisit"), etag, last_modified and headers (map of lower-case
    names); other columns are left out. "Earlier" is by ts, then record_id. The two validators are then compared: entity tags
    weakly if both have one, else modification dates if both have one. Returns record_id, canonical_url, ts, kind,
    refers_to (the response's record_id when resolved), status and headers: of a resolved revisit the stored ones,
    with PERMITTED ones of the revisit put over them; of others their own.

    status: "response"; for revisits "resolved", "mismatch" (the latest response has another validator), "unchecked"
    (no common validator) or "missing" (no earlier response). A null URL has no earlier response; a null ts is the
    earliest; rows of another or no kind have a null status. Repeated rows stay. An empty table gives an empty result.
    """
    rows = records.select("record_id", F.coalesce(canonical_url(F.col("url")), F.concat(F.lit("\x00"), F.coalesce(F.col("record_id").cast("string"), F.lit("")))).alias("_url"), "ts", "kind", "etag", "last_modified", "headers")
    rows = rows.withColumn("_order", F.coalesce(F.col("ts").cast("long"), F.lit(-(1 << 62))))
    full = F.when(F.col("kind").eqNullSafe("response"), F.struct("record_id", "etag", "last_modified", "headers"))
    # of records with one time and name, revisits come first: what isn't earlier isn't what they confirm
    rows = rows.withColumn("_late", F.col("kind").eqNullSafe("response"))
    found = last_before(rows, "_url", ["_order", "record_id", "_late"], full, "_full")
    by_tag = F.col("etag").isNotNull() & F.col("_full.etag").isNotNull()
    by_date = F.col("last_modified").isNotNull() & F.col("_full.last_modified").isNotNull()
    same = F.when(by_tag, _weak(F.col("etag")) == _weak(F.col("_full.etag"))).when(by_date, F.col("last_modified") == F.col("_full.last_modified"))
    status = (
        F.when(F.col("kind") == "response", "response")
        .when(F.col("kind") == "revisit", F.when(F.col("_full").isNull(), "missing").when(same.isNull(), "unchecked").when(same, "resolved").otherwise("mismatch"))
    )
    found = found.withColumn("status", status)
    fresh = F.map_filter(F.coalesce("headers", F.create_map().cast("map<string,string>")), lambda k, _: k.isin(*PERMITTED))
    stored = F.map_filter(F.coalesce("_full.headers", F.create_map().cast("map<string,string>")), lambda k, _: ~F.map_contains_key(fresh, k))
    resolved = F.col("status").eqNullSafe("resolved")
    url = F.when(~F.col("_url").startswith("\x00"), F.col("_url")).alias("canonical_url")
    return found.select("record_id", url, "ts", "kind", F.when(resolved, F.col("_full.record_id")).alias("refers_to"), "status", F.when(resolved, F.map_concat(stored, fresh)).otherwise(F.col("headers")).alias("headers"))


def write_record(kind: str, uri: str, date: str, record_id: str, block: bytes, more: dict[str, str] | None = None) -> bytes:
    """A WARC/1.1 record as a gzip member."""
    head = {"WARC-Type": kind, "WARC-Target-URI": uri, "WARC-Date": date, "WARC-Record-ID": record_id, **(more or {}), "Content-Length": str(len(block))}
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n"
    return gzip.compress(text.encode() + block + b"\r\n\r\n", mtime=0)


def _fields(lines: list[bytes]) -> dict[str, str]:
    """Header fields by lower-case name; the values of a repeated one are joined by commas, those of cookies by line ends."""
    out: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.decode("utf-8", "replace").partition(":")
        name, value = name.strip().lower(), value.strip()
        if colon:
            out[name] = out[name] + ("\n" if name == "set-cookie" else ", ") + value if name in out else value
    return out


_GZIP = b"\x1f\x8b\x08"
_STEP = 1 << 16


def _members(data: bytes) -> Iterator[tuple[int, bytes, str]]:
    """(offset, content, what is wrong) of the members of a gzip file; after a damaged one the next header is looked for."""
    at, view = 0, memoryview(data)
    while at < len(data):
        if data[at : at + 3] != _GZIP:
            bad = data[at:] if at + 512 > len(data) else data[at : at + 512]
            after = data.find(_GZIP, at + 1)
            if bad.strip(b"\0"):  # padding by zeros is nothing
                yield at, b"", "no gzip header"
            at = after if after >= 0 else len(data)
            continue
        unzip, parts, end = zlib.decompressobj(31), [], at
        try:
            while not unzip.eof and end < len(data):
                parts.append(unzip.decompress(view[end : end + _STEP]))
                end += _STEP
            if not unzip.eof:
                raise zlib.error("the member breaks off")
            yield at, b"".join(parts), ""
            at = min(end, len(data)) - len(unzip.unused_data)
        except zlib.error as e:
            yield at, b"".join(parts), str(e)
            after = data.find(_GZIP, at + 1)
            at = after if after >= 0 else len(data)


def _in_member(data: bytes, offset: int, wrong: str) -> Iterator[dict]:
    """The records in a run of bytes; where one can't be read the next one is looked for. offset is that of the run."""
    damaged = lambda why: {"record_id": None, "url": None, "date": None, "kind": "damaged", "profile": None, "headers": {"offset": str(offset), "reason": why}, "body": b""}
    at, told = 0, False
    while at < len(data):
        if data[at : at + 2] in (b"\r\n", b"\n\r") or data[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        end = data.find(b"\r\n\r\n", at)
        head = data[at:end].split(b"\r\n") if end >= 0 else []
        fields = _fields(head[1:])
        size = fields.get("content-length", "")
        if not head or not head[0].startswith(b"WARC/") or not (size.isascii() and size.isdigit()) or end + 4 + int(size) > len(data):
            told = True
            yield damaged(wrong or "not a whole record")
            after = data.find(b"\r\nWARC/1.", at + 1)
            at = after + 2 if after >= 0 else len(data)
            continue
        block = data[end + 4 : end + 4 + int(size)]
        at = end + 4 + int(size)
        record = {"record_id": fields.get("warc-record-id"), "url": fields.get("warc-target-uri"), "date": fields.get("warc-date"), "kind": fields.get("warc-type"), "profile": fields.get("warc-profile"), "headers": {}, "body": block}
        if block.startswith(b"HTTP/"):
            top, _, body = block.partition(b"\r\n\r\n")
            record |= {"headers": _fields(top.split(b"\r\n")[1:]), "body": body}
        yield record
    if wrong and not told:
        yield damaged(wrong)


def read_records(data: bytes) -> Iterator[dict]:
    """The records of a WARC file, plain or gzipped, by record or as a whole.

    Nothing is lost in silence: a part that can't be read gives a record of kind "damaged" with the offset (of the gzip
    member, or of the file's start) and the reason as headers, and reading goes on at the next header.
    """
    for offset, content, wrong in _members(data) if data[:2] == _GZIP[:2] else [(0, data, "")]:
        yield from _in_member(content, offset, wrong) if content else _in_member(b"", offset, wrong)


def _seconds(date: str | None) -> int | None:
    """The time of a WARC-Date; null if it is none."""
    try:
        return int(datetime.fromisoformat(date).timestamp()) if date else None
    except ValueError:
        return None


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of the WARC files at path, in the form of resolve_revisits, with profile and body.

    A file is read whole by one task, so files should have the usual size of up to 1 GB. Parts that can't be read are
    rows of kind "damaged" (see read_records); a date that is none is null.
    """
    files = spark.read.format("binaryFile").load(path).select("content")
    schema = "record_id string, url string, ts long, kind string, profile string, etag string, last_modified string, headers map<string,string>, body binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = pa.schema([("record_id", pa.string()), ("url", pa.string()), ("ts", pa.int64()), ("kind", pa.string()), ("profile", pa.string()), ("etag", pa.string()), ("last_modified", pa.string()), ("headers", pa.map_(pa.string(), pa.string())), ("body", pa.binary())])
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for r in read_records(content.as_py()):
                    rows.append({k: v for k, v in r.items() if k != "date"} | {"ts": _seconds(r["date"]), "etag": r["headers"].get("etag"), "last_modified": r["headers"].get("last-modified"), "headers": list(r["headers"].items())})
                    if len(rows) == 100:
                        yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return files.mapInArrow(run, schema)
