"""WARC archives of pages, and their records put together again from segments.

Writing: a page becomes a response record (an HTTP message whose body has chunked transfer framing) or, if a page with a larger key has the
same payload, a revisit record of that one. A block of more than ``SEGMENT_BYTES`` is cut: the first segment is the response, the others
are continuation records that name the origin's identifier and their number; the last one states the total length. Spark's text writer
puts records one after the other, closed by CRLF CRLF, into gzip files of at most ``RECORDS_PER_FILE`` records.

Reading: whole records are decoded where they are read. Segments, wherever they lie, are grouped by their origin's identifier, ordered by
number, checked against the total length, joined, and their chunks are decoded. A group is one record, never more.

Defined cases: a null payload is an empty one; empty payloads are equal, too; of rows with the same key and payload one is the response;
null keys come last, and a null key stays null; line ends in addresses are written in percent form; a record with missing segments or a
wrong total length has no payload (``complete`` is false); an empty table gives an empty result; only the named columns are read.
"""
from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barflow.llm.groups import join_groups, positioned
from barflow.operators.stage import materialize, staged_path

C = F.col
SEGMENT_BYTES = 16 << 10
CHUNK_BYTES = 4 << 10
RECORDS_PER_FILE = 2000
OUT_BYTES = 8 << 20
NAME = "urn:page:"
RECORD_END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def chunked(body: bytes, size: int = CHUNK_BYTES) -> bytes:
    """A body in chunked transfer framing."""
    parts = [body[i:i + size] for i in range(0, len(body), size)]
    return b"".join(b"%x\r\n%b\r\n" % (len(p), p) for p in [*parts, b""])


def unchunked(body: bytes) -> bytes | None:
    """The body without its framing; None if the framing is broken."""
    out, at = [], 0
    while True:
        line = body.find(b"\r\n", at)
        if line < 0:
            return None
        try:
            size = int(body[at:line].split(b";")[0], 16)
        except ValueError:
            return None
        at = line + 2
        if not size:
            return b"".join(out)
        if body[at + size:at + size + 2] != b"\r\n":
            return None
        out.append(body[at:at + size])
        at += size + 2


def record(fields: dict[str, object], block: bytes) -> bytes:
    """One record without the CRLF CRLF that closes it."""
    head = "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None)
    return f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block


def page_records(name: str, url: str | None, html: bytes, digest: str, refers_to: str | None, segment: int = SEGMENT_BYTES) -> Iterator[bytes]:
    """The records of a page: a revisit, or a response with its continuations."""
    uri = None if url is None else quote(url, safe="%/:?#[]@!$&'()*+,;=~")
    common = {"WARC-Date": "2024-01-01T00:00:00Z", "WARC-Target-URI": uri, "WARC-Payload-Digest": f"sha1:{digest}",
              "Content-Type": "application/http;msgtype=response"}
    message = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if refers_to is not None:
        yield record({"WARC-Type": "revisit", "WARC-Record-ID": f"<{name}>", "WARC-Refers-To": f"<{refers_to}>", "WARC-Profile": PROFILE, **common},
                     message + b"Content-Length: %d\r\n\r\n" % len(html))
        return
    block = message + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(html)
    parts = [block[i:i + segment] for i in range(0, len(block), segment)]
    first = {"WARC-Segment-Number": 1} if len(parts) > 1 else {}
    yield record({"WARC-Type": "response", "WARC-Record-ID": f"<{name}>", **common, **first}, parts[0])
    for k, part in enumerate(parts[1:], 2):
        last = {"WARC-Segment-Total-Length": len(block)} if k == len(parts) else {}
        yield record({"WARC-Type": "continuation", "WARC-Record-ID": f"<{name}:{k}>", "WARC-Date": common["WARC-Date"],
                      "WARC-Segment-Origin-ID": f"<{name}>", "WARC-Segment-Number": k, **last}, part)


def parsed(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of each record of an archive."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:end].decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        size = int(fields["content-length"])
        yield fields, data[end + 4:end + 4 + size]
        at = end + 4 + size + len(RECORD_END)


def payload_of(block: bytes) -> bytes | None:
    """The body of an HTTP message, its framing decoded."""
    head, _, body = block.partition(b"\r\n\r\n")
    return unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body


def write_archives(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", least: int = 0,
                   segment: int = SEGMENT_BYTES) -> None:
    """Archives of all pages under ``path``. Payloads of at least ``least`` bytes that are equal have one response."""
    body = F.coalesce(C(payload), F.lit(""))
    source = positioned(pages.select(C(key).alias("page"), C(url).alias("url"), body.alias("html")))
    marks = materialize(source.select("page", "row", F.unhex(F.sha1(F.col("html").cast("binary"))).alias("sha"), F.octet_length("html").alias("size")))
    same = ["sha", "size"]
    heads = (marks.where(C("size") >= least).groupBy(*same).agg(F.max(F.struct("page", "row")).alias("head"), F.count(F.lit(1)).alias("members"))
             .where(C("members") > 1))
    revisits = (join_groups(marks, materialize(heads), same, "members").where(C("row") != C("head.row"))
                .select("row", F.concat(_text("head.page"), F.lit(":"), C("head.row").cast("string")).alias("refers_to")))
    named = source.join(revisits, "row", "left").select(F.concat(_text("page"), F.lit(":"), C("row").cast("string")).alias("name"), "url",
                                                        C("html").cast("binary").alias("html"), "refers_to")

    def work(batches):
        for batch in batches:
            out, size = [], 0
            for name, uri, html, refers_to in zip(*(batch.column(i) for i in range(4))):
                html, refers_to = html.as_py(), refers_to.as_py()
                for r in page_records(_urn(name.as_py()), uri.as_py(), html, base32_sha1(html), refers_to and _urn(refers_to), segment):
                    out.append(r)
                    size += len(r)
                if size > OUT_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])
                    out, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])
    # A cast keeps the bytes as they are; a segment may end inside a character.
    records = named.mapInArrow(work, "record binary").select(C("record").cast("string").alias("value"))
    records.write.option("lineSep", RECORD_END).option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def _text(column: str):
    return F.coalesce(C(column).cast("string"), F.lit(""))


def _urn(name: str) -> str:
    return NAME + quote(name, safe=":")


def read_archives(spark, path: str, key_type: str = "bigint", key: str = "page_id") -> DataFrame:
    """Per response and revisit of the archives: key, payload (null in revisits), its size and digest, type, the response's key, segments, ``complete``."""
    files = spark.read.format("binaryFile").load(path).select("content")

    def scan(segmented: bool):
        def work(batches):
            for batch in batches:
                for content in batch.column(0):
                    rows = []
                    for fields, block in parsed(zlib.decompress(content.as_py(), 31)):
                        if ("warc-segment-number" in fields) == segmented:
                            rows.append(_segment(fields, block) if segmented else _whole(fields, block, 1))
                    yield pa.RecordBatch.from_pylist(rows, SEGMENT if segmented else WHOLE)
        return work

    def join(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pylist([reassembled(parts) for parts in batch.column(0).to_pylist()], WHOLE)
    parts = files.mapInArrow(scan(True), "origin string, number int, total bigint, digest string, block binary")
    groups = parts.groupBy("origin").agg(F.sort_array(F.collect_list(F.struct("number", "origin", "total", "digest", "block"))).alias("parts"))
    whole = files.mapInArrow(scan(False), WHOLE_SQL).unionByName(groups.select("parts").mapInArrow(join, WHOLE_SQL))

    def key_of(name: str):
        return F.nullif(F.regexp_extract(name, "^(.*):[0-9]+$", 1), F.lit("")).cast(key_type)
    return whole.select(key_of("name").alias(key), "payload", "payload_bytes", "payload_digest", "record_type", key_of("refers_to").alias("refers_to"),
                        "segments", "complete")


WHOLE_SQL = ("name string, payload binary, payload_bytes bigint, payload_digest string, record_type string, refers_to string, segments bigint, "
             "complete boolean")
WHOLE = pa.schema([("name", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                   ("record_type", pa.string()), ("refers_to", pa.string()), ("segments", pa.int64()), ("complete", pa.bool_())])
SEGMENT = pa.schema([("origin", pa.string()), ("number", pa.int32()), ("total", pa.int64()), ("digest", pa.string()), ("block", pa.binary())])


def _name(uri: str | None) -> str | None:
    return None if uri is None else unquote(uri.strip("<>").removeprefix(NAME))


def _whole(fields: dict, block: bytes, segments: int) -> dict:
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    out = {"name": _name(fields["warc-record-id"]), "record_type": fields["warc-type"], "refers_to": _name(fields.get("warc-refers-to")),
           "segments": segments, "payload_digest": digest}
    if out["record_type"] == "revisit":
        length = next(int(x.split(b":")[1]) for x in block.lower().split(b"\r\n") if x.startswith(b"content-length:"))
        return out | {"payload": None, "payload_bytes": length, "complete": True}
    payload = payload_of(block)
    good = payload is not None and base32_sha1(payload) == digest
    return out | {"payload": payload if good else None, "payload_bytes": len(payload) if good else None, "complete": good}


def _segment(fields: dict, block: bytes) -> dict:
    total = fields.get("warc-segment-total-length")
    return {"origin": _name(fields.get("warc-segment-origin-id", fields["warc-record-id"])), "number": int(fields["warc-segment-number"]),
            "total": None if total is None else int(total), "digest": fields.get("warc-payload-digest"), "block": block}


def reassembled(parts: list[dict]) -> dict:
    """The record that ordered segments make. A segment that was read twice counts once."""
    parts = list({p["number"]: p for p in parts}.values())
    block = b"".join(p["block"] for p in parts)
    whole = [p["number"] for p in parts] == list(range(1, len(parts) + 1)) and parts[-1]["total"] == len(block)
    if not whole:
        digest = (parts[0]["digest"] or "").removeprefix("sha1:") or None
        return {"name": parts[0]["origin"], "payload": None, "payload_bytes": None, "payload_digest": digest, "record_type": "response",
                "refers_to": None, "segments": len(parts), "complete": False}
    return _whole({"warc-record-id": f"<{NAME}{quote(parts[0]['origin'], safe=':')}>", "warc-type": "response", "warc-payload-digest": parts[0]["digest"]},
                  block, len(parts))


def archived(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", segment: int = SEGMENT_BYTES) -> DataFrame:
    """All pages written to new archives in the shared folder, and read from there."""
    path = staged_path(pages.sparkSession)
    write_archives(pages, path, key, url, payload, segment=segment)
    return read_archives(pages.sparkSession, path, pages.schema[key].dataType.simpleString(), key)
