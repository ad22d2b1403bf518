"""WARC archives: a writer with revisit records and a reader that salvages what damaged archives still hold.

Writing. Every row becomes a record. Of rows with equal payloads (SHA-256) those with the smallest id hold the payload, all
others are ``revisit`` records with the payload's digest, length and the id of the record they refer to. Compressed archives
hold one gzip member per record; Spark's text writer writes them, so any file system and the commit protocol serve. Its line
separator is the byte 0, which every member below 16 MB ends with anyway; after longer members it is padding. An archive is a
partition of the rows, whose size Spark bounds when it scans or shuffles.

Reading. A record passes if its member unpacks with the right checksum, its header is whole, its length leads to the closing
blank lines and its digests fit. Where a check fails, the reader searches for the next member or version line from which a
record passes (one without digest must be followed by another or by the end), goes on there and logs the bytes between as a
gap with a reason. If only a digest is wrong the frame is still trusted: that record alone is quarantined, and nothing
inside its payload is mistaken for a record. A worker holds one archive as stored and one unpacked member.

Defined cases: a null or empty payload has 0 bytes and takes part like any other; rows that share the smallest id of their
payload all hold it; rows without id revisit the smallest id there is, or hold the payload where there is none; a null URL
leaves the header out; bytes of a URL outside printable ASCII are percent-encoded; an empty table gives an archive without
records; other columns are not read, whatever they are called.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from duoscope.llm.registry import query
from duoscope.session import scratch_path, table

#: Parts into which the rows of a payload are dealt when they look for its smallest id.
SALTS = 16
#: Bytes of finished members or rows that a task holds before it passes them on.
HOLD_BYTES = 16 << 20
#: Bytes that the decompressor is fed at once.
FEED = 64 << 10
#: Bytes of a header block; a longer one is damage.
HEADER_BYTES = 1 << 20
END = b"\r\n\r\n"
START = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")
VERSION = re.compile(rb"WARC/1\.[01]\r\n")
ZEROS = re.compile(rb"\0*")
#: What a record may be followed by: nothing, padding, another record.
AFTER = re.compile(rb"\0*(?:\Z|\x1f\x8b\x08|WARC/1\.[01]\r\n)")
DATE = "2020-01-01T00:00:00Z"
SCHEMA = ("kind string, archive string, offset long, length long, inner_offset long, reason string, record_type string, "
          "record_id string, refers_to string, target_uri string, payload_digest string, payload_bytes long, payload binary")


class Damage(ValueError):
    """A failed check; ``end`` is where the record ends if its frame is sound."""

    def __init__(self, reason: str, end: int | None = None):
        super().__init__(reason)
        self.end = end


def base32_sha1(data: bytes | memoryview) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


# -- writing -----------------------------------------------------------------------------------
def record(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None) -> bytes:
    """One record; ``first`` is the id whose record holds the payload, None if this one does."""

    def name(of: int | None) -> str:
        return f"<urn:page:{'' if of is None else of}:{digest}>"

    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if first is None else http
    fields = [("WARC-Type", "response" if first is None else "revisit"), ("WARC-Record-ID", name(page_id)), ("WARC-Date", DATE)]
    if url is not None:
        fields.append(("WARC-Target-URI", re.sub(rb"[^\x21-\x7e]", lambda m: b"%%%02X" % m[0][0], url.encode()).decode()))
    if first is not None:
        fields += [("WARC-Refers-To", name(first)),
                   ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    fields += [("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"),
               ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode() + block + END


def packed_member(data: bytes) -> bytes:
    # level 1: markup shrinks nearly as far, in a third of the time
    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


def write_archives(pages: DataFrame, path: str, id_column: str = "page_id", url_column: str = "url",
                   payload_column: str = "html", compress: bool = True) -> None:
    """Writes the rows as archives into a new folder."""
    rows = pages.select(
        F.col(id_column).cast("long").alias("id"), F.col(url_column).cast("string").alias("url"),
        F.coalesce(F.col(payload_column).cast("binary"), F.lit(b"")).alias("payload"))
    sha = F.sha2("payload", 256).alias("sha")
    firsts = rows.select("id", sha).groupBy("sha").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    firsts = firsts.where("n > 1 and first is not null").select(
        "sha", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = rows.select("*", sha, F.pmod(F.xxhash64("id", "url"), F.lit(SALTS)).cast("int").alias("salt"))
    marked = salted.join(firsts, ["sha", "salt"], "left").select(
        "id", "url", "payload", F.when(~F.col("id").eqNullSafe(F.col("first")), F.col("first")).alias("first"))

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], ["member"])

        for batch in batches:
            ids, urls, payloads, first = (batch.column(n) for n in ("id", "url", "payload", "first"))
            for i in range(batch.num_rows):
                payload = payloads[i].as_py()
                data = record(ids[i].as_py(), urls[i].as_py(), payload, base32_sha1(payload), first[i].as_py())
                if compress:
                    data = packed_member(data)
                    if data[-1] == 0:  # the separator puts it back
                        data = data[:-1]
                else:
                    data = data[:-2]
                held.append(data)
                size += len(data)
                if size >= HOLD_BYTES:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    lines = marked.mapInArrow(members, "member binary").select(F.col("member").cast("string").alias("value"))
    lines.write.option("lineSep", "\0" if compress else "\r\n").text(path)


# -- reading -----------------------------------------------------------------------------------
def digest_fits(said: str, data: bytes | memoryview) -> bool:
    """Whether ``algorithm:value`` fits; algorithms that are not known are not checked."""
    kind, _, value = said.partition(":")
    if kind.lower() not in ("sha1", "sha256", "md5"):
        return True
    found = hashlib.new(kind.lower(), data).digest()
    return value.upper() in (base64.b32encode(found).decode(), base64.b32encode(found).decode().rstrip("="), found.hex().upper())


def parsed(data: memoryview, at: int) -> tuple[dict, int]:
    """The record that starts at ``at`` and where it ends, or Damage."""
    if not VERSION.match(data, at):
        raise Damage("no version line")
    head = re.compile(rb"\r\n\r\n").search(data, at, at + HEADER_BYTES)
    if not head:
        raise Damage("header without end")
    fields = {}
    for line in bytes(data[at:head.start()]).split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damage("header line without colon")
        fields[name.strip().lower()] = value.strip().decode("utf-8", "replace")
    length = fields.get(b"content-length", "")
    if not re.fullmatch(r"[0-9]{1,18}", length) or b"warc-type" not in fields or b"warc-record-id" not in fields:
        raise Damage("header lacks length, type or id")
    start, stop = head.end(), head.end() + int(length)
    if stop + len(END) > len(data):
        raise Damage("cut off")
    if data[stop:stop + len(END)] != END:
        raise Damage("length does not lead to the end of the record")
    end, block = stop + len(END), data[start:stop]
    sound = end if AFTER.match(data, end) else None
    if b"warc-block-digest" in fields and not digest_fits(fields[b"warc-block-digest"], block):
        raise Damage("block digest", sound)
    kind, http = fields[b"warc-type"], fields.get(b"content-type", "").startswith("application/http")
    body = re.compile(rb"\r\n\r\n").search(block) if http else None
    payload = block[body.end():] if body else block
    said = fields.get(b"warc-payload-digest")
    if kind == "revisit":
        size = re.search(rb"(?i)\r\ncontent-length:[ \t]*([0-9]{1,18})\r\n", bytes(block[:HEADER_BYTES]))
        count, digest, payload = int(size[1]) if size else None, said.partition(":")[2] if said else None, None
    else:
        if said and b"warc-truncated" not in fields and not digest_fits(said, payload):
            raise Damage("payload digest", sound)
        count, digest = len(payload), base32_sha1(payload)
    return {"record_type": kind, "record_id": fields[b"warc-record-id"], "refers_to": fields.get(b"warc-refers-to"),
            "target_uri": fields.get(b"warc-target-uri"), "payload_digest": digest, "payload_bytes": count,
            "payload": payload, "verified": b"warc-block-digest" in fields}, end


def unpacked_member(data: memoryview, at: int) -> tuple[bytes, int]:
    """The content of the gzip member at ``at``, checksum and length verified, and where it ends."""
    unpack, parts = zlib.decompressobj(31), []
    fed = at
    try:
        while not unpack.eof:
            if fed >= len(data):
                raise Damage("cut off")
            parts.append(unpack.decompress(data[fed:fed + FEED]))
            fed = min(fed + FEED, len(data))
    except zlib.error as e:
        raise Damage(f"gzip: {str(e).partition(': ')[2] or e}") from None
    return b"".join(parts), fed - len(unpack.unused_data)


def salvaged(data: memoryview, packed: bool = True) -> Iterator[dict]:
    """Records and gaps of an archive (or, with ``packed`` false, of an unpacked member) in order."""
    at, bad, why = ZEROS.match(data).end(), None, ""

    def gap(to: int) -> dict:
        return {"kind": "gap", "offset": bad, "length": to - bad, "reason": why}

    while at < len(data):
        end = None
        try:
            if packed and data[at:at + 3] == b"\x1f\x8b\x08":
                content, end = unpacked_member(data, at)
                inside = list(salvaged(memoryview(content), False))
                if not any(r["kind"] == "record" for r in inside):
                    raise Damage(inside[0]["reason"] if inside else "empty member", end)
                rows = [r | {"offset": at, "length": end - at, "inner_offset": r["offset"]} for r in inside]
            else:
                found, end = parsed(data, at)
                if bad is not None and not found["verified"] and not AFTER.match(data, end):
                    raise Damage("followed by no record")
                rows = [found | {"kind": "record", "offset": at, "length": end - at}]
        except Damage as e:
            if bad is None:
                bad, why = at, str(e)
            if e.end is not None:
                at = ZEROS.match(data, e.end).end()
                yield gap(e.end)
                bad = None
            else:
                following = START.search(data, at + 1)
                at = following.start() if following else len(data)
            continue
        if bad is not None:
            yield gap(at)
            bad = None
        yield from rows
        at = ZEROS.match(data, end).end()
    if bad is not None:
        yield gap(len(data))


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Rows of kind ``record`` and ``gap`` of all files below ``path``; a gap has offset, length and reason."""
    schema = pa.schema([(f, pa.int64() if t == "long" else pa.binary() if t == "binary" else pa.string())
                        for f, t in (x.split() for x in SCHEMA.split(", "))])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                name, held, size = batch.column(0)[i].as_py(), [], 0
                for row in salvaged(memoryview(batch.column(1)[i].as_buffer()).cast("B")):
                    payload = row.get("payload") if payloads else None
                    held.append(row | {"archive": name, "payload": None if payload is None else bytes(payload)})
                    size += 200 + (len(payload) if payload is not None else 0)
                    if size >= HOLD_BYTES:
                        yield pa.RecordBatch.from_pylist(held, schema=schema)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema=schema)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(read, SCHEMA)


def gap_log(found: DataFrame) -> DataFrame:
    """The quarantined byte ranges of what read_archives() found."""
    return found.where("kind = 'gap'").select("archive", "offset", "length", "inner_offset", "reason")


OP13_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT body, min(page_id) AS first, sha1(body) AS hex FROM p GROUP BY body)
SELECT p.page_id, CAST(octet_length(encode(p.body)) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 +
         ((CAST('0x' || substr(hex, CAST((i // 4) * 5 + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31)
         AS BIGINT), 1)), '') AS payload_digest,
       CASE WHEN p.page_id IS NOT DISTINCT FROM d.first OR d.first IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN p.page_id IS DISTINCT FROM d.first THEN d.first END AS refers_to
FROM p JOIN d ON p.body = d.body
"""


@query("op13_warc", OP13_SQL)
def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "archives")
    write_archives(table(spark, sf_dir, "pages"), path)
    found = read_archives(spark, path, payloads=False).where("kind = 'record'")

    def number(column: str) -> Column:
        digits = F.regexp_extract(column, "^<urn:page:(-?[0-9]*):", 1)
        return F.when(digits != "", digits).cast("long")

    return found.select(
        number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        number("refers_to").alias("refers_to"))
