"""WARC archives with a salvage reader (operator 7)."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import new_path, small_batches, table, text_or_empty, written

#: Equal payloads of fewer bytes are all stored; longer ones are stored once.
LEAST_SHARED = 100
#: Bytes of records that are written as one value, and such values in one archive file, so that a
#: file can be read whole by one task; a larger record is a value of its own.
BLOCK_BYTES, FILE_BLOCKS = 1 << 20, 32
_SALTS = 8
_MAGIC, _VERSION = b"\x1f\x8b\x08", b"WARC/1."
_END_HEAD = b"\r\n\r\n"
#: A gzip member of nothing. Its last byte is zero, which the text writer adds as its line separator.
EMPTY_MEMBER = b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\xff\x03\x00" + bytes(8)


# --- records -------------------------------------------------------------------------------------


def record(page_id: int | None, url: str | None, kind: str, digest: str, size: int, refers_to: int | None, payload: bytes) -> bytes:
    """One WARC/1.1 record; a revisit has no payload but names the record that has it."""
    name = lambda x: f"<urn:page:{x}>"
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {name('none' if page_id is None else page_id)}",
        f"WARC-Target-URI: {re.sub(r'\s', '%20', url or 'about:blank')}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {size}",
    ]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(refers_to)}"]
    body = payload if kind != "revisit" else b""
    head += ["Content-Type: text/html", f"WARC-Block-Digest: sha256:{hashlib.sha256(body).hexdigest()}", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + _END_HEAD + body + _END_HEAD


def member(data: bytes) -> bytes:
    z = zlib.compressobj(4, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


@dataclass
class Salvage:
    """What a reader found: records as (offset, headers, what `of` makes of the body) and the byte gaps that it put aside."""

    records: list[tuple[int, dict[str, str], Any]] = field(default_factory=list)
    gaps: list[tuple[int, int, str]] = field(default_factory=list)

    def gap(self, start: int, end: int, why: str) -> None:
        if end <= start:
            return
        if self.gaps and self.gaps[-1][1] == start:
            first, _, reason = self.gaps.pop()
            self.gaps.append((first, end, reason))
        else:
            self.gaps.append((start, end, why))


def _record_at(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """The record that starts here and where it ends; ValueError says which check failed."""
    if not data.startswith(_VERSION, at):
        raise ValueError("no version line")
    head_end = data.find(_END_HEAD, at)
    if head_end < 0:
        raise ValueError("headers do not end")
    heads = {}
    for line in data[at:head_end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise ValueError("malformed header")
        heads[name.decode("latin-1").strip().lower()] = value.decode("utf-8", "replace").strip()
    if not heads.get("content-length", "").isdigit():
        raise ValueError("no length")
    start = head_end + 4
    end = start + int(heads["content-length"])
    if data[end : end + 4] != _END_HEAD:
        raise ValueError("record is cut or its length is wrong")
    body = data[start:end]
    stated = heads.get("warc-block-digest", "")
    if stated.startswith("sha256:") and stated[7:] != hashlib.sha256(body).hexdigest():
        raise ValueError("block digest differs")
    return heads, body, end + 4


def _proved(heads: dict[str, str]) -> bool:
    """Whether a stated digest, compared by _record_at, vouches for the block."""
    return heads.get("warc-block-digest", "").startswith("sha256:")


def _member_records(plain: bytes, out: Salvage, start: int, end: int, of: Callable[[bytes], Any], prove: bool = False) -> None:
    """Records of a member that lies from start to end, all with its offset; a gap of its place for each bad one.

    With prove, records without a digest that vouches for them are bad.
    """
    at = 0
    while at < len(plain):
        try:
            heads, body, behind = _record_at(plain, at)
            if prove and not _proved(heads):
                raise ValueError("no digest to prove a record of a damaged member")
            out.records.append((start, heads, of(body)))
            at = behind
        except ValueError as why:
            out.gap(start, end, str(why))
            following = plain.find(b"\n" + _VERSION, at)
            at = len(plain) if following < 0 else following + 1


def _single(plain: bytes) -> bool:
    """Whether these bytes are one whole record."""
    try:
        return _record_at(plain, 0)[2] == len(plain)
    except ValueError:
        return False


def salvaged(data: bytes, of: Callable[[bytes], Any] = bytes) -> Salvage:
    """All records that pass their checks, in order, whatever lies between, plain or in gzip members.

    Of each body only what `of` makes of it is kept.

    After a record or member that fails, reading goes on at the nearer of the next version line and
    the next member header behind its start. Of a member that is cut, the records inflated before the
    cut stay; of one that is damaged (bad stream, wrong checksum), those that their digest proves. A
    broken member of one record is put aside whole. An empty file has no record and no gap.
    """
    out, at, header = Salvage(), 0, -1
    upto, kept = 0, []  # records of a broken member, and how far its bytes were read: they may show again as stored bytes

    def resume(start: int, line: bytes) -> int:
        nonlocal header
        if header < start:
            found = data.find(_MAGIC, start)
            header = len(data) if found < 0 else found
        following = data.find(line + _VERSION, start - len(line), header)
        return header if following < 0 else following + len(line)

    while at < len(data):
        if data.startswith(_MAGIC, at):
            plain, end, why = _inflated(data, at)
            if why is None:
                _member_records(plain, out, at, end, of)
                at = end
                continue
            stop, before = resume(at + 1, b""), len(out.records)
            if not _single(plain):
                _member_records(plain, out, at, stop, of, prove=isinstance(why, zlib.error))
            out.gap(at, stop, str(why))
            upto, kept = end, [x[1:] for x in out.records[before:]]
            at = stop
            continue
        try:
            heads, body, end = _record_at(data, at)
            if at >= upto or (heads, of(body)) not in kept:
                out.records.append((at, heads, of(body)))
            at = end
        except ValueError as why:
            stop = resume(at + 1, b"" if at < upto else b"\n")
            out.gap(at, stop, str(why))
            at = stop
    return out


def _inflated(data: bytes, at: int, piece: int = 1 << 14) -> tuple[bytes, int, Exception | None]:
    """What the member that starts here holds, where it ends, and what broke it, if anything.

    It is fed in pieces so that what follows is not copied each time; a piece that fails is fed again
    byte by byte, so that all that was inflated before the failure is there.
    """
    z, parts, view = zlib.decompressobj(31), [], memoryview(data)
    for a in range(at, len(data), piece):
        b = min(len(data), a + piece)
        try:
            parts.append(z.decompress(view[a:b]))
        except zlib.error:
            z = zlib.decompressobj(31)
            for c in range(at, a, piece):
                z.decompress(view[c : c + piece])
            for c in range(a, b):
                try:
                    parts.append(z.decompress(view[c : c + 1]))
                except zlib.error as why:
                    return b"".join(parts), c, why
        if z.eof:
            return b"".join(parts), b - len(z.unused_data), None
    return b"".join(parts), len(data), ValueError("member is cut")


# --- archives ------------------------------------------------------------------------------------


def classified(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) with digest, size and owner: the least page_id of those with an equal payload.

    Owners are looked for among digests alone, and only for payloads that are long enough and occur
    twice; that side is salted, as one payload may be a third of all pages. Null html is empty; null
    page_ids own a payload only among themselves, and pages that repeat the owner's id are responses.
    """
    html = text_or_empty("html")
    rows = pages.select("page_id", "url", html.alias("html"), F.sha2(html, 256).alias("digest"), F.octet_length(html).cast("long").alias("size"))
    light = rows.where(F.col("size") >= LEAST_SHARED).groupBy("digest").agg(F.min("page_id").alias("owner"), F.count(F.lit(1)).alias("n"))
    owners = light.where("n > 1").select(F.col("digest").alias("d"), "owner", F.explode(F.array(*[F.lit(i) for i in range(_SALTS)])).alias("salt"))
    salt = F.pmod(F.xxhash64("page_id"), F.lit(_SALTS)).cast("int")
    return rows.join(owners, (F.col("digest") == F.col("d")) & (salt == F.col("salt")), "left").drop("d", "salt")


def write_archives(pages: DataFrame, path: str) -> None:
    """One record per page in .warc.gz files under path, each record a gzip member of its own.

    The files go through Spark's own text writer and committer, so any store that Spark writes to
    will do and a task that runs twice leaves one file. That writer ends every value with a line
    separator: here the zero byte with which the empty member behind each record ends.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block, size = [], 0
            for row in range(batch.num_rows):
                page, url, html, digest, n, owner = (batch.column(c)[row].as_py() for c in ("page_id", "url", "html", "digest", "size", "owner"))
                kind = "revisit" if owner is not None and owner != page else "response"
                block.append(member(record(page, url, kind, digest, n, owner, html)) + EMPTY_MEMBER)
                size += len(block[-1])
                if size >= BLOCK_BYTES or row == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(block)[:-1]], pa.binary())], ["value"])
                    block, size = [], 0

    small_batches(pages.sparkSession)
    values = classified(pages).withColumn("html", F.col("html").cast("binary")).mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    values.write.option("lineSep", "\u0000").option("maxRecordsPerFile", FILE_BLOCKS).text(path)


def archive_rows(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """A row per record and per quarantined gap of all archives under path; rows of gaps have a reason.

    Without payloads these are checked and dropped where they are read.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    schema = "file string, offset long, end long, record_type string, record_id string, refers_to string, uri string, payload_digest string, payload_bytes long, payload binary, reason string"
    kinds = {"offset": pa.int64(), "end": pa.int64(), "payload_bytes": pa.int64(), "payload": pa.binary()}
    names = [x.split()[0] for x in schema.split(", ")]
    arrow = pa.schema([(x, kinds.get(x, pa.string())) for x in names])

    def of(body: bytes) -> tuple[str, int, bytes | None]:
        return hashlib.sha256(body).hexdigest(), len(body), bytes(body) if payloads else None

    def rows(name: str, content: bytes) -> Iterator[dict]:
        found = salvaged(content, of)
        for at, heads, (digest, n, body) in found.records:
            kind = heads.get("warc-type")
            if kind == "revisit":  # what it says of the payload that it stands for
                size = heads.get("x-payload-length", "")
                digest, n, body = heads.get("warc-payload-digest", "").removeprefix("sha256:") or None, int(size) if size.isdigit() else None, None
            yield {"file": name, "offset": at, "record_type": kind, "record_id": heads.get("warc-record-id"), "refers_to": heads.get("warc-refers-to"), "uri": heads.get("warc-target-uri"), "payload_digest": digest, "payload_bytes": n, "payload": body}
        for a, b, why in found.gaps:
            yield {"file": name, "offset": a, "end": b, "reason": why}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                held, size = [], 0
                for x in rows(batch.column(0)[row].as_py(), batch.column(1)[row].as_py()):
                    held.append(x)
                    size += 500 + len(x.get("payload") or b"")
                    if size >= BLOCK_BYTES:
                        yield pa.RecordBatch.from_pylist(held, arrow)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, arrow)

    small_batches(spark)
    return files.mapInArrow(run, schema)


def read_archives(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(records, quarantined gaps) of all archives under path.

    records: file, offset, record_type, record_id, refers_to, uri, payload_digest, payload_bytes, payload
    (null for revisits). gaps: file, start, end, reason. No archive, no row.
    """
    return split_rows(archive_rows(spark, path))


def split_rows(every: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records and gaps of archive_rows."""
    gaps = every.where("reason is not null").select("file", F.col("offset").alias("start"), "end", "reason")
    return every.where("reason is null").drop("end", "reason"), gaps


def page_number(name: str) -> Column:
    return F.regexp_extract(name, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    # What was read is a table of its own, the gaps beside the records.
    records, _ = split_rows(written(archive_rows(spark, path, payloads=False), "warc-read"))
    return records.select(
        page_number("record_id").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        page_number("refers_to").alias("refers_to"),
    )


SQL = """
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n, sha256(coalesce(html, '')) AS d FROM pages),
o AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY d) END AS owner FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest,
       CASE WHEN owner IS NOT NULL AND owner <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN owner <> page_id THEN owner END AS refers_to
FROM o
"""
