"""Media columns: interleaved document sequences with payloads behind digests (operator 2)."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import new_path, small_batches, table, text_or_empty

#: A payload is padded with bytes 255 to a positive multiple of this; as an image it is WIDTH samples wide.
UNIT, WIDTH, PAD = 576, 24, 255
_SIGNATURE = b"\x89PNG\r\n\x1a\n"

SEQUENCE = "array<struct<pos: int, kind: string, text: string, ref: string, caption: string>>"


# --- payloads as lossless 8-bit images -----------------------------------------------------------


def padded(data: bytes) -> bytes:
    return data + bytes([PAD]) * (max(1, -(-len(data) // UNIT)) * UNIT - len(data))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def stored(payload: bytes) -> bytes:
    """The payload as an 8-bit greyscale PNG of WIDTH columns, one row after another."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 4)) + _chunk(b"IEND", b"")


def samples(media: bytes) -> bytes:
    """The samples of a stored image; ValueError if a chunk fails its checksum or the picture is not of our kind."""
    if media[:8] != _SIGNATURE:
        raise ValueError("not a PNG")
    at, body, size = 8, [], None
    while at + 12 <= len(media):
        (n,) = struct.unpack(">I", media[at : at + 4])
        kind, data = media[at + 4 : at + 8], media[at + 8 : at + 8 + n]
        if struct.unpack(">I", media[at + 8 + n : at + 12 + n])[0] != zlib.crc32(kind + data):
            raise ValueError(f"checksum of {kind!r}")
        if kind == b"IHDR":
            size = struct.unpack(">IIBBBBB", data)
        elif kind == b"IDAT":
            body.append(data)
        at += 12 + n
    if not size or size[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not an 8-bit greyscale image")
    lines = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(size[1], size[0] + 1)
    if lines[:, 0].any():
        raise ValueError("filtered rows")
    return lines[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """64 hex digits: the histogram of the samples in 32 bins of equal width, each as a share of 255."""
    counts = np.bincount(np.frombuffer(payload, np.uint8) >> 3, minlength=32)
    return (counts * 255 // len(payload)).astype(np.uint8).tobytes().hex()


# --- sequences -----------------------------------------------------------------------------------


class _Sequence(HTMLParser):
    """Text and media references in reading order; a figure's caption goes to the references in it."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.words: list[str] = []
        self.figure: list[dict] | None = None
        self.caption: list[str] | None = None
        self.skip = 0

    def flush(self) -> None:
        text = " ".join("".join(self.words).split())
        if text:
            self.items.append({"kind": "text", "text": text, "ref": None, "caption": None})
        self.words = []

    def handle_starttag(self, tag, attrs) -> None:
        if tag in ("script", "style"):
            self.skip += 1
        elif tag == "figure":
            self.flush()
            self.figure = []
        elif tag == "figcaption":
            self.caption = []
        elif tag in ("img", "audio", "video", "source"):
            self.flush()
            named = dict(attrs)
            if named.get("src"):
                item = {"kind": "media", "text": None, "ref": named["src"], "caption": named.get("alt")}
                self.items.append(item)
                if self.figure is not None:
                    self.figure.append(item)
        elif tag in ("p", "div", "br", "li", "h1", "h2", "h3", "h4", "td", "tr", "section", "article"):
            self.words.append("\n")

    def handle_endtag(self, tag) -> None:
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        elif tag == "figcaption" and self.caption is not None:
            text = " ".join("".join(self.caption).split())
            for item in self.figure or []:
                item["caption"] = text
            self.caption = None
        elif tag == "figure":
            self.figure = None
        elif tag in ("p", "div", "li", "h1", "h2", "h3", "h4", "td", "tr", "section", "article"):
            self.words.append("\n")

    def handle_data(self, data) -> None:
        if not self.skip:
            (self.words if self.caption is None else self.caption).append(data)


def parsed(html: str | None) -> list[dict]:
    p = _Sequence()
    p.feed(html or "")
    p.close()
    p.flush()
    return [{"pos": i} | x for i, x in enumerate(p.items)]


def sequences(docs: DataFrame, html: Column, into: str = "sequence") -> DataFrame:
    """docs with `into`: ordered structs of text and media references. A null page is an empty sequence."""

    @F.pandas_udf(SEQUENCE)
    def parse(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([parsed(x) for x in batch])

    return docs.withColumn(into, parse(html))


def media_store(docs: DataFrame, payload: Column) -> DataFrame:
    """(digest, media) in a table of the shared folder: every payload that occurs, padded, as a stored image.

    A task writes a payload once however often it holds it; tasks may write the same one again, so a
    digest can have a few equal rows, never as many as copies.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[bytes] = set()
        for pdf in batches:
            keys, media = [], []
            for x in pdf["payload"]:
                data = padded(bytes(x))
                digest = hashlib.sha256(data)
                if digest.digest() not in seen:
                    seen.add(digest.digest())
                    keys.append(digest.hexdigest())
                    media.append(stored(data))
            yield pd.DataFrame({"digest": keys, "media": media})

    small_batches(docs.sparkSession)
    path = new_path(docs.sparkSession, "media")
    docs.select(payload.alias("payload")).mapInPandas(run, "digest string, media binary").write.option("compression", "none").parquet(path)
    return docs.sparkSession.read.schema("digest string, media binary").parquet(path)


def described(store: DataFrame) -> DataFrame:
    """One row per digest of the store, from its stored bytes: payload and media sizes and checksums, and the feature."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for digest, media in zip(pdf["digest"], pdf["media"], strict=True):
                media = bytes(media)
                data = samples(media)
                rows.append((digest, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature(data)))
            yield pd.DataFrame(rows, columns=["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    schema = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return store.mapInPandas(run, schema).distinct()


def resolved(refs: DataFrame, facts: DataFrame, scheme: str = "sha256:") -> DataFrame:
    """refs(ref, ...) with the columns of facts(digest, ...) that the reference names; unknown ones stay null.

    Only checksums and sizes meet here, never payloads. One payload may be named by a third of all
    references: the join is a plain equi-join of two shuffled sides, whose hot partitions Spark splits
    (spark.sql.adaptive.skewJoin), so nothing is replicated for the others.
    """
    refs = refs.withColumn("_digest", F.substring_index("ref", scheme, -1))
    return refs.join(facts, refs["_digest"] == facts["digest"], "left").drop("_digest", "digest")


def payload_of(text: Column) -> Column:
    return F.encode(text, "UTF-8")


def document_pages(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) as small pages: a heading, and a figure that names the text's padded payload by digest."""
    data = payload_of(text_or_empty())
    n = F.octet_length(data)
    fill = F.greatest(F.lit(1), F.ceil(n / UNIT)) * UNIT - n
    full = F.concat(data, F.unhex(F.repeat(F.lit("ff"), fill.cast("int"))))
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("?"))
    html = F.concat(F.lit("<article><h1>Document "), name, F.lit('</h1><figure><img src="sha256:'), F.sha2(full, 256), F.lit('"/><figcaption>Text of document '), name, F.lit("</figcaption></figure></article>"))
    return docs.select("doc_id", n.cast("long").alias("n_bytes"), html.alias("html"))


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as an image in a store, and every document as a page whose image reference is resolved by digest.

    Null texts are empty (one unit of padding); equal texts share one stored image; repeated rows
    keep their number.
    """
    docs = table(spark, sf_dir, "documents")
    facts = described(media_store(docs, payload_of(text_or_empty())))
    pages = sequences(document_pages(docs), F.col("html"))
    items = pages.select("doc_id", "n_bytes", F.explode("sequence").alias("item")).where("item.kind = 'media'")
    refs = items.select("doc_id", "n_bytes", F.col("item.ref").alias("ref"), F.col("item.pos").alias("pos"), F.col("item.caption").alias("caption"))
    out = resolved(refs, facts)
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pos", "caption")
