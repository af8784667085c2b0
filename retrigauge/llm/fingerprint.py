"""One-permutation MinHash fingerprints (operator 4)."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import small_batches, table, text_or_empty

#: Bins of a fingerprint and low-order bits that each keeps; words in a shingle.
BINS, BITS, SHINGLE = 256, 8, 5
_MIX = np.uint64(0x9E3779B97F4A7C15)
_CACHE_WORDS = 500_000


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit moves every output bit."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Sketcher:
    """Fingerprints of texts: runs of five ASCII-lower-cased words, fewer words: all of them, none: all zero bits."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def word_hashes(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > _CACHE_WORDS:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh64_intdigest(w)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))

    def shingles(self, text: str) -> np.ndarray:
        words = text.encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        h, k = self.word_hashes(words), min(SHINGLE, len(words))
        out = np.zeros(len(h) - k + 1, np.uint64)
        for i in range(k):
            out = (out * _MIX) + h[i : len(h) - k + 1 + i]
        return _mixed(out)

    def sketch(self, text: str) -> np.ndarray | None:
        """Low bits of the least hash of each bin; None for a text without words."""
        h = self.shingles(text)
        if not len(h):
            return None
        bins = (h >> np.uint64(56)).astype(np.int64) if BINS == 256 else (h % np.uint64(BINS)).astype(np.int64)
        least = np.full(BINS, np.iinfo(np.uint64).max, np.uint64)
        np.minimum.at(least, bins, h)
        full = np.zeros(BINS, bool)
        full[bins] = True
        return densified(least, full).astype(np.uint8)


def densified(values: np.ndarray, full: np.ndarray) -> np.ndarray:
    """Optimal densification: each empty bin asks bins in an order of its own, by a hash of (bin, attempt), until one is full."""
    out, empty, attempt = values.copy(), np.flatnonzero(~full), 1
    while len(empty):
        asked = (_mixed((empty.astype(np.uint64) << np.uint64(32)) | np.uint64(attempt)) % np.uint64(len(values))).astype(np.int64)
        hit = full[asked]
        out[empty[hit]] = values[asked[hit]]
        empty, attempt = empty[~hit], attempt + 1
    return out


def likeness(a: np.ndarray | None, b: np.ndarray | None) -> float:
    """Estimated resemblance: the share of equal bins, less the 2**-BITS that agree by chance; two texts without words are alike."""
    if a is None or b is None:
        return 1.0 if a is b else 0.0
    chance = 2.0**-BITS
    return float(min(1.0, max(0.0, ((a == b).mean() - chance) / (1 - chance))))


def packed(sketch: np.ndarray | None) -> str:
    """The kept bits as hexadecimal digits; empty for a text without words."""
    return "" if sketch is None else sketch.tobytes().hex()


def edited(text: str, following: str) -> str:
    """text with its last quarter (rounded down) replaced by as many first code points of the next one, or all of them."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def with_following(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """doc_id, text in buckets of ascending doc_id, each with the first document of the next bucket (carried = 1) behind its own.

    Whole texts are shuffled once. Bucket borders are quantiles of doc_id; the first documents are
    found from ids alone and sent to the bucket before as well (from the first bucket to the last),
    so the order is a ring and no task sees more than its bucket. Null doc_ids come last.
    """
    spark = docs.sparkSession
    buckets = buckets or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = docs.stat.approxQuantile("doc_id", [i / buckets for i in range(1, buckets)], 0.2 / buckets) if buckets > 1 else []
    splits = [-math.inf, *sorted(set(cuts) or {0.0}), math.inf]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).withColumn("_x", F.coalesce(F.col("doc_id").cast("double"), F.lit(math.nan)))
    # A binary search over the borders in the JVM; null ids get the bucket behind the last.
    rows = Bucketizer(splits=splits, inputCol="_x", outputCol="_b", handleInvalid="keep").transform(rows).select("doc_id", "text", F.col("_b").cast("int").alias("bucket"))
    firsts = sorted((r["bucket"], r["low"]) for r in rows.groupBy("bucket").agg(F.min("doc_id").alias("low")).collect())  # one row per bucket
    before = [(low, b, firsts[i - 1][0]) for i, (b, low) in enumerate(firsts)]
    heads = spark.createDataFrame(before, "low long, own int, before int")  # as many rows as buckets
    joined = rows.join(F.broadcast(heads), (F.col("bucket") == F.col("own")) & F.col("doc_id").eqNullSafe(F.col("low")), "left")
    here = F.struct(F.col("bucket").alias("to"), F.lit(0).alias("carried"))
    there = F.struct(F.col("before").alias("to"), F.lit(1).alias("carried"))
    sent = joined.select("doc_id", "text", F.explode(F.when(F.col("before").isNull(), F.array(here)).otherwise(F.array(here, there))).alias("go"))
    sent = sent.select("doc_id", "text", F.col("go.to").alias("bucket"), F.col("go.carried").alias("carried"))
    return sent.repartition(F.col("bucket")).sortWithinPartitions("bucket", "carried", F.col("doc_id").asc_nulls_last(), F.xxhash64("text"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every document.

    A null text is empty; a text without words has an empty fingerprint and is alike only to another
    such. Repeated doc_ids follow one another in the order of their texts' hashes. A table of one
    document is its own next.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s, held = Sketcher(), None  # held: the row that waits for the next one of its bucket

        def row(doc, text, sketch, following, next_sketch):
            new = edited(text, following)
            other = s.sketch(new)
            sha = hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest()
            return doc, len(text), sha, packed(sketch), packed(other), likeness(sketch, other), likeness(sketch, next_sketch)

        for pdf in batches:
            out = []
            for doc, text, bucket, carried in zip(pdf["doc_id"], pdf["text"], pdf["bucket"], pdf["carried"], strict=True):
                if held and held[3] != bucket:
                    held = None
                if carried and not held:
                    continue
                sketch = s.sketch(text)
                if held:
                    out.append(row(held[0], held[1], held[2], text, sketch))
                held = None if carried else (None if pd.isna(doc) else int(doc), text, sketch, bucket)
            frame = pd.DataFrame(out, columns=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            yield frame

    small_batches(docs.sparkSession)
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_following(docs).mapInPandas(run, schema)


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
