"""SimHash near-duplicates by multi-index hashing (operator 9)."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .shared import merged, small_batches, table, text_or_empty, written

SHINGLE, SEED, NEAR = 4, 42, 4
SALTS = 8


def fingerprint(text: str | None) -> int:
    """64-bit SimHash as a signed long: words of the ASCII-lower-cased text, runs of four (repeats count)."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    lens = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lens + 1) - 1
    k = min(SHINGLE, len(words))
    first, last = (ends - lens)[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(first, last, strict=True)), np.uint64, len(first))
    votes = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        votes += np.unpackbits(h[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(h)).view(">i8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, th (hash of the text), fp: a narrow map over whole texts; a null text counts as empty and has fingerprint 0."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "th": pdf["th"], "fp": [fingerprint(x) for x in pdf["text"]]})

    small_batches(docs.sparkSession)
    return docs.select("doc_id", text_hash().alias("th"), "text").mapInPandas(run, "doc_id long, th long, fp long")


def text_hash() -> Column:
    return F.xxhash64(text_or_empty())


def segments(n: int) -> list[tuple[int, int, int]]:
    """(shift, bits, radius) of each segment for n fingerprints.

    Four differing bits cannot spoil every segment by more than its radius if the sum of radius + 1
    is above four. Both layouts find every link; the second reads more balls of far rarer keys.
    """
    return [(41, 23, 1), (18, 23, 1), (0, 18, 0)] if n <= 1 << 25 else [(32, 32, 2), (0, 32, 1)]


def balls(bits: int, radius: int) -> list[int]:
    return [0] + [sum(1 << b for b in c) for r in range(1, radius + 1) for c in combinations(range(bits), r)]


def links(prints: DataFrame, n: int) -> DataFrame:
    """(a, b), a < b: all pairs of the distinct fingerprints in prints(fp) that differ in at most four bits."""
    index, probes = None, None
    for k, (shift, bits, radius) in enumerate(segments(n)):
        key = F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << bits) - 1))
        tag = F.lit(k << 56)
        part = prints.select(key.bitwiseOR(tag).alias("key"), F.col("fp").alias("b"))
        masks = F.array(*[F.lit(m).cast("long") for m in balls(bits, radius)])
        probe = prints.select(key.bitwiseOR(tag).alias("at"), F.col("fp").alias("a"), F.explode(masks).alias("m")).select(F.col("at").bitwiseXOR(F.col("m")).alias("key"), "a")
        index, probes = (part, probe) if index is None else (index.union(part), probes.union(probe))
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= NEAR)
    # Spark takes the probes for as small as the files they are exploded from, and would send them whole through the driver.
    found = probes.hint("merge").join(index, (probes["key"] == index["key"]) & near)
    return found.select("a", "b").distinct()


def near_duplicates(prints: DataFrame) -> DataFrame:
    """prints(doc_id, fp, ...) with component_id, the least doc_id reachable over links, itself included, and root, its group's least fingerprint.

    Equal fingerprints are one node, so groups of exact copies cost one row. A null doc_id takes part
    and gets the component of its fingerprint (null if no other document shares it). Repeated rows
    keep their number. No text, no words: fingerprint 0, linked like any other.
    """
    prints = written(prints, "prints")
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("n")), "nodes")
    n = nodes.count()
    comps = merged(components(links(nodes.select("fp"), n)), n)
    held = nodes.join(comps, nodes["fp"] == comps["node"], "left").select("fp", "low", "n", "component")
    lows = merged(held.where("component is not null").groupBy("component").agg(F.min("low").alias("least")), n)
    shared = held.where("n > 1 or component is not null").join(lows, "component", "left").select("fp", F.coalesce("least", "low").alias("least"), F.coalesce("component", "fp").alias("root"))
    # Spark takes the salted rows for as small as those they are exploded from, here too.
    shared = merged(shared.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)]))), n * SALTS)
    salted = prints.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    return salted.join(shared, ["fp", "salt"], "left").select(*prints.columns, F.coalesce("least", "doc_id").alias("component_id"), F.coalesce("root", "fp").alias("root"))


def keep_first(docs: DataFrame) -> DataFrame:
    """One document of each group of near-duplicates, all columns unchanged.

    It is that of least doc_id (null last), of equal ones that of the least fingerprint and text hash;
    of rows equal in doc_id and text any one.
    """
    found = near_duplicates(fingerprints(docs)).groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp", "th")).alias("x"))
    one = written(found.select(F.coalesce("x.doc_id", F.lit(0)).alias("_i"), F.col("x.none").alias("_n"), F.col("x.th").alias("_t")), "kept")
    held = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("_id"), F.col("doc_id").isNull().alias("_none"), text_hash().alias("_th"), *[F.col(c).alias(f"_z_{c}") for c in docs.columns])
    # A merge join at every size: a broadcast of kept ids would be right for small inputs only. Its
    # keys are never null, so that repeated rows go without another shuffle of texts.
    out = held.join(one.hint("merge"), (F.col("_id") == F.col("_i")) & (F.col("_none") == F.col("_n")) & (F.col("_th") == F.col("_t")), "left_semi")
    return out.dropDuplicates(["_id", "_none", "_th"]).select(*[F.col(f"_z_{c}").alias(c) for c in docs.columns])


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(fingerprints(table(spark, sf_dir, "documents")))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
