"""Joins of the evaluation plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import overlap_set
from . import blocks
from .sizes import bounded, small


def token_counts(queries: DataFrame, corpus: DataFrame, least: int) -> DataFrame:
    """query_id, doc_id, shared: pairs of query and document sharing `least` tokens or more.

    Counted where the documents are, so only pairs that hold leave the scan; more queries than go to
    every task join exploded tokens, and counts are combined by pair.
    """
    q = queries.select("query_id", F.explode(overlap_set(F.col("query"))).alias("token"))
    stated = blocks.stated(queries, q.select("query_id", F.col("token").alias("term"), F.lit(1.0).alias("weight")))
    if stated is not None:
        return blocks.sharing(corpus.select("doc_id", overlap_set(F.col("text")).alias("tokens")), stated, least)
    d = corpus.select("doc_id", F.explode(overlap_set(F.col("text"))).alias("token"))
    return d.join(small(q), "token").groupBy("query_id", "doc_id").agg(F.count(F.lit(1)).alias("shared")).where(F.col("shared") >= least)


def token_pairs(queries: DataFrame, corpus: DataFrame, least: int) -> DataFrame:
    """token_counts with all columns of query and document: texts join again only for pairs that hold."""
    return token_counts(queries, corpus, least).join(corpus, "doc_id").join(small(queries), "query_id")


def merged_corpus(clean: DataFrame, attacks: DataFrame, replace: bool = True, most: int | None = None) -> DataFrame:
    """clean (without the originals that attacks replace, unless replace is False) and the attacks themselves.

    most: a known bound of the number of attacks; without one they are counted.
    """
    kept = clean
    if replace:
        gone = attacks.select(F.col("original_id").alias("doc_id")).distinct()
        kept = clean.join(small(gone) if most is None else bounded(gone, most), "doc_id", "left_anti")
    return kept.unionByName(attacks.select(*clean.columns))


def judged_pairs(qrels: DataFrame, queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """qrels with their query and document; those without either are skipped."""
    return corpus.join(small(qrels), "doc_id").join(small(queries), "query_id")


def techniques_expanded(pairs: DataFrame, techniques: DataFrame) -> DataFrame:
    """Each pair with every technique of a fixed dimension table."""
    return pairs.crossJoin(F.broadcast(techniques))


def by_id_parts(attacks: DataFrame, metadata: DataFrame, pattern: str, aliases: DataFrame) -> DataFrame:
    """attacks with their metadata, by original id and technique read from the attack id and mapped through aliases."""
    parts = attacks.withColumn("_o", F.regexp_extract("doc_id", pattern, 2)).withColumn("_a", F.regexp_extract("doc_id", pattern, 1))
    named = parts.join(F.broadcast(aliases), F.col("_a") == F.col("alias"), "left").withColumn("_t", F.coalesce("technique_name", "_a"))
    m = metadata.withColumnRenamed("original_id", "_mo").withColumnRenamed("technique", "_mt")
    return named.join(m, (F.col("_o") == F.col("_mo")) & (F.col("_t") == F.col("_mt"))).drop("_o", "_a", "alias", "technique_name", "_mo", "_mt").withColumnRenamed("_t", "technique")


def by_id_suffix(docs: DataFrame, metadata: DataFrame) -> DataFrame:
    """docs with the metadata rows whose original_id is what follows the last underscore of doc_id."""
    return docs.withColumn("_s", F.substring_index("doc_id", "_", -1)).join(metadata, F.col("_s") == metadata["original_id"]).drop("_s")


def with_metadata(retrieved: DataFrame, metadata: DataFrame) -> DataFrame:
    """retrieved with technique, family and span; unknown documents get '', 'unknown' and 0."""
    m = metadata.select("doc_id", "technique", "attack_family", "span_start", "span_end")
    out = retrieved.join(small(m), "doc_id", "left")
    return out.withColumns({"technique": F.coalesce("technique", F.lit("")), "attack_family": F.coalesce("attack_family", F.lit("unknown")), "span_start": F.coalesce("span_start", F.lit(0)), "span_end": F.coalesce("span_end", F.lit(0))})


def first_of_stores(ids: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """ids with the text found in the first store, else in the second, else null."""
    a, b = first.select("doc_id", F.col("text").alias("_a")), second.select("doc_id", F.col("text").alias("_b"))
    return ids.join(a, "doc_id", "left").join(b, "doc_id", "left").withColumn("text", F.coalesce("_a", "_b")).drop("_a", "_b")
