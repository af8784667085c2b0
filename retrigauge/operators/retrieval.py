"""BM25, dense, learned-sparse and hybrid retrieval, and re-ranking."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import lexical_alignment, unit
from ..functions.text import bm25_tokens
from . import blocks
from .ranking import top_k
from .sizes import bounded, small

# BM25 parameters.
K1, B = 1.5, 0.75
VARIANTS = "plus1", "okapi"
#: Contributions are added as decimals, so that a score does not depend on the order of the sum.
EXACT, DIGITS = "decimal(38,12)", 6
#: Cells of 32 that ivf_retrieve searches: recall at 10 is 0.97 or more against brute force on the test tables.
PROBES = 24


def total(contribution: Column) -> Column:
    return F.round(F.sum(contribution.cast(EXACT)).cast("double"), DIGITS)


# --- BM25 ----------------------------------------------------------------------------------------


@dataclass
class BM25Index:
    """postings(term, doc_id, tf, dl) and terms(term, df, idf); the collection's size and mean length are in both. mean (okapi): the mean idf of all terms."""

    postings: DataFrame
    terms: DataFrame
    documents: DataFrame
    mean: DataFrame | None = None


def bm25_index(corpus: DataFrame, tokens: Callable[[Column, Column], Column] = bm25_tokens, variant: str = "plus1", only: DataFrame | None = None) -> BM25Index:
    """Index of corpus(doc_id, title, text). `only` (term) restricts postings to these terms before anything is shuffled.

    variant plus1: idf = max(0, ln(1 + (N-df+.5)/(df+.5))); okapi: ln((N-df+.5)/(df+.5)), negative
    ones replaced by a quarter of the mean idf.
    """
    if variant not in VARIANTS:
        raise ValueError(f"unknown BM25 variant: {variant}")
    docs = corpus.select("doc_id", tokens(F.col("title"), F.col("text")).alias("tokens")).withColumn("dl", F.size("tokens"))
    stats = docs.agg(F.count(F.lit(1)).alias("N"), F.avg("dl").alias("avgdl"))  # one row
    rows = docs.select("doc_id", "dl", F.explode("tokens").alias("term"))
    each = docs.select(F.explode(F.array_distinct("tokens")).alias("term"))  # a document's different terms: no posting is needed to count them
    if only is not None:
        only = small(only.distinct())
        rows, each = rows.join(only, "term", "left_semi"), each.join(only, "term", "left_semi")
    postings = rows.groupBy("doc_id", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = each.groupBy("term").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(stats))
    odds = (F.col("N") - F.col("df") + 0.5) / (F.col("df") + 0.5)
    mean = None
    if variant == "plus1":
        terms = df.withColumn("idf", F.greatest(F.lit(0.0), F.ln(1 + odds)))
    else:
        terms = df.withColumn("raw", F.ln(odds))
        mean = terms.agg((F.sum(F.col("raw").cast(EXACT)).cast("double") / F.count("raw")).alias("mean"))
        terms = terms.crossJoin(F.broadcast(mean)).withColumn("idf", F.when(F.col("raw") < 0, 0.25 * F.col("mean")).otherwise(F.col("raw")))
    return BM25Index(postings, terms.select("term", "df", "idf", "avgdl"), docs.select("doc_id", "dl"), mean)


def query_terms(queries: DataFrame) -> DataFrame:
    """query_id, term, qtf: a repeated term counts as often as it comes."""
    rows = queries.select("query_id", F.explode(bm25_tokens(F.lit(""), F.col("query"))).alias("term"))
    return rows.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))


def bm25_scores(index: BM25Index, queries: DataFrame) -> DataFrame:
    """query_id, doc_id, score of all pairs with a common term, by an equi-join on terms."""
    q = query_terms(queries)
    n = q.count()
    q = index.terms.join(bounded(q, n), "term")  # at most one row for each row of q
    tf, dl = F.col("tf"), F.col("dl")
    mean = F.when(F.col("avgdl") > 0, F.col("avgdl")).otherwise(1.0)
    part = F.col("qtf") * F.col("idf") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / mean))
    return index.postings.join(bounded(q, n), "term").groupBy("query_id", "doc_id").agg(total(part).alias("score"))


def padded_top_k(scores: DataFrame, queries: DataFrame, documents: DataFrame, k: int) -> DataFrame:
    """The k best documents of every query; if fewer match, documents of score 0 by ascending id fill up.

    The fillers are looked for among the first k ids plus as many as a query can have hits, so no
    query meets the whole corpus.
    """
    best = top_k(scores, k)
    short = queries.select("query_id").join(best.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")), "query_id", "left").where(F.coalesce("n", F.lit(0)) < k)
    first = documents.select("doc_id").orderBy("doc_id").limit(2 * k)
    fill = short.select("query_id").crossJoin(F.broadcast(first)).join(best.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")
    every = best.select("query_id", "doc_id", "score").unionByName(fill.withColumn("score", F.lit(0.0)))
    return top_k(every, k)


def bm25_best(corpus: DataFrame, queries: DataFrame, k: int, variant: str = "plus1", hits_only: bool = False) -> DataFrame | None:
    """query_id, doc_id, score, rank of the k best documents of every query, scored where they are; None if the queries are too many for that.

    Two passes over the corpus: one counts the documents of the queries' terms, one scores. Documents
    without a hit have score 0 and ids break ties, so they fill up unless hits_only.
    """
    if variant not in VARIANTS:
        raise ValueError(f"unknown BM25 variant: {variant}")
    stated = blocks.stated(queries, query_terms(queries).withColumnRenamed("qtf", "weight"))
    if stated is None:
        return None
    docs = corpus.select("doc_id", bm25_tokens(F.col("title"), F.col("text")).alias("tokens"))
    n, length, df = blocks.document_counts(docs, stated)
    odds = (n - df + 0.5) / (df + 0.5)
    if variant == "plus1":
        idf = np.array([max(0.0, math.log(1 + x)) for x in odds])
    else:
        raw = np.array([math.log(x) for x in odds])
        idf = np.where(raw < 0, 0.25 * bm25_index(corpus, variant=variant).mean.first()["mean"], raw) if (raw < 0).any() else raw
    mean = length / n if length else 1.0
    part = lambda tf, dl, qtf, term: qtf * idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / mean))
    return top_k(blocks.best(docs, stated, k, part, hits_only), k)


def bm25_retrieve(corpus: DataFrame, queries: DataFrame, k: int, variant: str = "plus1") -> DataFrame:
    """query_id, doc_id, score, rank. A stated set of queries meets the documents where they are; more queries join postings by shuffle."""
    found = bm25_best(corpus, queries, k, variant)
    if found is not None:
        return found
    only = query_terms(queries).select("term").distinct()
    index = bm25_index(corpus, variant=variant, only=only if variant == "plus1" else None)
    return padded_top_k(bm25_scores(index, queries), queries, index.documents, k)


# --- dense ---------------------------------------------------------------------------------------


def dense_scores(vectors: DataFrame, queries: DataFrame, metric: str = "cosine") -> DataFrame:
    """query_id, doc_id, score for a stated set of queries against all vectors, block by block in matrix products.

    queries(query_id, vector) go to every task (their number is checked); each batch of vectors keeps
    for itself only what the caller's top-k could take, see dense_retrieve.
    """
    return _blocks(vectors, queries, metric, None)


def dense_retrieve(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "cosine") -> DataFrame:
    """Exact top-k. Every batch gives its own k best (ties by id), so little is shuffled, then the global k best are taken."""
    return top_k(_blocks(vectors, queries, metric, max(k, 1)), max(k, 1))


def _blocks(vectors: DataFrame, queries: DataFrame, metric: str, k: int | None) -> DataFrame:
    if metric not in ("cosine", "dot"):
        raise ValueError(f"unknown metric: {metric}")
    rows = queries.select("query_id", "vector").limit(100_001).collect()
    if len(rows) > 100_000:
        raise ValueError("more than 100,000 queries: search in several runs")
    ids = [r["query_id"] for r in rows]
    q = np.array([r["vector"] for r in rows], np.float64).reshape(len(rows), -1)
    if metric == "cosine":
        n = np.linalg.norm(q, axis=1, keepdims=True)
        q = np.divide(q, n, out=q.copy(), where=n > 0)
    shared = vectors.sparkSession.sparkContext.broadcast((ids, q))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, q = shared.value
        for pdf in batches:
            if not len(pdf) or not len(ids):
                continue
            docs = pdf["doc_id"].to_numpy()
            m = np.array(pdf["vector"].tolist(), np.float64)
            if metric == "cosine":
                m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
            s = np.round(q @ m.T, DIGITS) + 0.0
            for i, query in enumerate(ids):
                order = np.lexsort((docs, -s[i]))[:k] if k else slice(None)
                yield pd.DataFrame({"query_id": query, "doc_id": docs[order], "score": s[i][order]})

    kinds = dict(queries.dtypes)["query_id"], dict(vectors.dtypes)["doc_id"]
    return vectors.select("doc_id", "vector").mapInPandas(run, f"query_id {kinds[0]}, doc_id {kinds[1]}, score double")


def ivf_index(vectors: DataFrame, cells: int = 32, sample: int = 20_000, rounds: int = 8) -> tuple[DataFrame, np.ndarray]:
    """(doc_id, vector, cell) of every vector and the cell centres, fitted by spherical k-means on a bounded sample."""
    picked = vectors.orderBy(F.xxhash64("doc_id")).limit(sample).select("vector").collect()
    x = np.array([r["vector"] for r in picked], np.float64)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    centres = x[: min(cells, len(x))].copy()
    for _ in range(rounds):
        own = (x @ centres.T).argmax(axis=1)
        for c in range(len(centres)):
            if (own == c).any():
                centres[c] = x[own == c].sum(axis=0)
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    shared = vectors.sparkSession.sparkContext.broadcast(centres)

    @F.pandas_udf("int")
    def cell(batch: pd.Series) -> pd.Series:
        return pd.Series((np.array(batch.tolist(), np.float64) @ shared.value.T).argmax(axis=1)) if len(batch) else pd.Series([], dtype="int32")

    return vectors.withColumn("cell", cell("vector")), centres


def ivf_retrieve(index: tuple[DataFrame, np.ndarray], queries: DataFrame, k: int, probes: int = PROBES) -> DataFrame:
    """Approximate top-k: exact cosine within the `probes` cells nearest to each query."""
    vectors, centres = index
    rows = queries.select("query_id", "vector").collect()
    near = []
    for r in rows:
        v = np.array(r["vector"], np.float64)
        near += [(r["query_id"], [float(x) for x in v], int(c)) for c in np.argsort(-(centres @ v), kind="stable")[:probes]]
    kinds = dict(queries.dtypes)["query_id"]
    q = vectors.sparkSession.createDataFrame(near, f"query_id {kinds}, q array<double>, cell int")
    from ..functions.scoring import dot

    scored = vectors.join(small(q), "cell").select("query_id", "doc_id", F.round(dot(F.col("q"), F.col("vector")) / F.greatest(F.sqrt(dot(F.col("q"), F.col("q"))) * F.sqrt(dot(F.col("vector"), F.col("vector"))), F.lit(1e-12)), DIGITS).alias("score"))
    return top_k(scored, k)


INDEXES = {"exact": dense_retrieve, "ivf": lambda v, q, k: ivf_retrieve(ivf_index(v), q, k)}


def resolve_index(name: str = "auto", available: tuple[str, ...] = tuple(INDEXES)) -> str:
    """auto is ivf if available, else exact; a known but missing backend and an unknown one are errors."""
    if name == "auto":
        return "ivf" if "ivf" in available else "exact"
    if name not in INDEXES:
        raise ValueError(f"unknown index backend: {name}")
    if name not in available:
        raise RuntimeError(f"index backend {name} is not available")
    return name


def encoder_input(model: str, title: Column, text: Column, query: bool = False) -> Column:
    """What an encoder reads: e5 models want passage:/query: prefixes, bge models an instruction before queries."""
    both = F.trim(F.concat_ws(" ", title, text))
    if "e5" in model.lower():
        return F.concat(F.lit("query: " if query else "passage: "), text if query else both)
    if "bge" in model.lower() and query:
        return F.concat(F.lit("Represent this sentence for searching relevant passages: "), text)
    return text if query else both


# --- learned sparse ------------------------------------------------------------------------------


def sparse_encode(logits: DataFrame) -> DataFrame:
    """doc_id, term, weight from logits(doc_id, term, logit): the largest log(1 + relu(logit)), zeros dropped (before the shuffle: they are no maximum of a term that stays)."""
    return logits.where("logit > 0").groupBy("doc_id", "term").agg(F.max(F.log1p(F.greatest(F.col("logit"), F.lit(0.0)))).alias("weight")).where("weight > 0")


def sparse_retrieve(documents: DataFrame, docs: DataFrame, queries: DataFrame, query_ids: DataFrame, k: int) -> DataFrame:
    """Dot-product top-k of sparse vectors in long form, filled with documents of score 0."""
    q = queries.select(F.col("doc_id").alias("query_id"), "term", F.col("weight").alias("wq"))
    scores = docs.join(small(q), "term").groupBy("query_id", "doc_id").agg(total(F.col("wq") * F.col("weight")).alias("score"))
    return padded_top_k(scores, query_ids, documents, k)


def sparse_counts_retrieve(corpus: DataFrame, queries: DataFrame, query_ids: DataFrame, k: int, weight: Callable[[np.ndarray], np.ndarray]) -> DataFrame | None:
    """As sparse_retrieve, for documents whose weight of a term is a function of its count: scored where they are. None if the queries are too many for that.

    queries(doc_id, term, weight) are the queries' vectors; a document's weights never leave its task.
    """
    stated = blocks.stated(query_ids, queries.select(F.col("doc_id").alias("query_id"), "term", "weight"))
    if stated is None:
        return None
    docs = corpus.select("doc_id", bm25_tokens(F.col("title"), F.col("text")).alias("tokens"))
    return top_k(blocks.best(docs, stated, k, lambda tf, dl, wq, term: wq * weight(tf)), k)


# --- hybrid and re-ranking -----------------------------------------------------------------------


def min_max(scored: DataFrame, into: str = "norm") -> DataFrame:
    """Scores of each query mapped to 0..1; 1 if all are equal."""
    w = Window.partitionBy("query_id")
    low, high = F.min("score").over(w), F.max("score").over(w)
    return scored.withColumn(into, F.when(high == low, F.lit(1.0)).otherwise((F.col("score") - low) / (high - low)))


def hybrid(bm25: DataFrame, dense: DataFrame, k: int, alpha: float = 0.5) -> DataFrame:
    """alpha times normalised BM25 and 1 - alpha times normalised dense, a missing side counting 0; top k."""
    a = min_max(bm25).select("query_id", "doc_id", F.col("norm").alias("a"))
    b = min_max(dense).select("query_id", "doc_id", F.col("norm").alias("b"))
    both = a.join(b, ["query_id", "doc_id"], "full_outer")
    score = F.round(F.lit(alpha) * F.coalesce("a", F.lit(0.0)) + F.lit(1 - alpha) * F.coalesce("b", F.lit(0.0)), DIGITS)
    return top_k(both.select("query_id", "doc_id", score.alias("score")), k)


def pool_size(k: int, given: int | None = None) -> int:
    return given or max(3 * k, 50)


def hydrated(ranked: DataFrame, corpus: DataFrame, most: int) -> DataFrame:
    """ranked (no more than `most` rows: queries times k) with title and text; ids that the corpus does not have are dropped."""
    return corpus.join(bounded(ranked, most), "doc_id")


RERANKERS: dict[str, Callable[[Column, Column], Column]] = {"lexical": lambda query, text: lexical_alignment(query, F.lit(""), text)}
RETRIEVERS: dict[str, Callable] = {"bm25": bm25_retrieve, "dense": dense_retrieve, "sparse": sparse_retrieve, "hybrid": hybrid}


def named(registry: dict, name: str):
    if name not in registry:
        raise ValueError(f"unknown name: {name} (known: {', '.join(sorted(registry))})")
    return registry[name]


def rerank(pool: DataFrame, queries: DataFrame, corpus: DataFrame, most: int, top_n: int = 10, scorer: str | Callable[[Column, Column], Column] = "lexical") -> DataFrame:
    """pool(query_id, doc_id, rank; no more than `most` rows) in the order of scorer(query, text), ties in the old order, first top_n.

    A scorer may be any function of Columns, a pandas UDF around a model included; it sees text without title.
    """
    score = named(RERANKERS, scorer) if isinstance(scorer, str) else scorer
    rows = hydrated(pool.select("query_id", "doc_id", F.col("rank").alias("old_rank")), corpus.select("doc_id", "text"), most).join(small(queries), "query_id")
    scored = rows.select("query_id", "doc_id", "old_rank", score(F.col("query"), F.col("text")).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "old_rank")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_n)


def unit_vectors(vectors: DataFrame) -> DataFrame:
    """vectors with `unit`, normalised once for a stored index."""
    return vectors.withColumn("unit", unit(F.col("vector")))
