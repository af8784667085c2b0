"""Queries over retrieval, traces and metrics."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import hashing, scoring
from ..operators import metrics, ranking
from ..operators import retrieval as R
from ..operators.joins import token_counts
from .catalog import Tables, query
from .text_plans import PAIRS_SQL, WS

K, POOL = 10, 20

DTOK = f"dtok AS (SELECT doc_id, {WS.format(chr(39).join(['lower(', ' ', ' || text)']))} AS k FROM documents)"
POSTINGS = f"""{DTOK},
st AS (SELECT count(*) AS N, avg(len(k)) AS avgdl FROM dtok),
tf AS (SELECT doc_id, any_value(dl) AS dl, term, count(*) AS tf FROM (SELECT doc_id, len(k) AS dl, unnest(k) AS term FROM dtok) GROUP BY doc_id, term),
dfs AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
btok AS (SELECT item_id AS query_id, unnest({WS.format('lower(text)')}) AS term FROM benchmark),
bq AS (SELECT query_id, term, count(*) AS qtf FROM btok GROUP BY query_id, term)"""
PLUS1 = "greatest(0.0::DOUBLE, ln(1 + (N - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)))"


def _scores(idf: str) -> str:
    return f"""sc AS (SELECT query_id, doc_id, round(CAST(sum(CAST(qtf * {idf} * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl)) AS DECIMAL(38, 12))) AS DOUBLE), 6) AS score
FROM bq JOIN tf USING (term) JOIN dfs USING (term), st GROUP BY query_id, doc_id)"""


def _padded(scores: str, into: str) -> str:
    """Every document's rank for every query: those without a hit have score 0."""
    return f"""{into} AS (
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank
FROM (SELECT query_id, doc_id, coalesce(score, 0.0::DOUBLE) AS score
      FROM (SELECT DISTINCT item_id AS query_id FROM benchmark) CROSS JOIN (SELECT doc_id FROM documents) LEFT JOIN {scores} USING (query_id, doc_id)))"""


BM25_SQL = f"""{POSTINGS}, {_scores(PLUS1)},
{_padded('sc', 'ranked')}"""


@query("op40_bm25_index", f"WITH {POSTINGS} SELECT term, df, round({PLUS1}, 6) AS idf FROM dfs, st")
def op40(spark, d):
    return R.bm25_index(Tables(spark, d).corpus).terms.select("term", "df", F.round("idf", 6).alias("idf"))


@query("op41_bm25_scores", f"WITH {BM25_SQL} SELECT query_id, doc_id, score FROM sc")
def op41(spark, d):
    t = Tables(spark, d)
    return R.bm25_scores(R.bm25_index(t.corpus, only=R.query_terms(t.questions).select("term")), t.questions)


@query(
    "op41b_bm25_okapi",
    f"""WITH {POSTINGS}, raw AS (SELECT term, df, ln((N - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) AS r FROM dfs, st), m AS (SELECT CAST(sum(CAST(r AS DECIMAL(38, 12))) AS DOUBLE) / count(*) AS mean FROM raw),
    idf AS (SELECT term, CASE WHEN r < 0 THEN 0.25::DOUBLE * mean ELSE r END AS idf FROM raw, m),
    sc AS (SELECT query_id, doc_id, round(CAST(sum(CAST(qtf * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl)) AS DECIMAL(38, 12))) AS DOUBLE), 6) AS score FROM bq JOIN tf USING (term) JOIN idf USING (term), st GROUP BY query_id, doc_id)
    SELECT query_id, doc_id, score FROM sc QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= {K}""",
)
def op41b(spark, d):
    t = Tables(spark, d)
    found = R.bm25_best(t.corpus, t.questions, K, "okapi", hits_only=True)
    if found is None:
        found = ranking.top_k(R.bm25_scores(R.bm25_index(t.corpus, variant="okapi"), t.questions), K)
    return found.select("query_id", "doc_id", "score")


def bm25(t: Tables, k: int) -> DataFrame:
    return R.bm25_retrieve(t.corpus, t.questions, k)


@query("op42_bm25_top_k", f"WITH {BM25_SQL} SELECT query_id, doc_id, score, rank FROM ranked WHERE rank <= {K}")
def op42(spark, d):
    return bm25(Tables(spark, d), K)


def vectors(t: Tables) -> tuple[DataFrame, DataFrame]:
    v = t.embeddings.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    return v, v.where("doc_id % 100 = 0").withColumnRenamed("doc_id", "query_id")


VEC = "v AS (SELECT vec_id AS doc_id, embedding::DOUBLE[] AS e FROM embeddings), q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS qe FROM embeddings WHERE vec_id % 100 = 0)"


def _dense(measure: str, k: int = K) -> str:
    return f"{VEC}, sc AS (SELECT query_id, doc_id, round({measure}, 6) + 0.0 AS score FROM q, v), dn AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sc QUALIFY rank <= {k})"


@query("op43_dense_cosine", f"WITH {_dense('list_cosine_similarity(qe, e)')} SELECT * FROM dn")
def op43(spark, d):
    v, q = vectors(Tables(spark, d))
    return R.dense_retrieve(v, q, K)


@query("op44_dense_dot", f"WITH {_dense('list_inner_product(qe, e)')} SELECT * FROM dn")
def op44(spark, d):
    v, q = vectors(Tables(spark, d))
    return R.dense_retrieve(v, q, K, "dot")


@query("op45_dense_ivf")
def op45(spark, d):
    v, q = vectors(Tables(spark, d))
    return R.ivf_retrieve(R.ivf_index(v), q, K)


@query("op47_encoder_prefix", "SELECT doc_id, md5('passage: ' || trim(' ' || text, ' ')) AS e5, md5(trim(' ' || text, ' ')) AS bge FROM documents")
def op47(spark, d):
    c = Tables(spark, d).corpus
    return c.select("doc_id", F.md5(R.encoder_input("e5-base", F.col("title"), F.col("text"))).alias("e5"), F.md5(R.encoder_input("bge-small", F.col("title"), F.col("text"))).alias("bge"))


def logits(t: Tables, every: bool = False) -> tuple[DataFrame, DataFrame]:
    """Stand-in logits: a term's count less a half, for documents (the queries' terms only, or every term) and queries."""
    q = R.query_terms(t.questions).select(F.col("query_id").alias("doc_id"), "term", (F.col("qtf") - 0.5).alias("logit"))
    p = R.bm25_index(t.corpus, only=None if every else q.select("term")).postings.select("doc_id", "term", (F.col("tf") - 1.5).alias("logit"))
    return p, q


SPARSE = f"""{POSTINGS}, dw AS (SELECT doc_id, term, ln(1 + greatest(tf - 1.5::DOUBLE, 0)) AS w FROM tf WHERE tf > 1 AND term IN (SELECT term FROM btok)),
qw AS (SELECT query_id, term, ln(1 + greatest(qtf - 0.5::DOUBLE, 0)) AS wq FROM bq),
sp AS (SELECT query_id, doc_id, round(CAST(sum(CAST(wq * w AS DECIMAL(38, 12))) AS DOUBLE), 6) AS score FROM qw JOIN dw USING (term) GROUP BY query_id, doc_id),
{_padded('sp', 'spr')}"""


@query("op48_sparse_encode", f"WITH {SPARSE.replace(' AND term IN (SELECT term FROM btok)', '')} SELECT doc_id, term, round(w, 6) AS weight FROM dw")
def op48(spark, d):
    return R.sparse_encode(logits(Tables(spark, d), every=True)[0]).select("doc_id", "term", F.round("weight", 6).alias("weight"))


def sparse(t: Tables, k: int) -> DataFrame:
    p, q = logits(t)
    found = R.sparse_counts_retrieve(t.corpus, R.sparse_encode(q), t.questions, k, lambda tf: np.log1p(np.maximum(tf - 1.5, 0)))
    return found if found is not None else R.sparse_retrieve(t.corpus, R.sparse_encode(p), R.sparse_encode(q), t.questions, k)


@query("op49_sparse_top_k", f"WITH {SPARSE} SELECT query_id, doc_id, score, rank FROM spr WHERE rank <= {K}")
def op49(spark, d):
    return sparse(Tables(spark, d), K)


MM = "CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END"


@query("op4A_min_max", f"WITH {BM25_SQL} SELECT query_id, doc_id, round({MM}, 6) AS norm FROM ranked WHERE rank <= 50 WINDOW w AS (PARTITION BY query_id)")
def op4a(spark, d):
    return R.min_max(bm25(Tables(spark, d), 50)).select("query_id", "doc_id", F.round("norm", 6).alias("norm"))


HYBRID = f"""WITH {BM25_SQL}, {SPARSE.replace(POSTINGS + ', ', '')},
a AS (SELECT query_id, doc_id, {MM} AS a FROM ranked WHERE rank <= 50 WINDOW w AS (PARTITION BY query_id)),
b AS (SELECT query_id, doc_id, {MM} AS b FROM spr WHERE rank <= 50 WINDOW w AS (PARTITION BY query_id)),
h AS (SELECT query_id, doc_id, round(0.8::DOUBLE * coalesce(a, 0) + (1 - 0.8::DOUBLE) * coalesce(b, 0), 6) AS score FROM a FULL JOIN b USING (query_id, doc_id))
"""


@query("op4B_hybrid", HYBRID + f"SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM h QUALIFY rank <= {K}")
def op4b(spark, d):
    t = Tables(spark, d)
    n = R.pool_size(K)
    return R.hybrid(bm25(t, n), sparse(t, n), K, 0.8)


@query("op4C_hydrate", f"WITH {BM25_SQL} SELECT query_id, rank, doc_id, md5(text) AS digest FROM ranked JOIN documents USING (doc_id) WHERE rank <= {K}")
def op4c(spark, d):
    t = Tables(spark, d)
    return R.hydrated(bm25(t, K), t.corpus, K * t.question_count).select("query_id", "rank", "doc_id", F.md5("text").alias("digest"))


def reranked(t: Tables, k: int = K) -> DataFrame:
    return R.rerank(bm25(t, POOL), t.questions, t.corpus, POOL * t.question_count, 10, overlap_scorer).where(F.col("rank") <= k)


def overlap_scorer(q, text):
    """A cheap deterministic cross-encoder stand-in: the share of the query's tokens in the text."""
    return F.round(scoring.overlap_fraction(q, text), 6)


RERANK = f"""WITH {BM25_SQL}, rr AS (SELECT query_id, doc_id, rank AS old_rank, round(len(list_intersect(list_distinct(regexp_extract_all(lower(b.text), '[A-Za-z0-9]+')), list_distinct(regexp_extract_all(lower(d.text), '[A-Za-z0-9]+')))) / len(list_distinct(regexp_extract_all(lower(b.text), '[A-Za-z0-9]+'))), 6) AS score
FROM ranked JOIN documents d USING (doc_id) JOIN benchmark b ON item_id = query_id WHERE rank <= {POOL}), rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, old_rank) AS rank FROM rr)
"""


@query("op4D_rerank", RERANK + "SELECT query_id, doc_id, old_rank, score, rank FROM rk WHERE rank <= 10")
def op4d(spark, d):
    return reranked(Tables(spark, d))


@query("op4E_pool_then_cut", RERANK + "SELECT query_id, doc_id, rank FROM rk WHERE rank <= 6")
def op4e(spark, d):
    return reranked(Tables(spark, d), 6).select("query_id", "doc_id", "rank")


@query(
    "op4G_semantic_query_pick",
    f"""WITH {VEC}, s AS (SELECT doc_id, query_id, round(list_cosine_similarity(qe, e), 6) AS sim FROM q, v), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY sim DESC, query_id) AS rank FROM s QUALIFY rank <= 3),
    k AS (SELECT *, CASE WHEN sim > 0 THEN -ln(1 - CAST('0x' || substr(md5('pick' || doc_id || '-' || query_id), 1, 12) AS BIGINT) / 281474976710656.0::DOUBLE) / sim ELSE 1e9 + rank END AS key FROM r)
    SELECT doc_id, arg_min(query_id, key) AS query_id, min(round(sim, 6)) FILTER (WHERE rank = 1) AS best_sim FROM k GROUP BY doc_id""",
)
def op4g(spark, d):
    """Each vector with one of its three nearest queries, drawn in proportion to similarity by a hash."""
    v, q = vectors(Tables(spark, d))
    near = R.dense_scores(v, q)
    near = ranking.top_k(near, 3, group="doc_id", tie="query_id")
    key = hashing.weighted_key(F.concat(F.lit("pick"), F.col("doc_id").cast("string"), F.lit("-"), F.col("query_id").cast("string")), F.col("score"))
    near = near.withColumn("key", F.when(F.col("score") > 0, key).otherwise(F.lit(1e9) + F.col("rank")))
    return near.groupBy("doc_id").agg(F.min_by("query_id", "key").alias("query_id"), F.min(F.when(F.col("rank") == 1, F.col("score"))).alias("best_sim"))


@query("op4H_pair_cosine", "WITH p AS (SELECT vec_id, embedding::DOUBLE[] AS a, lead(embedding::DOUBLE[]) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM embeddings) SELECT vec_id, round(CASE WHEN b IS NULL THEN -1.0 ELSE list_cosine_similarity(a, b) END, 6) AS sim FROM p")
def op4h(spark, d):
    from pyspark.sql import Window

    e = Tables(spark, d).embeddings
    b = F.lead("embedding").over(Window.partitionBy("label").orderBy("vec_id"))
    return e.withColumn("b", b).select("vec_id", F.round(scoring.cosine(F.col("embedding"), F.col("b")), 6).alias("sim"))


# --- traces and metrics --------------------------------------------------------------------------


def targeted(t: Tables) -> DataFrame:
    """query_id, target_doc_id: the document that shares most tokens with the query (20 at least), of equals the first."""
    best = ranking.top_k(token_counts(t.questions, t.corpus, 20).select("query_id", "doc_id", "shared"), 1, by="shared")
    return t.questions.select("query_id").join(best.select("query_id", F.col("doc_id").alias("target_doc_id")), "query_id", "left")


def flags(t: Tables) -> DataFrame:
    return t.labels.select("doc_id", (F.col("toxic") == 1).alias("poisoned"))


def traced(t: Tables) -> DataFrame:
    return metrics.traces(bm25(t, K), targeted(t), flags(t))


TRACE = f"""WITH {BM25_SQL}, {PAIRS_SQL},
tg AS (SELECT query_id, arg_min(doc_id, (-shared, doc_id)) AS target_doc_id FROM pairs GROUP BY query_id),
tq AS (SELECT item_id AS query_id, target_doc_id FROM benchmark LEFT JOIN tg ON tg.query_id = item_id),
rr AS (SELECT r.query_id, r.doc_id, r.score, r.rank, coalesce(l.toxic = 1, false) AS poisoned, tq.target_doc_id, coalesce(r.doc_id = tq.target_doc_id, false) AS hit FROM ranked r LEFT JOIN labels l USING (doc_id) JOIN tq USING (query_id) WHERE rank <= {K}),
tr AS (SELECT query_id, any_value(target_doc_id) AS target_doc_id, bool_or(poisoned) AS any_poison, count(*) FILTER (WHERE poisoned) AS poison_count, coalesce(min(rank) FILTER (WHERE poisoned), -1) AS first_poison_rank,
  coalesce(min(rank) FILTER (WHERE hit), -1) AS target_rank, arg_min(doc_id, rank) AS top1_doc_id, arg_min(poisoned, rank) AS top1_poisoned, arg_min(doc_id, (NOT hit, rank)) FILTER (WHERE poisoned) AS analysis_doc_id,
  array_to_string(list(doc_id || ':' || poisoned ORDER BY rank), ',') AS retrieved FROM rr GROUP BY query_id)
"""


@query("op81_trace", TRACE + "SELECT query_id, target_doc_id, any_poison, poison_count, CAST(first_poison_rank AS INT) AS first_poison_rank, CAST(target_rank AS INT) AS target_rank, target_rank > 0 AS target_retrieved, target_rank = 1 AS target_top1, top1_doc_id, top1_poisoned FROM tr")
def op81(spark, d):
    return traced(Tables(spark, d)).select("query_id", "target_doc_id", "any_poison", "poison_count", "first_poison_rank", "target_rank", "target_retrieved", "target_top1", "top1_doc_id", "top1_poisoned")


@query("op82_analysis_document", TRACE + "SELECT query_id, analysis_doc_id FROM tr")
def op82(spark, d):
    return traced(Tables(spark, d)).select("query_id", "analysis_doc_id")


@query("op22_serialised_results", TRACE + "SELECT query_id, retrieved FROM tr")
def op22(spark, d):
    item = lambda x: F.concat(x["doc_id"].cast("string"), F.lit(":"), x["poisoned"].cast("string"))
    return traced(Tables(spark, d)).select("query_id", F.array_join(F.transform("retrieved", item), ",").alias("retrieved"))


@query("op23_analysable_rows", TRACE + "SELECT query_id FROM tr WHERE analysis_doc_id IS NOT NULL AND any_poison")
def op23(spark, d):
    return traced(Tables(spark, d)).where("analysis_doc_id is not null and any_poison").select("query_id")


@query(
    "op70_exposure_summary",
    TRACE
    + """SELECT count(*) AS n, count(*) FILTER (WHERE any_poison) AS any_poison_n, round(100.0::DOUBLE * count(*) FILTER (WHERE any_poison) / count(*), 1) AS any_poison_pct, count(*) FILTER (WHERE target_rank > 0) AS target_retrieved_n,
    round(100.0::DOUBLE * count(*) FILTER (WHERE target_rank > 0) / count(*), 1) AS target_retrieved_pct, count(*) FILTER (WHERE target_rank = 1) AS target_top1_n, round(100.0::DOUBLE * count(*) FILTER (WHERE target_rank = 1) / count(*), 1) AS target_top1_pct,
    count(*) FILTER (WHERE top1_poisoned) AS top1_poisoned_n, round(100.0::DOUBLE * count(*) FILTER (WHERE top1_poisoned) / count(*), 1) AS top1_poisoned_pct, round(avg(poison_count), 4) AS mean_poison_count,
    coalesce(round(avg(target_rank) FILTER (WHERE target_rank > 0), 4), -1.0::DOUBLE) AS mean_target_rank, coalesce(median(target_rank) FILTER (WHERE target_rank > 0), -1.0::DOUBLE) AS median_target_rank FROM tr""",
)
def op70(spark, d):
    return metrics.exposure_summary(traced(Tables(spark, d)))


@query(
    "op71_breakdown",
    TRACE
    + """, x AS (SELECT tr.*, coalesce(lang, '') AS family, coalesce(source, '') AS technique FROM tr LEFT JOIN documents d ON d.doc_id = tr.target_doc_id)
    SELECT 'family' AS dimension, family AS value, count(*) AS n, count(*) FILTER (WHERE target_rank > 0) AS target_retrieved, count(*) FILTER (WHERE target_rank = 1) AS target_top1 FROM x GROUP BY family
    UNION ALL SELECT 'technique', technique, count(*), count(*) FILTER (WHERE target_rank > 0), count(*) FILTER (WHERE target_rank = 1) FROM x GROUP BY technique""",
)
def op71(spark, d):
    t = Tables(spark, d)
    meta = t.documents.select(F.col("doc_id").alias("target_doc_id"), F.col("lang").alias("family"), F.col("source").alias("technique"))
    return metrics.breakdown(traced(t).join(meta, "target_doc_id", "left"), ["family", "technique"])


def judged(t: Tables) -> DataFrame:
    """Judged rows out of events: flags by predicates, a similarity in hundredths, a verdict that may be missing."""
    e = t.events.select("event_id", F.col("event_type").alias("family"), F.col("user_id").alias("analysis_doc_id"), F.col("event_id").alias("target_doc_id"), (F.col("value") > 20).alias("any_poison"), (F.col("user_id") % 2 == 0).alias("target_retrieved"), (F.pmod("event_id", F.lit(100)) / 100.0).alias("sim"))
    e = e.withColumn("target_doc_id", F.col("target_doc_id") % 7).withColumn("analysis_doc_id", F.col("analysis_doc_id") % 7)
    e = e.withColumn("verdict", F.when(F.col("event_id") % 3 == 0, True).when(F.col("event_id") % 3 == 1, False))
    return e.withColumns(metrics.attack_flags(F.col("sim"), F.col("verdict")))


JUDGED = """WITH j AS (SELECT event_id, event_type AS family, user_id % 7 AS analysis_doc_id, event_id % 7 AS target_doc_id, value > 20 AS any_poison, user_id % 2 = 0 AS target_retrieved, (event_id % 100) / 100.0::DOUBLE AS sim, CASE event_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS verdict FROM events),
f AS (SELECT *, sim >= 0.65::DOUBLE AS cosine_asr, coalesce(verdict, false) AND sim < 0.65::DOUBLE AS missed, coalesce(NOT verdict, false) AND sim >= 0.65::DOUBLE AS fp, coalesce(verdict, false) AS yes FROM j)
"""


@query("opF9_attack_flags", JUDGED + "SELECT event_id, cosine_asr, missed, fp AS false_positive FROM f")
def opf9(spark, d):
    return judged(Tables(spark, d)).select("event_id", "cosine_asr", "missed", "false_positive")


def _pct(test: str, of: str = "count(*)") -> str:
    return f"coalesce(round(100.0::DOUBLE * count(*) FILTER (WHERE {test}) / nullif({of}, 0), 1), 0)"


_EX, _TG = "count(*) FILTER (WHERE any_poison)", "count(*) FILTER (WHERE target_retrieved)"


def _live(aimed: str) -> str:
    return f"""count(*) AS n, {_pct('any_poison')} AS exposure, {_pct('target_retrieved')} AS target_retrieval, {_pct('yes')} AS verdict_overall, {_pct('yes AND any_poison', _EX)} AS verdict_exposed, {_pct('cosine_asr')} AS cosine_overall,
    {_pct('cosine_asr AND any_poison', _EX)} AS cosine_exposed, {_pct('yes AND ' + aimed, _TG)} AS targeted, {_pct('yes AND any_poison AND NOT target_retrieved')} AS spillover, {_pct('missed')} AS cosine_missed, {_pct('fp')} AS cosine_false_positive"""


@query("op72_live_summary", JUDGED + f"SELECT {_live('target_retrieved')} FROM f")
def op72(spark, d):
    return metrics.live_summary(judged(Tables(spark, d)))


@query("op73_summary_by_model", JUDGED + f"SELECT family, {_live('analysis_doc_id = target_doc_id')} FROM f GROUP BY family")
def op73(spark, d):
    return metrics.live_summary(judged(Tables(spark, d)), ["family"], strict_target=True)


@query("op74_scalar_or_list", "SELECT array_to_string(list_sort(list(DISTINCT event_type)), ',') AS all_values, CASE WHEN count(DISTINCT event_type) = 1 THEN min(event_type) END AS only_value FROM events")
def op74(spark, d):
    return metrics.scalar_or_list(Tables(spark, d).events, "event_type")


@query("op75_histogram", f"WITH {PAIRS_SQL} SELECT shared AS value, count(*) AS n FROM pairs GROUP BY 1")
def op75(spark, d):
    t = Tables(spark, d)
    return metrics.histogram(token_counts(t.questions, t.corpus, 20), "shared")


@query("op76_alignment_stats", f"WITH {PAIRS_SQL} SELECT round(avg(shared), 4) AS mean, CAST(list_sort(list(shared))[len(list(shared)) // 2 + 1] AS DOUBLE) AS median, {_pct('shared >= 25')} AS high_pct FROM pairs")
def op76(spark, d):
    t = Tables(spark, d)
    return metrics.alignment_stats(token_counts(t.questions, t.corpus, 20), "shared", 25)


@query("op77_poison_rate", "SELECT count(*) FILTER (WHERE toxic = 1) AS poisoned, count(*) AS total, round(count(*) FILTER (WHERE toxic = 1) / count(*), 4) AS rate FROM labels")
def op77(spark, d):
    return metrics.poison_rate(Tables(spark, d).labels, F.col("toxic") == 1)


@query("op78_duplicates", "SELECT count(*) AS total, count(DISTINCT text) AS unique_keys, count(*) - count(DISTINCT text) AS duplicates FROM documents")
def op78(spark, d):
    return metrics.duplicates(Tables(spark, d).documents, "text")


def audit(t: Tables) -> DataFrame:
    rules = F.array_compact(F.array(F.when(F.col("value") > 50, "high"), F.when(F.col("user_id") % 5 == 0, "fifth")))
    return t.events.select(F.when(F.size(rules) > 0, "rejected").otherwise("accepted").alias("status"), F.col("event_type").alias("technique"), F.when(F.col("event_id") % 4 == 0, "").otherwise("plain").alias("directive_strategy"), F.lit("blackbox").alias("attacker_setting"), rules.alias("triggered_rules"))


@query(
    "op79_audit_summary",
    """WITH a AS (SELECT *, value > 50 AS hi, user_id % 5 = 0 AS ff FROM events)
    SELECT 'status' AS dimension, v AS value, (SELECT count(*) FROM a WHERE (hi OR ff) = (v = 'rejected')) AS n FROM (SELECT unnest(['accepted', 'rejected']) AS v)
    UNION ALL SELECT 'technique', event_type, count(*) FROM a GROUP BY 2 UNION ALL SELECT 'directive_strategy', 'plain', count(*) FROM a WHERE event_id % 4 <> 0 HAVING count(*) > 0
    UNION ALL SELECT 'attacker_setting', 'blackbox', count(*) FROM a UNION ALL SELECT 'rule', 'high', count(*) FROM a WHERE hi HAVING count(*) > 0 UNION ALL SELECT 'rule', 'fifth', count(*) FROM a WHERE ff HAVING count(*) > 0""",
)
def op79(spark, d):
    return metrics.audit_summary(audit(Tables(spark, d)))


@query("op7A_style_distribution")
def op7a(spark, d):
    from ..functions.text import query_style

    rows = Tables(spark, d).benchmark.select(query_style(F.col("text")).alias("style"))
    return metrics.zero_filled(rows, "style", ["question", "title", "keyword", "other"])


QRELS = f"WITH {PAIRS_SQL}, qrels AS (SELECT query_id, doc_id, CAST(shared - 19 AS BIGINT) AS score FROM pairs) "


def qrels(t: Tables) -> DataFrame:
    """Graded stand-in judgements: shared tokens beyond 19."""
    return token_counts(t.questions, t.corpus, 20).select("query_id", "doc_id", (F.col("shared") - 19).alias("score"))


@query("op7B_relevance_roll_up", QRELS + "SELECT doc_id, CAST(sum(score) AS BIGINT) AS total, max(score) AS best, arg_min(query_id, (-score, query_id)) AS best_query FROM qrels GROUP BY doc_id")
def op7b(spark, d):
    return metrics.relevance_roll_up(qrels(Tables(spark, d)))


@query("op7C_best_rank", f"WITH {BM25_SQL} SELECT doc_id, min(rank) AS best_rank, arg_min(query_id, (rank, query_id)) AS best_query FROM ranked WHERE rank <= {POOL} GROUP BY doc_id")
def op7c(spark, d):
    return metrics.best_rank(bm25(Tables(spark, d), POOL))


# --- ranking -------------------------------------------------------------------------------------


@query("op80_top_k_per_query", QRELS + "SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM qrels QUALIFY rank <= 5")
def op80(spark, d):
    return ranking.top_k(qrels(Tables(spark, d)), 5)


@query("op83_candidates_per_query", QRELS + ", t AS (SELECT unnest(['a', 'b', 'c']) AS technique, unnest([0, 1, 2]) AS priority) SELECT query_id, doc_id, technique, score FROM qrels, t QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, priority, doc_id) <= 16")
def op83(spark, d):
    from pyspark.sql import Window

    from ..operators.joins import techniques_expanded

    dim = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "technique string, priority int")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "priority", "doc_id")
    return techniques_expanded(qrels(Tables(spark, d)), dim).withColumn("r", F.row_number().over(w)).where("r <= 16").select("query_id", "doc_id", "technique", "score")


_ORDER = "ORDER BY {}, query_id, doc_id"


def _by(*cols):
    return [*cols, F.col("query_id"), F.col("doc_id")]


@query("op84_bands_by_count", QRELS + ", r AS (SELECT *, row_number() OVER (ORDER BY score, query_id, doc_id) AS n FROM qrels) SELECT query_id, doc_id, CASE WHEN n <= 28 THEN 'subtle' WHEN n <= 66 THEN 'medium' ELSE 'strong' END AS strength FROM r")
def op84(spark, d):
    return ranking.bands_by_count(qrels(Tables(spark, d)), _by(F.asc("score")), [("subtle", 28), ("medium", 38)], "strong").select("query_id", "doc_id", "strength")


@query("op85_bands_by_share", QRELS + ", r AS (SELECT *, row_number() OVER (ORDER BY score DESC, query_id, doc_id) AS n, count(*) OVER () AS c FROM qrels) SELECT query_id, doc_id, CASE WHEN n <= round_even(c * 0.35::DOUBLE, 0) THEN 'strong' WHEN n <= round_even(c * 0.85::DOUBLE, 0) THEN 'medium' ELSE 'subtle' END AS strength FROM r")
def op85(spark, d):
    return ranking.bands_by_share(qrels(Tables(spark, d)), _by(F.desc("score")), [("strong", 0.35), ("medium", 0.85)], "subtle").select("query_id", "doc_id", "strength")


@query("op86_bands_by_threshold", QRELS + "SELECT query_id, doc_id, CASE WHEN score >= 10 THEN 'subtle' WHEN score >= 7 THEN 'medium' ELSE 'strong' END AS strength FROM qrels")
def op86(spark, d):
    return qrels(Tables(spark, d)).select("query_id", "doc_id", ranking.band_by_threshold(F.col("score"), 10, 7).alias("strength"))


@query("op87_strength_floor", QRELS + "SELECT query_id, doc_id, ['subtle', 'medium', 'strong'][1 + greatest(CASE WHEN score >= 10 THEN 0 WHEN score >= 7 THEN 1 ELSE 2 END, CASE doc_id % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END)] AS strength FROM qrels")
def op87(spark, d):
    tech = F.element_at(F.array(F.lit("near_query_placement"), F.lit("anchor_see_also_hijack"), F.lit("keyword_packing")), (F.col("doc_id") % 3 + 1).cast("int"))
    return qrels(Tables(spark, d)).select("query_id", "doc_id", ranking.at_least(tech, ranking.band_by_threshold(F.col("score"), 10, 7)).alias("strength"))


@query("op88_quota_fill", QRELS + ", r AS (SELECT *, row_number() OVER (ORDER BY score DESC, query_id, doc_id) AS n FROM qrels) SELECT query_id, doc_id, CASE WHEN n <= 12 THEN 'semantic_cloaking' WHEN n <= 24 THEN 'near_query_placement' WHEN n <= 35 THEN 'citation_hijack' END AS technique FROM r")
def op88(spark, d):
    return ranking.by_quota(qrels(Tables(spark, d)), _by(F.desc("score")), [("semantic_cloaking", 12), ("near_query_placement", 12), ("citation_hijack", 11)]).select("query_id", "doc_id", "technique")


@query("op89_round_robin", QRELS + ", r AS (SELECT *, row_number() OVER (ORDER BY score DESC, query_id, doc_id) AS n FROM qrels) SELECT query_id, doc_id, ['a', 'b', 'c'][(n - 1) % 3 + 1] AS technique FROM r")
def op89(spark, d):
    return ranking.round_robin(qrels(Tables(spark, d)), _by(F.desc("score")), ["a", "b", "c"]).select("query_id", "doc_id", "technique")


@query("op8A_fair_shares", "SELECT unnest(['a', 'b', 'c']) AS technique, CAST(count(*) // 3 + (unnest([0, 1, 2]) < count(*) % 3)::INT AS BIGINT) AS target FROM benchmark")
def op8a(spark, d):
    n = Tables(spark, d).benchmark.count()
    return spark.createDataFrame(list(ranking.fair_shares(n, ["a", "b", "c"]).items()), "technique string, target long")


@query("op8C_first_seen", "WITH t AS (SELECT doc_id, lower(trim(text, ' ')) AS k FROM documents) SELECT doc_id, min(doc_id) OVER (PARTITION BY k) AS canonical, doc_id = min(doc_id) OVER (PARTITION BY k) AS first FROM t WHERE k <> ''")
def op8c(spark, d):
    return ranking.first_seen(Tables(spark, d).documents, "text", "doc_id").select("doc_id", "canonical", "first")


@query("op8G_sequential_ids", QRELS + "SELECT query_id, doc_id, 'IPI_' || lpad(CAST(row_number() OVER (ORDER BY score DESC, query_id, doc_id) AS VARCHAR), 4, '0') AS new_id FROM qrels")
def op8g(spark, d):
    return ranking.numbered(qrels(Tables(spark, d)), _by(F.desc("score")), "IPI_").select("query_id", "doc_id", "new_id")


@query("op8E_union_of_candidates", f"WITH {BM25_SQL}, {SPARSE.replace(POSTINGS + ', ', '')} SELECT query_id, doc_id FROM ranked WHERE rank <= {K} UNION SELECT query_id, doc_id FROM spr WHERE rank <= {K}")
def op8e(spark, d):
    t = Tables(spark, d)
    return bm25(t, K).select("query_id", "doc_id").union(sparse(t, K).select("query_id", "doc_id")).distinct()


@query("op8F_set_difference", f"WITH {BM25_SQL}, {SPARSE.replace(POSTINGS + ', ', '')} SELECT query_id, doc_id FROM ranked WHERE rank <= {K} EXCEPT SELECT query_id, doc_id FROM spr WHERE rank <= {K}")
def op8f(spark, d):
    t = Tables(spark, d)
    return bm25(t, K).select("query_id", "doc_id").exceptAll(sparse(t, K).select("query_id", "doc_id"))
