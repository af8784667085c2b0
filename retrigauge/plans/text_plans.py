"""Queries over tokenisers, normalisers, hashing and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import hashing, scoring, text
from .catalog import Tables, query




def digest(tokens: Column) -> Column:
    return F.md5(F.array_join(tokens, " "))


def counted(t: Tables, tokens: Column) -> DataFrame:
    return t.corpus.select("doc_id", tokens.alias("k")).select("doc_id", F.size("k").cast("long").alias("n"), digest(F.col("k")).alias("digest"))


def _sql(tokens: str) -> str:
    return f"SELECT doc_id, CAST(len(k) AS BIGINT) AS n, md5(array_to_string(k, ' ')) AS digest FROM (SELECT doc_id, {tokens} AS k FROM documents)"


WS = "list_filter(regexp_split_to_array({}, '\\s+'), lambda x: x <> '')"
#: Letters beyond ASCII count as word characters here as they do in Spark; RE2 knows ASCII words only.
WORDY = "regexp_replace(regexp_replace({0}, '[^\\x00-\\x7F\\p{{L}}\\p{{N}}]', ' ', 'g'), '[^\\x00-\\x7F]', '_', 'g')"


@query("op30_bm25_tokens", _sql(WS.format("lower(' ' || text)")))
def op30(spark, d):
    return counted(Tables(spark, d), text.bm25_tokens(F.col("title"), F.col("text")))


@query("op31_overlap_set", _sql("list_sort(list_distinct(regexp_extract_all(lower(text), '[A-Za-z0-9]+')))"))
def op31(spark, d):
    return counted(Tables(spark, d), F.array_sort(text.overlap_set(F.col("text"))))


@query("op32_overlap_list", _sql("regexp_extract_all(lower(text), '[A-Za-z0-9]+')"))
def op32(spark, d):
    return counted(Tables(spark, d), text.overlap_list(F.col("text")))


STOP = "[" + ", ".join(f"'{x}'" for x in text.STOPWORDS) + "]"
FOCUS = "(list_filter(list_filter(regexp_extract_all(lower({0}), '[A-Za-z][A-Za-z0-9''-]+'), lambda x: length(x) > 2 AND NOT list_contains(" + STOP + ", x)), lambda x, i: list_position(list_filter(regexp_extract_all(lower({0}), '[A-Za-z][A-Za-z0-9''-]+'), lambda y: length(y) > 2 AND NOT list_contains(" + STOP + ", y)), x) = i)[1:6])"


@query("op33_focus_terms", f"SELECT item_id, array_to_string({FOCUS.format('text')}, ' ') AS focus FROM benchmark")
def op33(spark, d):
    return Tables(spark, d).benchmark.select("item_id", F.array_join(text.focus_terms(F.col("text")), " ").alias("focus"))


@query("op34_hyphen_tokens", _sql("regexp_extract_all(" + WORDY.format("text") + r", '\b[a-zA-Z0-9][a-zA-Z0-9\-]*[a-zA-Z0-9]\b|\b[a-zA-Z0-9]\b')"))
def op34(spark, d):
    return counted(Tables(spark, d), text.hyphen_tokens(F.col("text")))


@query("op35_guard_tokens", _sql("list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{3,}')))"))
def op35(spark, d):
    return counted(Tables(spark, d), F.array_sort(text.guard_tokens(F.col("text"))))


@query("op36_whitespace_tokens", _sql(WS.format("text")))
def op36(spark, d):
    return counted(Tables(spark, d), text.whitespace_tokens(F.col("text")))


@query("op37_compact", "SELECT doc_id, md5(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS digest FROM documents")
def op37(spark, d):
    return Tables(spark, d).corpus.select("doc_id", F.md5(text.compact(F.col("text"))).alias("digest"))


@query("op38_processors", f"SELECT item_id, array_to_string({WS.format('lower(text)')}, ' ') AS query FROM benchmark")
def op38(spark, d):
    return Tables(spark, d).benchmark.select("item_id", text.processed(F.col("text"), ["lowercase", "strip_whitespace"]).alias("query"))


TOK = r"\b[a-zA-Z0-9][a-zA-Z0-9\-]*[a-zA-Z0-9]\b|\b[a-zA-Z0-9]\b"
CAP = "CASE WHEN len(regexp_extract_all(" + WORDY.format("{0}").replace("\\p{", "\\p{{").replace("L}", "L}}").replace("N}", "N}}") + ", '" + TOK + "')) >= {1} THEN {0}[1:length(regexp_extract(" + WORDY.format("{0}").replace("\\p{", "\\p{{").replace("L}", "L}}").replace("N}", "N}}") + ", '^(?s)((?:.*?(?:" + TOK + ")){{{1}}})', 1))] ELSE {0} END"


@query("op39_token_cap", f"SELECT item_id, {CAP.format('text', 12)} AS capped, {CAP.format('text', 30)} AS safe FROM benchmark")
def op39(spark, d):
    return Tables(spark, d).benchmark.select("item_id", text.capped(F.col("text"), 12).alias("capped"), text.safe_capped(F.col("text"), 30).alias("safe"))


STRIP = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
STYLE = (
    "CASE WHEN {s} = '' THEN 'other' WHEN {s} LIKE '%?' OR regexp_matches({s}, '(?i)^(?:" + text.QUESTION_WORDS + r")\b') THEN 'question' "
    "WHEN len({w}) BETWEEN 2 AND 8 AND len(list_filter({w}, lambda y: regexp_matches(y[1:1], '\\p{{Lu}}'))) / len({w}) >= 0.6 THEN 'title' "
    "WHEN len({w}) <= 5 AND {s} = lower({s}) THEN 'keyword' ELSE 'other' END"
)


def style_sql(x: str) -> str:
    s = STRIP.format(x)
    return STYLE.format(s=s, w=WS.format(s))


# Sentences of documents give all styles; benchmark texts alone would give few.
PHRASES = "(SELECT doc_id, unnest(string_split(replace(text, chr(10), '. '), '. ')) AS phrase FROM documents)"


def phrases(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.explode(F.split(F.regexp_replace("text", "\n", ". "), r"\. ")).alias("phrase"))


@query("op3A_query_style", f"SELECT {style_sql('phrase')} AS style, count(*) AS n FROM {PHRASES} GROUP BY 1")
def op3a(spark, d):
    return phrases(Tables(spark, d)).groupBy(text.query_style(F.col("phrase")).alias("style")).agg(F.count(F.lit(1)).alias("n"))


NORM_Q = STRIP.format("regexp_replace(" + STRIP.format("text") + ", '[?.!]+$', '')")
TOK12 = r"\b[a-zA-Z0-9\-]+\b"


@query(
    "op3B_normalised_query",
    f"""WITH q AS (SELECT item_id, {NORM_Q} AS q FROM benchmark), s AS (SELECT item_id, CASE WHEN {style_sql('q')} IN ('title', 'question') THEN lower(q) ELSE q END AS q FROM q)
    SELECT item_id, CASE WHEN len(regexp_extract_all({WORDY.format('q')}, '{TOK12}')) >= 12 THEN q[1:length(regexp_extract({WORDY.format('q')}, '^(?s)((?:.*?(?:{TOK12})){{12}})', 1))] ELSE q END AS query FROM s""",
)
def op3b(spark, d):
    return Tables(spark, d).benchmark.select("item_id", text.normalised_query(F.col("text")).alias("query"))


@query(
    "op3C_normalised_prose",
    f"""WITH p AS (SELECT doc_id, regexp_replace(regexp_replace({STRIP.format('phrase')}, '\\?+$', ''), '\\.+$', '') AS q FROM {PHRASES})
    SELECT doc_id, md5(string_agg(CASE WHEN regexp_matches(q, '\\p{{L}}') AND (q = upper(q) OR NOT regexp_matches(q, '(?:^|[^\\p{{L}}])\\p{{Ll}}|\\p{{L}}\\p{{Lu}}')) THEN lower(q) ELSE q END, '|' ORDER BY q)) AS digest FROM p GROUP BY doc_id""",
)
def op3c(spark, d):
    q = F.regexp_replace(F.regexp_replace(text.stripped(F.col("phrase")), r"\?+$", ""), r"\.+$", "")
    out = phrases(Tables(spark, d)).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(q.alias("q"), text.normalised_prose(F.col("phrase")).alias("p")))).alias("all"))
    return out.select("doc_id", F.md5(F.array_join(F.col("all.p"), "|")).alias("digest"))


@query(
    "op3D_topic_phrase",
    f"""SELECT item_id, CASE WHEN len({FOCUS.format('text')}) > 0 THEN array_to_string(({FOCUS.format('text')})[1:4], ' ') ELSE regexp_replace(text, '[ ?.]+$', '') END AS focus_topic,
    array_to_string(({WS.format('text')})[1:12], ' ') AS title_topic FROM benchmark""",
)
def op3d(spark, d):
    return Tables(spark, d).benchmark.select("item_id", text.focus_topic(F.col("text")).alias("focus_topic"), text.title_topic(F.lit(""), F.col("text")).alias("title_topic"))


LEADS = ["the", "and", "in", "a", "of"]


def _leads(x: str) -> str:
    x = f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"
    for lead in LEADS:
        x = f"regexp_replace({x}, '(?i)^{lead}\\s+', '')"
    return f"regexp_replace({x}, '[\\s?.!,:;]+$', '')"


@query("op3E_focus_phrase", f"SELECT item_id, CASE WHEN {_leads('text')} <> '' THEN {_leads('text')} ELSE 'this topic' END AS focus FROM benchmark")
def op3e(spark, d):
    return Tables(spark, d).benchmark.select("item_id", text.focus_phrase(F.col("text"), F.lit(""), LEADS, "this topic").alias("focus"))


COMPACT = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"
SEED = "(SELECT doc_id, string_split(regexp_replace(" + COMPACT + ", '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))[1] AS f FROM documents)"


@query("op3F_seed_text", f"SELECT doc_id, trim((CASE WHEN len(string_split(f, ' ')) > 28 THEN array_to_string(string_split(f, ' ')[1:28], ' ') ELSE f END)[1:220]) AS seed FROM {SEED}")
def op3f(spark, d):
    return Tables(spark, d).corpus.select("doc_id", text.seed_text(F.col("title"), F.col("text")).alias("seed"))


@query("op3G_without_label", f"SELECT doc_id, CASE WHEN regexp_matches(x, '^[^:]*: ') AND len({WS.format(chr(39).join(['regexp_extract(x, ', '^([^:]*): ', ', 1)']))}) <= 4 THEN regexp_replace(x, '^[^:]*: ', '') ELSE x END AS text FROM (SELECT doc_id, source || ': ' || text AS x FROM documents)")
def op3g(spark, d):
    return Tables(spark, d).documents.select("doc_id", text.without_label(F.concat("source", F.lit(": "), "text")).alias("text"))


RESIDUE = [r"\$\$\$", r"%%%", r"<!--.*?-->"]


@query(
    "op3H_without_residue",
    """SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?is)\\$\\$\\$', '', 'g'), '(?is)%%%', '', 'g'), '(?is)<!--.*?-->', '', 'g'),
    '[ \\t]+', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '\\s+([,.;:!?])', '\\1', 'g'), '^\\s+|\\s+$', '', 'g')) AS digest,
    array_to_string(string_split(regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(text, '```[A-Za-z]*', '', 'g'), '\\s+', ' ', 'g')), '^["''`]+|["''`]+$', '', 'g'), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))[1:2], ' ') AS rewrite FROM documents""",
)
def op3h(spark, d):
    return Tables(spark, d).documents.select("doc_id", F.md5(text.without_residue(F.col("text"), RESIDUE)).alias("digest"), text.sanitised_rewrite(F.col("text")).alias("rewrite"))


@query(
    "op3I_display",
    f"""SELECT doc_id, md5(regexp_replace(array_to_string(list_transform({WS.format('text')}, lambda w: CASE WHEN regexp_matches(w, '^[A-Z]{{5,}}$') THEN w[1:1] || lower(w[2:]) ELSE w END), ' '),
    '(?i)(?:\\s+(?:a|an|and|as|at|by|for|from|in|of|on|or|the|to|with))+$', '')) AS digest FROM documents""",
)
def op3i(spark, d):
    return Tables(spark, d).documents.select("doc_id", F.md5(text.title_case_display(F.col("text"))).alias("digest"))


# --- hashing -------------------------------------------------------------------------------------


@query("opC0_hash_choice", "SELECT doc_id, CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR) || '|v'), 1, 8) AS BIGINT) % 7 AS variant FROM documents")
def opc0(spark, d):
    return Tables(spark, d).documents.select("doc_id", hashing.hash_choice(F.concat(F.col("doc_id").cast("string"), F.lit("|v")), 7).alias("variant"))


@query("opC1_payload_hash", "SELECT doc_id, md5(text) AS payload_hash FROM documents")
def opc1(spark, d):
    return Tables(spark, d).documents.select("doc_id", F.md5("text").alias("payload_hash"))


@query("opC2_stable_seed", "SELECT doc_id, CAST('0x' || substr(sha1(text), 1, 8) AS BIGINT) AS seed FROM documents")
def opc2(spark, d):
    return Tables(spark, d).documents.select("doc_id", hashing.stable_seed(F.col("text")).alias("seed"))


@query(
    "opC3_position_choice",
    """WITH o AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN ['late_mid', 'late'] WHEN 1 THEN ['mid', 'late_mid', 'late'] ELSE ['mid', 'late_mid'] END AS o FROM documents)
    SELECT doc_id, o[1 + CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR) || '|position'), 1, 8) AS BIGINT) % len(o)] AS position FROM o""",
)
def opc3(spark, d):
    strength = F.element_at(F.array(F.lit("strong"), F.lit("medium"), F.lit("subtle")), (F.col("doc_id") % 3 + 1).cast("int"))
    options = hashing.narrowed(F.array(F.lit("mid"), F.lit("late_mid"), F.lit("late")), strength)
    return Tables(spark, d).documents.select("doc_id", hashing.chosen(F.concat(F.col("doc_id").cast("string"), F.lit("|position")), options).alias("position"))


@query("opC4_hash_shuffle", "SELECT item_id, row_number() OVER (ORDER BY md5('slot' || item_id), item_id) <= round(0.3 * count(*) OVER ()) AS obfuscated FROM benchmark")
def opc4(spark, d):
    from ..operators.ranking import share_by_hash

    return share_by_hash(Tables(spark, d).benchmark, "item_id", 0.3, "slot").select("item_id", "obfuscated")


@query("opC5_hash_uniform", "SELECT doc_id, round(CAST('0x' || substr(md5('u' || doc_id), 1, 12) AS BIGINT) / 281474976710656.0::DOUBLE, 12) AS u FROM documents")
def opc5(spark, d):
    return Tables(spark, d).documents.select("doc_id", F.round(hashing.hash_uniform(F.concat(F.lit("u"), F.col("doc_id").cast("string"))), 12).alias("u"))


# --- scores over candidate pairs -----------------------------------------------------------------

#: Every question with the documents that share a rare enough token set with it: pairs by token join.
PAIRS_SQL = """
qt AS (SELECT item_id AS query_id, text AS query, unnest(list_distinct(regexp_extract_all(lower(text), '[A-Za-z0-9]+'))) AS t FROM benchmark),
dt AS (SELECT doc_id, text, unnest(list_distinct(regexp_extract_all(lower(text), '[A-Za-z0-9]+'))) AS t FROM documents),
pairs AS (SELECT query_id, any_value(query) AS query, doc_id, any_value(text) AS text, CAST(count(*) AS BIGINT) AS shared FROM qt JOIN dt USING (t) GROUP BY query_id, doc_id HAVING count(*) >= 20)"""

W80 = "list_distinct(regexp_extract_all(lower(array_to_string((" + WS.format("text") + ")[1:80], ' ')), '[A-Za-z0-9]+'))"
QSET = "list_distinct(regexp_extract_all(lower(query), '[A-Za-z0-9]+'))"


@query("op50_overlap_count", f"WITH {PAIRS_SQL} SELECT query_id, doc_id, CAST(len(list_intersect({QSET}, {W80})) AS BIGINT) AS overlap FROM pairs")
def op50(spark, d):
    from ..operators.joins import token_pairs

    t = Tables(spark, d)
    return token_pairs(t.questions, t.corpus, 20).select("query_id", "doc_id", scoring.overlap_count(F.col("query"), F.col("title"), F.col("text"), 80).cast("long").alias("overlap"))


@query("op51_overlap_fraction", f"WITH {PAIRS_SQL} SELECT query_id, doc_id, round(shared / len({QSET}), 6) AS fraction FROM pairs")
def op51(spark, d):
    from ..operators.joins import token_pairs

    t = Tables(spark, d)
    return token_pairs(t.questions, t.corpus, 20).select("query_id", "doc_id", F.round(scoring.overlap_fraction(F.col("query"), F.col("text")), 6).alias("fraction"))


@query(
    "op52_focus_score",
    f"""WITH {PAIRS_SQL}, f AS (SELECT item_id AS query_id, {FOCUS.format('text')} AS focus, CASE WHEN len({FOCUS.format('text')}) > 0 THEN array_to_string(({FOCUS.format('text')})[1:4], ' ') ELSE regexp_replace(text, '[ ?.]+$', '') END AS topic FROM benchmark)
    SELECT query_id, doc_id, CAST(len(list_filter(focus, lambda x: contains(lower(' ' || text), x))) AS DOUBLE) + CASE WHEN topic <> '' AND contains(lower(' ' || text), lower(topic)) THEN 2.0 ELSE 0.0 END AS score
    FROM pairs JOIN f USING (query_id)""",
)
def op52(spark, d):
    from ..operators.joins import token_pairs

    t = Tables(spark, d)
    return token_pairs(t.questions, t.corpus, 20).select("query_id", "doc_id", scoring.focus_score(F.col("query"), F.col("title"), F.col("text")).alias("score"))


@query(
    "op54_lexical_alignment",
    f"""WITH {PAIRS_SQL},
    sd AS (SELECT doc_id, trim((CASE WHEN len(string_split(f, ' ')) > 28 THEN array_to_string(string_split(f, ' ')[1:28], ' ') ELSE f END)[1:220]) AS seed FROM {SEED}),
    x AS (SELECT query_id, pairs.doc_id, regexp_extract_all(lower(query), '[A-Za-z0-9]+') AS q, lower(trim(regexp_replace(query, '\\s+', ' ', 'g'))) AS whole,
          lower(trim(regexp_replace(' ' || seed || ' ' || array_to_string(({WS.format('text')})[1:120], ' '), '\\s+', ' ', 'g'))) AS doc FROM pairs JOIN sd USING (doc_id)),
    y AS (SELECT *, regexp_extract_all(doc, '[A-Za-z0-9]+') AS dl, list_intersect(list_distinct(q), regexp_extract_all(doc, '[A-Za-z0-9]+')) AS bth FROM x)
    SELECT query_id, doc_id, CASE WHEN len(bth) = 0 THEN 0.0::DOUBLE ELSE round(len(bth) * 1.1::DOUBLE + len(bth) / len(list_distinct(q)) * 8.0::DOUBLE
      + coalesce(list_sum(list_transform(bth, lambda w: least(len(list_filter(dl, lambda z: z = w)), 3) * 0.35::DOUBLE + CASE WHEN length(w) >= 7 THEN 0.25::DOUBLE ELSE 0 END)), 0)
      + len(list_filter(list_distinct(list_filter(list_transform(q, lambda w, i: CASE WHEN i < len(q) AND length(w) > 2 AND length(q[i + 1]) > 2 THEN w || ' ' || q[i + 1] END), lambda w: w IS NOT NULL)), lambda w: contains(doc, w))) * 1.8::DOUBLE
      + CASE WHEN whole <> '' AND contains(doc, whole) THEN 3.0::DOUBLE ELSE 0 END, 4) END AS score FROM y""",
)
def op54(spark, d):
    from ..operators.joins import token_pairs

    t = Tables(spark, d)
    return token_pairs(t.questions, t.corpus, 20).select("query_id", "doc_id", scoring.lexical_alignment(F.col("query"), F.col("title"), F.col("text")).alias("score"))


def _lst(v) -> str:
    return "[" + ", ".join(f"'{x}'" for x in v) + "]"


@query(
    "op53_conflicting_claims",
    f"""WITH c AS (SELECT claim_id, claim, list_distinct(regexp_extract_all(lower(claim), '[A-Za-z0-9]+')) AS t FROM (SELECT unnest([1, 2, 3, 4, 5, 6, 7, 8]) AS claim_id, unnest(['Zinc intake reduces cold duration in adults', 'Zinc intake increases cold duration in adults',
      'Adults with zinc intake have larger cold duration than children', 'Adults with zinc intake have smaller cold duration than children', 'Zinc does not affect cold duration in adults', 'Zinc affects cold duration in adults', 'Folate status is unrelated', 'Protective folate status is better']) AS claim)),
    p AS (SELECT a.claim_id AS a, b.claim_id AS b, a.t AS x, b.t AS y, list_filter(a.t, lambda w: NOT list_contains({_lst(scoring.NEGATIVE_TERMS + scoring.POSITIVE_TERMS)}, w)) AS cx, list_filter(b.t, lambda w: NOT list_contains({_lst(scoring.NEGATIVE_TERMS + scoring.POSITIVE_TERMS)}, w)) AS cy FROM c a JOIN c b ON a.claim_id < b.claim_id),
    j AS (SELECT *, len(list_intersect(cx, cy)) / greatest(len(list_distinct(cx || cy)), 1) AS jac, list_has_any(x, {_lst(scoring.NEGATIVE_TERMS)}) AS nx, list_has_any(y, {_lst(scoring.NEGATIVE_TERMS)}) AS ny, list_has_any(x, {_lst(scoring.POSITIVE_TERMS)}) AS px, list_has_any(y, {_lst(scoring.POSITIVE_TERMS)}) AS py,
      list_filter(x, lambda w: NOT list_contains({_lst([*scoring.COMPARATIVES, 'than'])}, w)) AS bx, list_filter(y, lambda w: NOT list_contains({_lst([*scoring.COMPARATIVES, 'than'])}, w)) AS by_,
      (list_contains(x, 'not') AND list_has_any(x, ['affect', 'affects'])) OR (list_contains(x, 'no') AND list_contains(x, 'effect')) AS wx, (list_contains(y, 'not') AND list_has_any(y, ['affect', 'affects'])) OR (list_contains(y, 'no') AND list_contains(y, 'effect')) AS wy,
      list_has_any(x, ['defect', 'defects']) OR (list_has_any(x, ['affect', 'affects']) AND NOT list_contains(x, 'not')) AS ex, list_has_any(y, ['defect', 'defects']) OR (list_has_any(y, ['affect', 'affects']) AND NOT list_contains(y, 'not')) AS ey FROM p)
    SELECT a, b, len(cx) > 0 AND len(cy) > 0 AND ((jac > 0.40 AND ((list_contains(x, 'than') AND list_contains(y, 'than') AND list_has_any(x, {_lst(scoring.COMPARATIVES)}) AND list_has_any(y, {_lst(scoring.COMPARATIVES)}) AND len(list_intersect(bx, by_)) >= 2) OR (wx AND ey) OR (wy AND ex)))
      OR (jac > 0.60 AND ((nx <> ny) OR (px AND ny) OR (py AND nx)))) AS conflict FROM j""",
)
def op53(spark, d):
    claims = ["Zinc intake reduces cold duration in adults", "Zinc intake increases cold duration in adults", "Adults with zinc intake have larger cold duration than children", "Adults with zinc intake have smaller cold duration than children", "Zinc does not affect cold duration in adults", "Zinc affects cold duration in adults", "Folate status is unrelated", "Protective folate status is better"]
    c = spark.createDataFrame(list(enumerate(claims, 1)), "claim_id int, claim string")
    a, b = c.select(F.col("claim_id").alias("a"), F.col("claim").alias("x")), c.select(F.col("claim_id").alias("b"), F.col("claim").alias("y"))
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", scoring.conflicting_claims(F.col("x"), F.col("y")).alias("conflict"))


#: Cue phrases from the synthetic vocabulary stand in for domain cues.
CUES = {"first": ["tion", "was"], "second": ["der", "und", "ung"], "third": ["eau", "les"], "fourth": ["los", "que"]}
_CUE = {k: " + ".join(f"contains(lower(text), '{c}')::INT" for c in v) for k, v in CUES.items()}


@query(
    "op56_cue_label",
    f"""WITH s AS (SELECT doc_id, {', '.join(f'{v} AS {k}_' for k, v in _CUE.items())} FROM documents), m AS (SELECT *, greatest({', '.join(k + '_' for k in CUES)}) AS most FROM s)
    SELECT doc_id, CASE WHEN most = 0 THEN 'none' {' '.join(f"WHEN {k}_ = most THEN '{k}'" for k in CUES)} END AS label FROM m""",
)
def op56(spark, d):
    return Tables(spark, d).documents.select("doc_id", scoring.best_cue(F.col("text"), CUES, "none").alias("label"))
