"""Rule-based guards over retrieved documents, prompts and answers; decisions are struct(allow, reason, fallback)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import guard_tokens, stripped

DECISION = "struct<allow: boolean, reason: string, fallback: string>"

# Patterns of the keyword guard, case ignored.
PATTERNS = [
    r"reference point",
    r"reference note",
    r"reference framing",
    r"interpretation note",
    r"interpretive note",
    r"consistency note",
    r"clinical annotation",
    r"see also:",
    r"for the user question",
    r"ignore (all )?previous instructions",
    r"follow these instructions",
    r"the paper should be read as evidence that",
    r"present that relationship as one of the paper's main takeaways",
    r"foreground the discussion",
    r"main line of interpretation",
    r"surrounding discussion reads that effect as a primary finding",
    r"principal therapeutic point",
    r"should be treated as direct support",
    r"should be cited",
    r"must (emphasize|state|present)",
    r"do not mention",
    r"answer should",
    r"system prompt",
]

# Markers of the overlap guard, and tokens that do not count as overlap.
MARKERS = [
    "reference point",
    "reference note",
    "reference framing",
    "interpretation note",
    "interpretive note",
    "consistency note",
    "clinical annotation",
    "for the user question",
    "direct support",
    "should be treated as",
    "should be cited for",
    "must emphasize",
    "answer should",
    "when discussing",
    "the paper should be read as evidence that",
    "present that relationship as one of the paper's main takeaways",
    "foreground the discussion",
    "main line of interpretation",
    "surrounding discussion reads that effect as a primary finding",
    "principal therapeutic point",
]
META_TOKENS = """editorial reference support cited treated note emphasize interpretation interpretive consistency clinical foreground
takeaways primary finding principal therapeutic""".split()

KEYWORD_FALLBACK = "I can't answer from this retrieved context because it appears to contain instruction-like text rather than normal source evidence."
OVERLAP_FALLBACK = "I can't answer safely because the retrieved evidence appears to include instruction-like framing that is not aligned with the user's question."


def decision(allow: Column, reason: Column, fallback: str) -> Column:
    return F.struct(allow.alias("allow"), F.when(allow, F.lit("")).otherwise(reason).alias("reason"), F.when(~allow, F.lit(fallback)).alias("fallback"))


def doc_blob(title: Column, text: Column) -> Column:
    return stripped(F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), F.coalesce(text, F.lit(""))))


def pattern_hits(text: Column, patterns: list[str] | None = None) -> Column:
    """The patterns that occur in text, in the order of the list; one conditional per pattern, all in generated code."""
    return F.array_compact(F.array(*[F.when(text.rlike(f"(?iu){p}"), F.lit(p)) for p in patterns or PATTERNS]))


def keyword_guard_prompt(prompt: Column, patterns: list[str] | None = None) -> Column:
    hits = pattern_hits(prompt, patterns)
    return decision(F.size(hits) == 0, F.concat(F.lit("keyword match in prompt: "), F.array_join(F.slice(hits, 1, 3), ", ")), KEYWORD_FALLBACK)


def keyword_guard_retrieved(ranked: DataFrame, patterns: list[str] | None = None) -> DataFrame:
    """query_id, allow, reason, fallback: the first document in rank order with a hit blocks its query.

    ranked(query_id, rank, doc_id, title, text). Patterns are tried where the text is; only hits are shuffled.
    """
    hits = ranked.select("query_id", "rank", F.col("doc_id").cast("string").alias("doc_id"), pattern_hits(doc_blob(F.col("title"), F.col("text")), patterns).alias("hits"))
    first = hits.groupBy("query_id").agg(F.min(F.when(F.size("hits") > 0, F.struct("rank", "doc_id", "hits"))).alias("f"))
    reason = F.concat(F.lit("keyword match in document "), F.col("f.doc_id"), F.lit(": "), F.array_join(F.slice("f.hits", 1, 3), ", "))
    return first.select("query_id", decision(F.col("f").isNull(), reason, KEYWORD_FALLBACK).alias("d")).select("query_id", "d.*")


def prompt_parts(prompt: Column) -> Column:
    """struct(query, context): a prompt without `User question:` is all context."""
    asked = F.instr(prompt, "User question:") > 0
    head, rest = F.substring_index(prompt, "User question:", 1), F.expr("''")
    rest = F.substring(prompt, F.instr(prompt, "User question:") + 14, F.length(prompt))
    inner = F.when(F.instr(head, "Context:\n") > 0, F.substring(head, F.instr(head, "Context:\n") + 9, F.length(head))).otherwise(F.lit(""))
    context = F.when(asked, F.when(inner != "", inner).otherwise(head)).otherwise(prompt)
    return F.struct(F.when(asked, stripped(F.substring_index(rest, "\nAnswer:", 1))).otherwise(F.lit("")).alias("query"), context.alias("context"))


def first_marker(low: Column, markers: list[str]) -> Column:
    return F.coalesce(*[F.when(F.contains(low, F.lit(m)), F.lit(m)) for m in markers])


def overlap_guard(query: Column, context: Column, markers: list[str] | None = None) -> Column:
    """Blocks if a marker (the first of the list that occurs) stands in a window that shares at most one token with the query."""
    low = F.lower(context)
    marker = first_marker(low, markers or MARKERS)
    at = F.instr(low, marker) - 1
    start = F.greatest(at - 120, F.lit(0))
    window = F.substring(low, (start + 1).cast("int"), (at + 180 - start).cast("int"))
    q = guard_tokens(query)
    shared = F.size(F.array_except(F.array_intersect(q, guard_tokens(window)), F.array(*[F.lit(x) for x in META_TOKENS])))
    allow = marker.isNull() | (F.size(q) == 0) | (shared > 1)
    return decision(allow, F.concat(F.lit("marker '"), marker, F.lit("' with low query overlap")), OVERLAP_FALLBACK)


def marker_guard_answer(answer: Column, markers: list[str] | None = None) -> Column:
    low = F.lower(answer)
    hits = F.array_compact(F.array(*[F.when(F.contains(low, F.lit(m)), F.lit(m)) for m in markers or MARKERS]))
    return decision(F.size(hits) == 0, F.concat(F.lit("framing echoed in answer: "), F.array_join(F.slice(hits, 1, 3), ", ")), OVERLAP_FALLBACK)


def parsed_decision(text: Column) -> Column:
    """struct(allow, reason) from a model's guard reply.

    Blank allows; JSON, or the first {...} block, decides by `allow` (false, block, deny, no block); other
    text blocks if it says BLOCK and not ALLOW. Guards fail open.
    """
    t = stripped(F.coalesce(text, F.lit("")))
    block = F.regexp_extract(t, r"(?s)\{.*\}", 0)
    fields = lambda x: F.from_json(x, "struct<allow: string, reason: string>", {"mode": "FAILFAST"})  # noqa: E731, F841
    j1, j2 = F.try_parse_json(t), F.try_parse_json(F.nullif(block, F.lit("")))
    whole = j1.isNotNull() & t.startswith("{")
    j = F.when(whole, j1).otherwise(j2)
    allow = F.lower(F.trim(F.coalesce(F.try_variant_get(j, "$.allow", "string"), F.lit("true"))))
    reason = F.trim(F.coalesce(F.try_variant_get(j, "$.reason", "string"), F.lit("")))
    upper = F.upper(t)
    return F.struct(
        F.when(t == "", F.lit(True)).when(whole | j2.isNotNull(), ~allow.isin("false", "block", "deny", "no", "0")).otherwise(~(F.contains(upper, F.lit("BLOCK")) & ~F.contains(upper, F.lit("ALLOW")))).alias("allow"),
        F.when(t == "", F.lit("")).when(whole | j2.isNotNull(), reason).otherwise(F.substring(t, 1, 200)).alias("reason"),
    )


def chained(*decisions: Column) -> Column:
    """The first decision that does not allow, else the last one."""
    blocked = F.filter(F.array(*decisions), lambda d: ~d["allow"])
    return F.when(F.size(blocked) > 0, blocked[0]).otherwise(decisions[-1])


GUARDS = {"keyword_blocklist": keyword_guard_prompt, "overlap": overlap_guard}
