"""Similarity and alignment scores as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import compact, focus_terms, focus_topic, overlap_list, overlap_set, seed_text, whitespace_tokens

# Claim polarity lexicons.
NEGATIVE_TERMS = """not no never without lack lacking absence reduced decreased lower less impair impairs reduce reduces decrease
decreases suppresses prevents worse worsens defect defects inactive ineffective""".split()
POSITIVE_TERMS = """promote promotes increase increases higher improves improve effective positive facilitates induces better
protect protects protective""".split()
COMPARATIVES = "larger smaller higher lower greater less more".split()


def words(values: list[str]) -> Column:
    return F.array(*[F.lit(x) for x in values])


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column, least: float = 1e-12) -> Column:
    n = F.greatest(norm(a), F.lit(least))
    return F.transform(a, lambda x: x.cast("double") / n)


def cosine(a: Column, b: Column) -> Column:
    """0 for an empty vector, -1 for a missing one."""
    empty = (F.size(a) == 0) | (F.size(b) == 0) | (norm(a) == 0) | (norm(b) == 0)
    return F.when(a.isNull() | b.isNull(), F.lit(-1.0)).when(empty, F.lit(0.0)).otherwise(dot(a, b) / (norm(a) * norm(b)))


def overlap_count(query: Column, title: Column, text: Column, first: int) -> Column:
    """Distinct query tokens found in the title or the text's first words."""
    head = F.array_join(F.slice(whitespace_tokens(text), 1, first), " ")
    return F.size(F.array_intersect(overlap_set(query), F.array_union(overlap_set(title), overlap_set(head))))


def overlap_fraction(query: Column, text: Column) -> Column:
    q = overlap_set(query)
    return F.when(F.size(q) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(q, overlap_set(text))) / F.size(q))


def focus_score(query: Column, title: Column, text: Column) -> Column:
    """Focus terms present as substrings, 2 more for the whole topic, 1.5 more if one of the first three is in the title."""
    focus, low = focus_terms(query), F.lower(F.concat_ws(" ", title, text))
    topic = F.lower(focus_topic(query))
    present = F.size(F.filter(focus, lambda t: F.contains(low, t))).cast("double")
    in_title = F.exists(F.slice(focus, 1, 3), lambda t: F.contains(F.lower(title), t))
    return present + F.when((topic != "") & F.contains(low, topic), 2.0).otherwise(0.0) + F.when(in_title, 1.5).otherwise(0.0)


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1))


def conflicting_claims(a: Column, b: Column) -> Column:
    """Whether two claims about the same matter point in opposite directions."""
    ta, tb = overlap_set(a), overlap_set(b)
    neg, pos, comp = words(NEGATIVE_TERMS), words(POSITIVE_TERMS), words(COMPARATIVES)
    core = lambda t: F.array_except(F.array_except(t, neg), pos)
    has = F.array_contains
    alike = jaccard(core(ta), core(tb))
    bare = lambda t: F.array_except(F.array_except(t, comp), words(["than"]))
    flipped = has(ta, "than") & has(tb, "than") & F.arrays_overlap(ta, comp) & F.arrays_overlap(tb, comp) & (F.size(F.array_intersect(bare(ta), bare(tb))) >= 2)
    affects = lambda t: has(t, "affect") | has(t, "affects")
    without = lambda t: (has(t, "not") & affects(t)) | (has(t, "no") & has(t, "effect"))
    withit = lambda t: has(t, "defect") | has(t, "defects") | (affects(t) & ~has(t, "not"))
    effect = (without(ta) & withit(tb)) | (without(tb) & withit(ta))
    na, nb, pa, pb = F.arrays_overlap(ta, neg), F.arrays_overlap(tb, neg), F.arrays_overlap(ta, pos), F.arrays_overlap(tb, pos)
    usable = (F.size(core(ta)) > 0) & (F.size(core(tb)) > 0)
    return usable & (((flipped | effect) & (alike > 0.40)) | ((alike > 0.60) & ((na != nb) | (pa & nb) | (pb & na))))


def lexical_alignment(query: Column, title: Column, text: Column) -> Column:
    """Weighted overlap of query terms with title, seed text and the first 120 words, plus bigram and whole-query hits; 4 digits."""
    q = overlap_list(query)
    uniq = F.array_distinct(q)
    snippet = F.array_join(F.slice(whitespace_tokens(text), 1, 120), " ")
    doc = F.lower(compact(F.concat_ws(" ", title, seed_text(title, text), snippet)))
    d = overlap_list(doc)
    both = F.array_intersect(uniq, d)
    n = F.size(both)
    per_term = F.aggregate(
        both,
        F.lit(0.0),
        lambda s, t: s + F.least(F.size(F.filter(d, lambda x: x == t)), F.lit(3)) * 0.35 + F.when(F.length(t) >= 7, 0.25).otherwise(0.0),
    )
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(q) - 1, F.lit(1))), lambda i: F.when((F.length(F.get(q, i - 1)) > 2) & (F.length(F.get(q, i)) > 2), F.concat_ws(" ", F.get(q, i - 1), F.get(q, i))))
    bigrams = F.size(F.filter(F.array_distinct(F.array_compact(pairs)), lambda p: F.contains(doc, p)))
    whole = F.lower(compact(query))
    score = n * 1.1 + n / F.greatest(F.size(uniq), F.lit(1)) * 8.0 + per_term + bigrams * 1.8 + F.when((whole != "") & F.contains(doc, whole), 3.0).otherwise(0.0)
    return F.when((F.size(uniq) == 0) | (n == 0), F.lit(0.0)).otherwise(F.round(score, 4))


def cue_scores(text: Column, cues: dict[str, list[str]]) -> Column:
    """structs(label, hits) in the order of cues: how many of a label's cue phrases occur."""
    low = F.lower(text)
    return F.array(*[F.struct(F.lit(k).alias("label"), sum((F.contains(low, F.lit(c)).cast("int") for c in v), F.lit(0)).alias("hits")) for k, v in cues.items()])


def best_cue(text: Column, cues: dict[str, list[str]], default: str) -> Column:
    """The label with most hits, of equals the first; default without any hit."""
    scored = cue_scores(text, cues)
    most = F.array_max(F.transform(scored, lambda x: x["hits"]))
    return F.when(most > 0, F.filter(scored, lambda x: x["hits"] == most)[0]["label"]).otherwise(F.lit(default))
