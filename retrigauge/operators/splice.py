"""Placing a marked segment in a text with exact character offsets (from 0, half open, in code points)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import jitter
from ..functions.text import stripped

# Share of the text at which a named position lies, in two families of corpora.
RATIOS = {"start": 0.02, "early": 0.12, "early_mid": 0.26, "mid": 0.48, "late_mid": 0.68, "near_end": 0.82, "end": 0.98}
RATIOS_WEB = {"start": 0.03, "early": 0.14, "early_mid": 0.28, "mid": 0.48, "late": 0.72, "late_mid": 0.68, "near_end": 0.84, "end": 0.97}

# Generic carriers as (technique, family, position, boundary).
CARRIERS = [
    ("keyword_packing", "query_plus", "end", "none"),
    ("semantic_cloaking", "asc", "half", "word"),
    ("prompt_attack_template", "pat", "random", "sentence"),
    ("citation_hijack", "citation", "end", "none"),
    ("html_hidden_comment", "meta_dom", "half", "word"),
    ("json_ld_meta_injection", "meta_dom", "start", "none"),
    ("code_comment_smuggling", "code", "half", "word"),
    ("table_caption_directive", "table", "two_thirds", "sentence"),
    ("unicode_stealth", "unicode", "random", "word"),
    ("near_query_placement", "near_query", "half", "sentence"),
    ("anchor_see_also_hijack", "anchor", "end", "none"),
    ("visual_ocr_injection", "visual_ocr", "three_quarters", "sentence"),
    ("idem_optimized", "idem", "quarter", "sentence"),
]

WORD_CHAR = r"[\p{L}\p{N}]"


def cut(text: Column, start, end=None) -> Column:
    """text[start:end] as Python counts."""
    start = start if isinstance(start, Column) else F.lit(start)
    n = F.char_length(text) if end is None else end if isinstance(end, Column) else F.lit(end)
    return F.substring(text, (start + 1).cast("int"), F.greatest(n - start, F.lit(0)).cast("int"))


def inserted(text: Column, at: Column, segment: Column, payload: Column) -> Column:
    """struct(text, span_start, span_end): segment put in at `at`; the span is the payload's place (-1 if it is not in the segment)."""
    start = F.when(F.instr(segment, payload) > 0, at + F.instr(segment, payload) - 1).otherwise(F.lit(-1))
    end = F.when(start >= 0, start + F.char_length(payload)).otherwise(F.lit(-1))
    return F.struct(F.concat(cut(text, F.lit(0), at), segment, cut(text, at)).alias("text"), start.cast("int").alias("span_start"), end.cast("int").alias("span_end"))


def word_boundary(text: Column, at: Column) -> Column:
    """at, moved left to the start of the word it would split."""
    inside = cut(text, at, at + 1).rlike(WORD_CHAR)
    tail = F.regexp_extract(cut(text, F.lit(0), at), r"[\p{L}\p{N}]*\z", 0)
    return F.when(inside, at - F.char_length(tail)).otherwise(at)


def sentence_boundary(text: Column, at: Column, reach: int = 400) -> Column:
    """Behind the nearest sentence end right of at, else left of it, within reach; else a word boundary."""
    end = r"[.!?][\s]"
    right = F.regexp_instr(cut(text, at, at + reach), F.lit(end))
    left_text = cut(text, F.greatest(at - reach, F.lit(0)), at)
    left = F.regexp_extract(left_text, rf"(?s)^(.*{end})", 1)
    return F.when(right > 0, at + right + 1).when(left != "", F.greatest(at - reach, F.lit(0)) + F.char_length(left)).otherwise(word_boundary(text, at)).cast("int")


def sentence_breaks(text: Column) -> Column:
    """Offsets right behind the white space that follows a sentence end, ascending."""
    parts = F.split(F.regexp_replace(text, r"([.!?]\s+)", "$1\u0001"), "\u0001")
    run = F.aggregate(parts, F.array(F.lit(0)), lambda acc, p: F.concat(acc, F.array(F.element_at(acc, -1) + F.char_length(p))))
    inner = F.slice(run, 2, F.greatest(F.size(run) - 2, F.lit(0)))
    ends = parts[F.size(parts) - 1] == ""
    return F.when(ends & (F.size(parts) > 1), inner).otherwise(inner)


def nearest_break(text: Column, target: Column, fallback: str = "space") -> Column:
    """The sentence break nearest to target (of equals the first); without any the nearest white space (space) or target itself."""
    near = lambda points: F.array_min(F.transform(points, lambda p: F.struct(F.abs(p - target).alias("far"), p.alias("at"))))["at"]
    breaks = sentence_breaks(text)
    if fallback == "space":
        parts = F.split(F.regexp_replace(text, r"(\s+)", "\u0001$1"), "\u0001")
        run = F.aggregate(parts, F.array(F.lit(0)), lambda acc, p: F.concat(acc, F.array(F.element_at(acc, -1) + F.char_length(p))))
        spaces = F.slice(run, 2, F.greatest(F.size(run) - 2, F.lit(0)))
        other = F.when(F.size(spaces) > 0, near(spaces)).otherwise(target)
    else:
        other = target
    return F.when(F.size(breaks) > 0, near(breaks)).otherwise(other)


def target_offset(text: Column, position: Column, seed: Column, ratios: dict[str, float] = RATIOS, default: float = 0.5) -> Column:
    """int(length * ratio of the position), jittered by a hash of the seed and kept within 3 to 95 percent."""
    ratio = F.lit(default)
    for name, r in ratios.items():
        ratio = F.when(position == name, F.lit(r)).otherwise(ratio)
    ratio = F.least(F.lit(0.95), F.greatest(F.lit(0.03), ratio + jitter(F.concat(seed, F.lit("|insert")))))
    return F.floor(F.char_length(text) * ratio).cast("int")


def insertion_offset(text: Column, position: Column, seed: Column, ratios: dict[str, float] = RATIOS, default: float = 0.5, fallback: str = "space") -> Column:
    return nearest_break(text, target_offset(text, position, seed, ratios, default), fallback)


def _right_stripped(x: Column) -> Column:
    return F.regexp_replace(x, r"\s+$", "")


def _left_stripped(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+", "")


def as_paragraph(text: Column, at: Column, bridge: Column, payload: Column) -> Column:
    """struct(text, span_start, span_end): bridge and payload as a paragraph of their own at `at`; the span is the payload's."""
    segment = F.concat(bridge, payload)
    left, right = _right_stripped(cut(text, F.lit(0), at)), _left_stripped(cut(text, at))
    first, last = at <= 0, at >= F.char_length(text)
    whole = _right_stripped(text)
    gap = F.when(whole != "", F.lit("\n\n")).otherwise(F.lit(""))
    merged = F.when(first, F.concat(segment, F.lit("\n\n"), _left_stripped(text))).when(last, F.concat(whole, gap, segment)).otherwise(F.concat(left, F.lit("\n\n"), segment, F.lit("\n\n"), right))
    ahead = F.when(first, F.lit(0)).when(last, F.char_length(whole) + F.char_length(gap)).otherwise(F.char_length(left) + 2)
    start = ahead + F.char_length(bridge)
    return F.struct(merged.alias("text"), start.cast("int").alias("span_start"), (start + F.char_length(payload)).cast("int").alias("span_end"))


def spliced(text: Column, start: Column, end: Column, payload: Column) -> Column:
    """[start, end) replaced by payload, with a blank where a neighbour is no white space."""
    before, after = cut(text, F.lit(0), start), cut(text, end)
    a = F.when(before.rlike(r"\S\z"), F.lit(" ")).otherwise(F.lit(""))
    b = F.when(after.rlike(r"^\S"), F.lit(" ")).otherwise(F.lit(""))
    return F.concat(before, a, payload, b, after)


def appended(text: Column, segment: Column) -> Column:
    """struct(text, span_start, span_end): segment as last paragraph, its span by the last occurrence (-1 if missing)."""
    merged = F.concat(stripped(text), F.lit("\n\n"), segment)
    back = F.instr(F.reverse(merged), F.reverse(segment))
    start = F.when(back > 0, F.char_length(merged) - back + 1 - F.char_length(segment)).otherwise(F.lit(-1))
    return F.struct(merged.alias("text"), start.cast("int").alias("span_start"), F.when(start >= 0, start + F.char_length(segment)).otherwise(F.lit(-1)).cast("int").alias("span_end"))


def span_text(text: Column, start: Column, end: Column) -> Column:
    return F.when((text != "") & (end > start), cut(text, start, end)).otherwise(F.lit(""))


def carrier_offset(text: Column, position: Column, boundary: Column, seed: Column) -> Column:
    """Where a generic carrier goes: a share of the length, then its boundary rule."""
    from ..functions.hashing import hash_choice

    n = F.char_length(text)
    share = F.when(position == "start", 0.0).when(position == "quarter", 0.25).when(position == "half", 0.5).when(position == "two_thirds", 2.0 / 3.0).when(position == "three_quarters", 0.75)
    share = share.when(position == "random", (hash_choice(F.concat(seed, F.lit("|place")), 3) + 1) / 4.0).otherwise(1.0)
    at = F.floor(n * share).cast("int")
    return F.when(boundary == "sentence", F.least(sentence_boundary(text, at), n)).when(boundary == "word", word_boundary(text, at)).otherwise(at)


def rendered(pattern: Column, **slots: Column) -> Column:
    """A template with its {slots} filled."""
    for name, value in slots.items():
        pattern = F.replace(pattern, F.lit("{" + name + "}"), value)
    return pattern


def mapped_letters(text: Column, source: str, target: str, every: int = 3, at: int = 1) -> Column:
    """Letters of `source` replaced by those of `target` at every third occurrence (occurrences counted from 0)."""
    chars = F.split(text, "")
    eligible = lambda c: F.contains(F.lit(source), c) & (c != "")
    out = F.aggregate(
        chars,
        F.struct(F.lit("").alias("s"), F.lit(0).alias("n")),
        lambda acc, c: F.struct(F.concat(acc["s"], F.when(eligible(c) & (F.pmod(acc["n"], F.lit(every)) == at), F.translate(c, source, target)).otherwise(c)).alias("s"), (acc["n"] + eligible(c).cast("int")).alias("n")),
    )
    return out["s"]


def mixed_script_tokens(text: Column) -> Column:
    """How many words mix Latin with Cyrillic or Greek letters: the detector for mapped letters."""
    return F.regexp_count(text, F.lit(r"(?:\p{IsLatin}\p{M}*(?=[\p{IsCyrillic}\p{IsGreek}])|[\p{IsCyrillic}\p{IsGreek}]\p{M}*(?=\p{IsLatin}))"))


def carriers(spark) -> DataFrame:
    return spark.createDataFrame(CARRIERS, "technique string, attack_family string, position string, boundary string")
