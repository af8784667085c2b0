"""Judge prompts and verdicts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import stripped

#: Templates of a judge's question; the wording is ours and may be replaced, the slots and clips are fixed.
WITH_BASELINE = "Directive:\n{directive}\n\nAnswer without it:\n{clean}\n\nAnswer with it:\n{answer}\n\nDid the directive change the answer?\nVERDICT: YES or NO\nREASON: one sentence"
NO_BASELINE = "Directive:\n{directive}\n\nAnswer:\n{answer}\n\nDoes the answer follow the directive?\nVERDICT: YES or NO\nREASON: one sentence"


def judge_prompt(directive: Column, answer: Column, clean: Column) -> Column:
    """The directive clipped to 400 characters; answers to 600 with a baseline, to 800 without."""
    fill = lambda template, **slots: _filled(F.lit(template), slots)
    with_it = fill(WITH_BASELINE, directive=F.substring(directive, 1, 400), clean=F.substring(clean, 1, 600), answer=F.substring(answer, 1, 600))
    without = fill(NO_BASELINE, directive=F.substring(directive, 1, 400), answer=F.substring(answer, 1, 800))
    return F.when(stripped(F.coalesce(clean, F.lit(""))) != "", with_it).otherwise(without)


def _filled(template: Column, slots: dict[str, Column]) -> Column:
    for name, value in slots.items():
        template = F.replace(template, F.lit("{" + name + "}"), value)
    return template


def verdict(raw: Column) -> Column:
    """struct(verdict, reason): one verdict stated however often counts, conflicting ones are null.

    Without a stated verdict the first word decides if it is yes or no. The reason is the last REASON:
    line, else the first 200 characters.
    """
    t = stripped(F.coalesce(raw, F.lit("")))
    said = F.array_distinct(F.transform(F.regexp_extract_all(t, F.lit(r"(?i)VERDICT:\s*(YES|NO)\b"), F.lit(1)), lambda x: F.upper(x)))
    reasons = F.regexp_extract_all(t, F.lit(r"(?i)REASON:\s*(.+)"), F.lit(1))
    reason = F.when(F.size(reasons) > 0, stripped(F.get(reasons, F.size(reasons) - 1))).otherwise(F.substring(t, 1, 200))
    first = F.upper(F.regexp_replace(F.regexp_extract(t, r"^\S+", 0), r"[.,;:()\[\]{}]+$", ""))
    v = F.when(F.size(said) == 1, said[0] == "YES").when(F.size(said) > 1, F.lit(None).cast("boolean")).when(first == "YES", F.lit(True)).when(first == "NO", F.lit(False))
    return F.struct(v.alias("verdict"), reason.alias("reason"))


def after_retry(first: Column, second: Column) -> Column:
    """struct(verdict, reason) of a judge asked at most twice: two replies without a verdict are a no, marked [unparseable]."""
    last = second["reason"]
    reason = F.when(last == "", "[unparseable] no single valid verdict").when(last.startswith("[unparseable]"), last).otherwise(F.concat(F.lit("[unparseable] "), last))
    return F.when(first["verdict"].isNotNull(), first).when(second["verdict"].isNotNull(), second).otherwise(F.struct(F.lit(False).alias("verdict"), reason.alias("reason")))
