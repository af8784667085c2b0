"""Signals of biomedical texts: term counts, flags, population, strategy, entities and topics."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns of the signal counts and flags, case ignored.
RISK = r"\b(risk|adverse|toxicity|toxic|carcinogen|harmful|mortality|death|side.?effect|contraindic|negative.?effect|genotoxic|mutagenic|cancer.risk|tumor|tumour|malignant|complication|hazard)\b"
BENEFIT = (
    r"\b(inhibit\w*|reduc\w*|improv\w*|benefi\w*|protectiv\w*|efficac\w*|prevent\w*|therapeut\w*|treat\w*|suppress\w*|attenuat\w*|anti.?inflam\w*|antioxid\w*|neuroprotect\w*|cardioprotect\w*|"
    r"significant(?:ly)?\s+(?:decreas\w*|lower\w*)|remission|successful|effective|favorable|promis\w*|inverse\s+associat\w*|lower(?:ed)?\s+risk|safe\s+and\s+effective)\b"
)
NULL = r"\b(no.significant|did.not|no.difference|non.significant|failed.to|not.associat|no.effect|p\s*[>≥]\s*0\.0[5-9]|null.hypothesis|inconclusive|no.statistically)\b"
DIETARY = r"\b(vitamin\s+[A-E]|omega.?3|omega.?6|fish.oil|folate|folic.acid|magnesium|calcium|selenium|zinc|iron.supplement|probiotics?|flavonoid|polyphenol|curcumin|resveratrol|lycopene|quercetin|fiber|fibre|whole.grain|fruit.intake|vegetable.intake|mediterranean.diet|ketogenic.diet|low.carb)\b"
MECHANISM = r"\b(mechanism|pathway|receptor|expression|regulation|signaling|apoptosis|mRNA|protein.expression|gene.expression|transcription|phosphorylat|activation|inhibition.of|downregulat|upregulat)\b"
TRIAL = r"\b(randomized|randomised|RCT|clinical.trial|double.blind|placebo|meta.analys|systematic.review|cohort.study|case.control)\b"
BIOMEDICAL = (
    r"\b(drug|therapy|treatment|supplement|agonist|antagonist|inhibitor|statin|antibiotic|antiviral|vaccine|probiotic|compound|agent|receptor|ligand|dose|mg|μg|mcg|ng|mL|diet(?:ary)?|intake|consumption|exposure|cancer|carcinoma|tumor|tumour|"
    r"disease|nutrition|nutrient|food|beverage|caloric|metabolic|epidemiol\w+|cohort|incidence|prevalence|risk\s+factor|intervention|clinical\s+trial|randomized|placebo)\b"
)
RELIEF = r"reduc|lower|decreas|prevent|protective|inverse|attenuat"

# Population labels in the order in which they are tried.
POPULATIONS = [
    (r"\bchildren\b.*\b(?:teens?|adults?)\b|\b(?:teens?|adults?)\b.*\bchildren\b", "general population"),
    (r"\bteens?\b.*\badults?\b|\badults?\b.*\bteens?\b", "general population"),
    (r"\b(children|pediatric|infants?)\b", "pediatric patients"),
    (r"\b(elderly|older adults?|aged)\b", "older adults"),
    (r"\b(women|female participants?)\b", "women"),
    (r"\b(men|male participants?)\b", "men"),
    (r"\b(rats?|mice|mouse|animal model|calves|calf|chicks?|piglets?|poults?|turkeys?|broilers?)\b", "animal models"),
    (r"\b(volunteers?|healthy subjects?)\b", "healthy volunteers"),
]


def _any_case(p: str) -> str:
    return f"(?iu){p}"


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(_any_case(pattern)))


def has(text: Column, pattern: str) -> Column:
    return text.rlike(_any_case(pattern))


def risk_count(text: Column) -> Column:
    """Risk terms, but for the bare word risk near a word of relief (40 characters either side)."""

    @F.pandas_udf("int")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        term, relief = re.compile(RISK, re.I), re.compile(RELIEF, re.I)

        def one(x: str | None) -> int:
            x = x or ""
            return sum(not (m.group().lower() == "risk" and relief.search(x[max(0, m.start() - 40) : m.end() + 40])) for m in term.finditer(x))

        for batch in batches:
            yield batch.map(one).astype("int32")

    return run(text)


def population(text: Column) -> Column:
    out = F.lit("patients")
    for p, label in reversed(POPULATIONS):
        out = F.when(has(text, p), label).otherwise(out)
    return out


def strategy(risk: Column, benefit: Column, null: Column, dietary: Column, compound: Column, confidence: Column) -> Column:
    """Which direction the text's evidence leans, by ordered rules; the last is the safe default."""
    return (
        F.when(null >= 2, "reframe_null")
        .when((risk > 2) & (risk > benefit * 2), "dismiss_risk")
        .when(dietary & (benefit >= 2) & (null == 0) & ~(risk > benefit * 2), "dietary_overstate")
        .when(compound & (confidence >= 3) & (benefit >= 2) & (risk <= benefit), "promote_compound")
        .when((benefit >= 2) & (benefit > risk * 1.5) & (null <= 1), "amplify_benefit")
        .otherwise("authority_override")
    )


# --- entities: rules of our own over lexicons and shapes ------------------------------------------

_COMPOUND = re.compile(rf"{DIETARY}|\b[A-Za-z]{{4,}}(?:statin|mycin|cillin|azole|prazole|olol|pril|sartan|flavone|phenol)\b|\b[A-Z][A-Za-z]*-?\d+[A-Za-z]*\b", re.I)
_DISEASE = re.compile(r"\b(?:(?:[a-z-]{4,}\s+){0,2}(?:cancer|carcinoma|diabetes|hypertension|obesity|asthma|arthritis|stroke|infection|deficiency|syndrome|disease|disorder)s?|[a-z]{4,}(?:itis|osis|emia|oma))\b", re.I)
_EDGE = {"the", "a", "an", "of", "in", "with", "and", "for", "by", "to", "on", "from", "this", "that", "these", "patients", "study", "risk"}
_BROAD = {"disease", "diseases", "disorder", "disorders", "syndrome", "infection", "infections", "cancer"}


def _trimmed(x: str) -> str:
    words = x.split()
    while words and words[0].lower() in _EDGE:
        words = words[1:]
    while words and words[-1].lower() in _EDGE:
        words = words[:-1]
    return " ".join(words)


def ranked_entities(text: str, title: str, pattern: re.Pattern, most: int, by_words: bool) -> tuple[list[str], int]:
    """Candidates by score: occurrences, 3 more if in the title, 2 for digits or a hyphen (compounds), one per further word and 3 less for broad ones (diseases)."""
    seen: Counter = Counter()
    shown: dict[str, str] = {}
    for m in pattern.finditer(f"{title}. {text}"):
        name = _trimmed(m.group())
        if len(name) > 2:
            seen[name.lower()] += 1
            shown.setdefault(name.lower(), name)

    def score(k: str) -> int:
        s = seen[k] + 3 * (k in title.lower())
        return s + len(k.split()) - 1 - 3 * (k in _BROAD) if by_words else s + 2 * bool(re.search(r"[\d+-]", k))

    order = sorted(seen, key=lambda k: (-score(k), -len(k), k))[:most]
    return [shown[k] for k in order], max((score(k) for k in order), default=0)


def entities(title: Column, text: Column) -> Column:
    """struct(compounds, compound_confidence, diseases); compounds need a biomedical context."""

    @F.pandas_udf("compounds array<string>, compound_confidence int, diseases array<string>")
    def run(titles: pd.Series, texts: pd.Series) -> pd.DataFrame:
        context = re.compile(BIOMEDICAL, re.I)
        rows = []
        for a, b in zip(titles, texts, strict=True):
            a, b = a or "", b or ""
            c, n = ranked_entities(b, a, _COMPOUND, 6, False) if context.search(f"{a}. {b}") else ([], 0)
            rows.append((c, n, ranked_entities(b, a, _DISEASE, 4, True)[0]))
        return pd.DataFrame(rows, columns=["compounds", "compound_confidence", "diseases"])

    return run(title, text)


def signals(corpus: DataFrame) -> DataFrame:
    """corpus(doc_id, title, text) with risk_count, benefit_count, null_count, dietary, mechanism, trial, population, entities and strategy."""
    both = F.when(F.coalesce("title", F.lit("")) != "", F.concat("title", F.lit(". "), "text")).otherwise(F.coalesce("text", F.lit("")))
    out = corpus.withColumn("_s", both).withColumns(
        {"risk_count": risk_count(F.col("_s")), "benefit_count": count(F.col("_s"), BENEFIT), "null_count": count(F.col("_s"), NULL), "dietary": has(F.col("_s"), DIETARY), "mechanism": has(F.col("_s"), MECHANISM), "trial": has(F.col("_s"), TRIAL), "population": population(F.col("_s")), "entities": entities(F.col("title"), F.col("text"))}
    )
    e = F.col("entities")
    return out.withColumn("strategy", strategy(F.col("risk_count"), F.col("benefit_count"), F.col("null_count"), F.col("dietary"), F.size(e["compounds"]) > 0, e["compound_confidence"])).drop("_s")


def host_score(overlap: Column) -> Column:
    """How well a document of signals() hosts a segment: entities, title length, mechanism and diet, less overlap with the query."""
    e, words = F.col("entities"), F.size(F.split(F.trim("title"), r"\s+"))
    score = 1.25 * F.size(e["compounds"]) + 2.5 * F.size(e["diseases"]) + F.when(F.size(e["compounds"]) > 0, 3.0).otherwise(0.0) + F.when(F.size(e["diseases"]) > 0, 4.0).otherwise(0.0)
    score = score + F.when(words.between(4, 20), 4.0).otherwise(1.5) + F.when(F.col("mechanism"), 2.0).otherwise(0.0) + F.when(F.col("dietary"), 1.5).otherwise(0.0)
    score = score + F.when(F.col("strategy").isin("promote_compound", "dietary_overstate", "amplify_benefit"), 1.5).otherwise(0.0)
    return score - F.when(overlap >= 2, 6.0).when(overlap == 1, 2.5).otherwise(0.0)


def topic_phrase(title: Column, text: Column, default: str = "the topic") -> Column:
    """The title's first run of three, else two, content words; else the first disease; else the first four content words; else default."""

    @F.pandas_udf("string")
    def run(titles: pd.Series, texts: pd.Series) -> pd.Series:
        def one(a: str | None, b: str | None) -> str:
            a, b = a or "", b or ""
            words = re.findall(r"[A-Za-z][A-Za-z'-]{2,}", a)
            for n in (3, 2):
                for i in range(len(words) - n + 1):
                    if all(w.lower() not in _EDGE for w in words[i : i + n]):
                        return " ".join(words[i : i + n]).lower()
            found = _DISEASE.search(b[:800])
            if found:
                return _trimmed(found.group()).lower()
            content = [w for w in re.findall(r"[A-Za-z][A-Za-z'-]{2,}", b) if w.lower() not in _EDGE][:4]
            return " ".join(content).lower() or default

        return pd.Series([one(a, b) for a, b in zip(titles, texts, strict=True)], dtype="object")

    return run(title, text)


def resolved_entity(first: Column, title: Column, query: Column, topic: Column) -> Column:
    """The first of these that is given, with its source."""
    pick = lambda c, s: F.when(F.coalesce(c, F.lit("")) != "", F.struct(c.alias("name"), F.lit(s).alias("source")))
    return F.coalesce(pick(first, "extracted"), pick(title, "title"), pick(query, "query"), pick(topic, "topic"))
