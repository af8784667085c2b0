"""Ranking, banding, quotas and first-seen rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(scored: DataFrame, k: int, by: str = "score", group: str | list[str] = "query_id", tie: str = "doc_id") -> DataFrame:
    """The k best rows of each group with `rank`; filtering on row_number lets Spark limit groups before the shuffle."""
    w = Window.partitionBy(group).orderBy(F.desc(by), tie)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def share_by_hash(df: DataFrame, key: str, share: float, seed: str) -> DataFrame:
    """df with `obfuscated` true for round(share * n) rows, those of least md5(seed + key).

    The border is read from the n-th smallest hash, so only hashes are ordered.
    """
    h = F.md5(F.concat(F.lit(seed), F.col(key).cast("string")))
    n = F.round(F.lit(share) * F.count(F.lit(1)).over(Window.partitionBy()))
    return df.withColumn("obfuscated", F.row_number().over(Window.orderBy(h, key)) <= n)


def bands_by_count(df: DataFrame, order: list[Column], cuts: list[tuple[str, int]], rest: str) -> DataFrame:
    """df with `strength`: the first cuts[0][1] rows in order get its name, and so on; the others get rest."""
    rn = F.row_number().over(Window.orderBy(*order))
    band, upto = None, 0
    for name, n in cuts:
        upto += n
        band = F.when(F.col("_rn") <= upto, name) if band is None else band.when(F.col("_rn") <= upto, name)
    return df.withColumn("_rn", rn).withColumn("strength", band.otherwise(rest)).drop("_rn")


def bands_by_share(df: DataFrame, order: list[Column], cuts: list[tuple[str, float]], rest: str) -> DataFrame:
    """As bands_by_count with cumulative shares of all rows, rounded half to even."""
    rn, n = F.row_number().over(Window.orderBy(*order)), F.count(F.lit(1)).over(Window.partitionBy())
    band = None
    for name, upto in cuts:
        test = F.col("_rn") <= F.bround(F.col("_n") * F.lit(upto))
        band = F.when(test, name) if band is None else band.when(test, name)
    return df.withColumn("_rn", rn).withColumn("_n", n).withColumn("strength", band.otherwise(rest)).drop("_rn", "_n")


def band_by_threshold(score: Column, subtle: float, medium: float) -> Column:
    return F.when(score >= subtle, "subtle").when(score >= medium, "medium").otherwise("strong")


# Strength levels and the least strength of some techniques.
LEVELS = {"subtle": 0, "medium": 1, "strong": 2}
LEAST_STRENGTH = {
    "near_query_placement": "strong",
    "prompt_attack_template": "strong",
    "anchor_see_also_hijack": "medium",
    "table_caption_directive": "medium",
    "html_hidden_comment": "medium",
}


def at_least(technique: Column, strength: Column) -> Column:
    """strength, raised to the technique's least."""
    level = lambda s: F.when(s == "strong", 2).when(s == "medium", 1).otherwise(0)
    floor = F.lit(0)
    for name, s in LEAST_STRENGTH.items():
        floor = F.when(technique == name, LEVELS[s]).otherwise(floor)
    return F.element_at(F.array(F.lit("subtle"), F.lit("medium"), F.lit("strong")), F.greatest(level(strength), floor) + 1)


def by_quota(df: DataFrame, order: list[Column], quotas: list[tuple[str, int]]) -> DataFrame:
    """df with `technique`: ranked rows fill the quotas in order; rows beyond all quotas get null."""
    rn, tech, upto = F.row_number().over(Window.orderBy(*order)), None, 0
    for name, n in quotas:
        upto += n
        tech = F.when(F.col("_rn") <= upto, name) if tech is None else tech.when(F.col("_rn") <= upto, name)
    return df.withColumn("_rn", rn).withColumn("technique", tech).drop("_rn")


def round_robin(df: DataFrame, order: list[Column], names: list[str]) -> DataFrame:
    rn = F.row_number().over(Window.orderBy(*order))
    return df.withColumn("technique", F.element_at(F.array(*[F.lit(x) for x in names]), (F.pmod(rn - 1, F.lit(len(names))) + 1).cast("int")))


def fair_shares(total: int, names: list[str]) -> dict[str, int]:
    """total split over names, the first ones one more if it does not divide."""
    return {x: total // len(names) + (i < total % len(names)) for i, x in enumerate(names)}


def first_seen(df: DataFrame, text: str, ordinal: str) -> DataFrame:
    """df with `canonical` (the ordinal of the first row with the same text but for case and outer blanks) and `first`; blanks go."""
    key = F.lower(F.trim(F.col(text)))
    firsts = df.where(key != "").groupBy(key.alias("_k")).agg(F.min(ordinal).alias("canonical"))
    return df.withColumn("_k", key).join(firsts, "_k").withColumn("first", F.col(ordinal) == F.col("canonical")).drop("_k")


def numbered(df: DataFrame, order: list[Column], prefix: str, width: int = 4) -> DataFrame:
    """df with `new_id`: prefix and a zero-padded number from 1 by order."""
    return df.withColumn("new_id", F.concat(F.lit(prefix), F.lpad(F.row_number().over(Window.orderBy(*order)).cast("string"), width, "0")))
