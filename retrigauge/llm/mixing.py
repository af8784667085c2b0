"""Mixing sources to target weights with hash-threshold histograms (operator 6, DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import WORD, table, text_or_empty, written

#: Weights by the rank of a source in code-point order (null last), repeating.
WEIGHTS = (5, 2, 1)
SHARE, CAP = 1.5, 2.0
#: 60 bits of hash are read as five digits of 12 bits.
DIGIT, LEVELS = 12, 5


def key_hash() -> Column:
    """A 60-bit hash of doc_id and text that never changes between runs."""
    key = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), text_or_empty())
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words) and h, the hash of doc_id and text."""
    return docs.select(
        "doc_id",
        "source",
        F.regexp_count(text_or_empty(), F.lit(WORD)).cast("long").alias("size"),
        key_hash().alias("h"),
    )


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """source, source_size, target: one row per source (a table of sources, not of documents, is ordered whole).

    Targets share `share` times all sizes by weight; none is above `cap` times its source's size, and
    what is above is shared again by weight among the others until none is above. In order of
    cap/weight the capped sources come first, so the water level is read off running sums.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    by = by.withColumn("ord", rank).withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("ord") - 1, F.lit(len(weights))) + 1).cast("int")))
    by = by.withColumn("most", F.lit(float(cap)) * F.col("source_size"))
    order = Window.orderBy(F.col("most") / F.col("w"), "ord")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    by = (
        by.withColumn("left", F.lit(float(share)) * F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(before), F.lit(0.0)))
        .withColumn("left_w", F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
        .withColumn("open", F.col("w") * F.col("left") / F.col("left_w") <= F.col("most"))
        .withColumn("n", F.row_number().over(order))
    )
    first = F.min(F.when(F.col("open"), F.struct("n", "left", "left_w"))).over(every)
    by = by.withColumn("f", first)
    free = F.least("most", F.col("w") * F.col("f.left") / F.col("f.left_w"))
    return by.select("source", "source_size", F.when(F.col("f").isNull() | (F.col("n") < F.col("f.n")), F.col("most")).otherwise(free).alias("target"))


def thresholds(sizes: DataFrame, goal: DataFrame) -> DataFrame:
    """source, source_size, target, copies, below: documents with h < below are taken copies + 1 times, others copies times.

    Every level sums sizes by source and one digit of the hash, finds the digit in which the rest of
    the budget ends, and only that bucket is looked at again. The last level holds single hash values;
    the one at the border is taken if that comes nearer to the target. Nothing is sorted.
    """
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    state = goal.withColumn("copies", copies).withColumn("rest", F.col("target") - F.col("copies") * F.col("source_size"))
    state = written(state.withColumn("prefix", F.lit(0).cast("long")).withColumn("used", F.lit(0).cast("long")), "mix")
    for level in range(LEVELS):
        shift = DIGIT * (LEVELS - 1 - level)
        bucket = F.shiftright("h", shift)
        border = state.select(F.col("source").alias("s"), "prefix").where("prefix is not null")
        here = sizes.join(F.broadcast(border) if _small(border) else border, F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("h", shift + DIGIT) == F.col("prefix")))
        hist = here.groupBy("source", bucket.alias("digit")).agg(F.sum("size").alias("mass"))
        run = Window.partitionBy("source").orderBy("digit").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        hist = hist.withColumn("upto", F.sum("mass").over(run)).withColumnRenamed("source", "s")
        found = (
            hist.join(state.select(F.col("source").alias("source2"), "rest", "used"), F.col("s").eqNullSafe(F.col("source2")))
            .where((F.col("used") + F.col("upto") > F.col("rest")) & (F.col("used") + F.col("upto") - F.col("mass") <= F.col("rest")))
            .groupBy("s")
            .agg(F.min(F.struct("digit", "upto", "mass")).alias("at"))
        )
        state = (
            state.join(found, F.col("source").eqNullSafe(F.col("s")), "left")
            .withColumn("prefix", F.col("at.digit"))
            .withColumn("mass", F.col("at.mass"))
            .withColumn("used", F.col("used") + F.coalesce(F.col("at.upto") - F.col("at.mass"), F.lit(0)))
            .drop("s", "at")
        )
        state = written(state if level == LEVELS - 1 else state.drop("mass"), "mix")
    nearer = (F.col("used") + F.col("mass") - F.col("rest")) < (F.col("rest") - F.col("used"))
    below = F.when(F.col("prefix").isNull(), F.lit(0)).when(nearer, F.col("prefix") + 1).otherwise(F.col("prefix"))
    return state.select("source", "source_size", "target", "copies", below.cast("long").alias("below"))


def _small(df: DataFrame, most: int = 10_000) -> bool:
    return df.limit(most + 1).count() <= most


def mixed(sizes: DataFrame, **how) -> DataFrame:
    """sizes(doc_id, source, size, h) with source_size, target, times (how often it is taken) and taken = size * times."""
    cut = thresholds(sizes, targets(sizes, **how)).withColumnRenamed("source", "s")
    out = sizes.join(F.broadcast(cut) if _small(cut) else cut, F.col("source").eqNullSafe(F.col("s")), "left")
    times = F.col("copies") + F.when(F.col("h") < F.col("below"), 1).otherwise(0)
    return out.withColumn("times", times).withColumn("taken", F.col("size") * F.col("times")).drop("s", "copies", "below")


def mix_documents(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: every document as many times as it is taken (0, 1 or 2), all its columns unchanged.

    Rows that agree in doc_id and text share one decision. A null source is a source of its own, a
    null text has size 0; an empty table gives an empty mix.
    """
    sizes = written(sized(docs), "sizes")
    cut = thresholds(sizes, targets(sizes, **how)).select(F.col("source").alias("_s"), F.col("copies").alias("_copies"), F.col("below").alias("_below"))
    held = docs.select(key_hash().alias("_h"), F.col("source").alias("_source"), *[F.col(c).alias(f"_z_{c}") for c in docs.columns])
    out = held.join(F.broadcast(cut) if _small(cut) else cut, F.col("_source").eqNullSafe(F.col("_s")), "left")
    times = (F.col("_copies") + F.when(F.col("_h") < F.col("_below"), 1).otherwise(0)).cast("int")
    taken = out.withColumn("_n", F.explode(F.array_repeat(F.lit(1), times)))
    return taken.select(*[F.col(f"_z_{c}").alias(c) for c in docs.columns])


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = written(sized(table(spark, sf_dir, "documents")), "sizes")
    return mixed(sizes).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 15) AS BIGINT) AS h
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
o AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS ord FROM s),
w AS (SELECT *, CAST(CASE (ord - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS w, 2.0::DOUBLE * source_size AS most FROM o),
p AS (
  SELECT *, 1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(most) OVER b, 0) AS lft, sum(w) OVER () - coalesce(sum(w) OVER b, 0) AS lft_w,
         row_number() OVER (ORDER BY most / w, ord) AS n
  FROM w WINDOW b AS (ORDER BY most / w, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT n AS fn, lft AS fl, lft_w AS fw FROM p WHERE w * lft / lft_w <= most ORDER BY n LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN fn IS NULL OR n < fn THEN most ELSE least(most, w * fl / fw) END AS target FROM p LEFT JOIN f ON true),
r AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS copies FROM t),
a AS (SELECT source, h, sum(size) AS mass FROM d GROUP BY source, h),
c AS (SELECT *, sum(mass) OVER (PARTITION BY source ORDER BY h) AS upto FROM a),
x AS (
  SELECT c.source, c.h, CASE WHEN r.source_size = 0 THEN 0 WHEN upto <= target - copies * source_size THEN 1
         WHEN upto - mass <= target - copies * source_size AND upto - (target - copies * source_size) < (target - copies * source_size) - (upto - mass) THEN 1 ELSE 0 END AS extra
  FROM c JOIN r ON c.source IS NOT DISTINCT FROM r.source)
SELECT d.doc_id, d.size, r.source_size, r.target, CAST(d.size * (r.copies + x.extra) AS BIGINT) AS taken
FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source JOIN x ON d.source IS NOT DISTINCT FROM x.source AND d.h = x.h
"""
