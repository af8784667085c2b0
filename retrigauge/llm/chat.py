"""Chat formatting after cumulative-snapshot collapse (operator 1, DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import table

#: Turns in one block of a prefix scan, and in one rendered part: no task or string holds more of a conversation.
BLOCK = 512
START, END = "<|im_start|>", "<|im_end|>"
_SUMS = [f"s{i}" for i in range(4)]


def turns(logged: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, block, each logged turn once; a null role is `unknown`, a null text empty.

    Turns are ordered by turn (null last), role, text. Rows that agree in all four columns are one turn.
    """
    rows = logged.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    return rows.withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit((1 << 62)))).withColumn("last", F.col("turn").isNull())


def rolled(rows: DataFrame) -> DataFrame:
    """rows with pos (from 1 in its conversation) and s0..s3, the rolling hash of the turns up to this one.

    The hash is the sum of digests that bind position, role and text, so it is a prefix sum: blocks of
    a conversation are summed apart, then shifted by what lies before them. A long conversation is
    many blocks, and only its block totals meet in one place.
    """
    inside = Window.partitionBy("conv_id", "block").orderBy("last", "turn", "role", "text")
    rows = rows.withColumn("k", F.row_number().over(inside).cast("long"))
    counts = rows.groupBy("conv_id", "block").agg(F.count(F.lit(1)).alias("size"))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("conv_id", "block", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("ahead"))
    same = lambda a, b: a["conv_id"].eqNullSafe(b["conv_id"]) & (a["block"] == b["block"])
    rows = rows.join(starts, same(rows, starts)).drop(starts["conv_id"], starts["block"]).withColumn("pos", F.col("ahead") + F.col("k"))
    digest = F.sha2(F.concat_ws(":", F.col("pos"), F.char_length("role"), F.col("role"), F.col("text")), 256)
    for i, s in enumerate(_SUMS):
        rows = rows.withColumn(f"v{i}", F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long"))
    upto = Window.partitionBy("conv_id", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select("*", *[F.sum(f"v{i}").over(upto).alias(f"in{i}") for i in range(4)])
    totals = rows.groupBy("conv_id", "block").agg(*[F.sum(f"v{i}").alias(f"t{i}") for i in range(4)])
    shifts = totals.select("conv_id", "block", *[F.coalesce(F.sum(f"t{i}").over(before), F.lit(0)).alias(f"a{i}") for i in range(4)])
    out = rows.join(shifts, same(rows, shifts)).drop(shifts["conv_id"], shifts["block"])
    return out.select("conv_id", "block", "pos", "role", "text", *[(F.col(f"in{i}") + F.col(f"a{i}")).alias(s) for i, s in enumerate(_SUMS)])


def maximal(rolling: DataFrame) -> DataFrame:
    """conv_id, n_turns, copies of the conversations that no longer one begins with.

    Of equal conversations the least conv_id stands for all (copies tells how many). Both sides of the
    anti-join are distinct prefix hashes, so a first turn that everybody shares is one row.
    """
    light = rolling.select("conv_id", "pos", *_SUMS)
    ends = light.groupBy("conv_id").agg(F.max(F.struct("pos", *_SUMS)).alias("end")).select("conv_id", F.col("end.pos").alias("n"), *[F.col(f"end.{s}").alias(s) for s in _SUMS])
    own = ends.select(F.col("conv_id").alias("c"), "n")
    proper = light.join(own, light["conv_id"].eqNullSafe(own["c"])).where(F.col("pos") < F.col("n")).select("pos", *_SUMS).distinct()
    whole = ends.groupBy(F.col("n").alias("pos"), *_SUMS).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("copies"))
    return whole.join(proper, ["pos", *_SUMS], "left_anti").select("conv_id", F.col("pos").alias("n_turns"), "copies")


def rendered(rolling: DataFrame, kept: DataFrame) -> DataFrame:
    """conv_id, part, n_turns, copies, text: each kept conversation in parts of BLOCK turns, in ChatML form."""
    kept = kept.withColumnRenamed("conv_id", "c")
    places = rolling.select("conv_id", "block").distinct()
    places = places.join(kept, places["conv_id"].eqNullSafe(kept["c"])).select("c", F.col("block").alias("b"), "n_turns", "copies")
    said = rolling.select("conv_id", "block", "pos", F.concat(F.lit(START), "role", F.lit("\n"), "text", F.lit(END), F.lit("\n")).alias("said"))
    said = said.join(places, said["conv_id"].eqNullSafe(places["c"]) & (said["block"] == places["b"]))
    parts = said.withColumn("part", F.floor((F.col("pos") - 1) / BLOCK)).groupBy("conv_id", "part", "n_turns", "copies").agg(F.array_sort(F.collect_list(F.struct("pos", "said"))).alias("all"))
    return parts.select("conv_id", "part", "n_turns", "copies", F.array_join(F.col("all.said"), "").alias("text"))


def format_chats(logged: DataFrame) -> DataFrame:
    """Maximal conversations, rendered.

    Turns with a null conv_id are one conversation; an empty table gives none; extra columns are ignored.
    """
    rolling = rolled(turns(logged))
    return rendered(rolling, maximal(rolling))


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations"))


SQL = """
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text) AS pos FROM t),
p AS (
  SELECT *, string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '') OVER (PARTITION BY conv_id ORDER BY pos) AS said,
         list({'r': role, 't': text}) OVER (PARTITION BY conv_id ORDER BY pos) AS turns, count(*) OVER (PARTITION BY conv_id) AS n
  FROM o),
proper AS (SELECT DISTINCT turns FROM p WHERE pos < n),
whole AS (SELECT turns, min(conv_id) AS conv_id, count(*) AS copies, min(n) AS n, min(said) AS said FROM p WHERE pos = n GROUP BY turns)
SELECT conv_id, CAST(0 AS BIGINT) AS part, n AS n_turns, copies, said AS text FROM whole WHERE turns NOT IN (SELECT turns FROM proper)
"""
