"""Corpora, queries and judgements in and out: JSONL, TSV, keyed lookups, merged corpora, reports."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sizes import small

_CORPUS = "struct<_id: string, title: string, text: string, metadata: map<string, string>>"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).where("trim(value) != ''")


@dataclass
class Scanned:
    rows: DataFrame
    bad: DataFrame  # lines that are no JSON objects, or have no _id


def jsonl_corpus(spark: SparkSession, path: str) -> Scanned:
    """doc_id, title, text, metadata of every valid line; unknown top-level keys join metadata.

    Blank lines are skipped. Bad lines are set apart, not lost: count them, or show them.
    """
    return parsed_corpus(_lines(spark, path))


def parsed_corpus(lines: DataFrame) -> Scanned:
    known = ["_id", "title", "text", "metadata"]
    every = lines.select("value", F.from_json("value", "map<string, string>").alias("m"), F.from_json("value", _CORPUS).alias("c"))
    every = every.withColumn("ok", F.coalesce(F.col("m")["_id"].isNotNull(), F.lit(False)))
    extra = F.map_filter("m", lambda k, v: ~k.isin(known))
    meta = F.map_concat(F.map_filter(F.coalesce(F.col("c.metadata"), F.create_map().cast("map<string,string>")), lambda k, v: ~F.map_contains_key(extra, k)), extra)
    rows = every.where("ok").select(F.col("m")["_id"].alias("doc_id"), F.coalesce(F.col("m")["title"], F.lit("")).alias("title"), F.coalesce(F.col("m")["text"], F.lit("")).alias("text"), meta.alias("metadata"))
    return Scanned(rows, every.where(~F.col("ok")).select("value"))


def jsonl_strict(spark: SparkSession, path: str, most_bad: int | None = None) -> DataFrame:
    """As jsonl_corpus, but an error if there is a bad line (or more than most_bad; 0 means any number is allowed)."""
    got = jsonl_corpus(spark, path)
    if most_bad != 0:
        limit = most_bad or 0
        bad = got.bad.limit(limit + 1).count()
        if bad > limit:
            raise ValueError(f"{path}: more than {limit} bad lines")
    return got.rows


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def qrels(spark: SparkSession, path: str) -> DataFrame:
    """query_id, doc_id, score, ordinal of a TSV with a header; rows whose score is no integer are dropped."""
    raw = spark.read.option("sep", "\t").option("header", True).schema("`query-id` string, `corpus-id` string, score string").csv(path)
    rows = raw.select(F.col("query-id").alias("query_id"), F.col("corpus-id").alias("doc_id"), F.col("score").try_cast("int").alias("score"), F.monotonically_increasing_id().alias("ordinal"))
    return rows.where("score is not null")


def positive(judgements: DataFrame) -> DataFrame:
    return judgements.where("score > 0")


def graded(judgements: DataFrame) -> DataFrame:
    """One score per query and document: the last one given."""
    return last_wins(judgements, ["query_id", "doc_id"])


def positive_by_query(judgements: DataFrame) -> DataFrame:
    """query_id and its positive documents as a sorted array."""
    return positive(judgements).groupBy("query_id").agg(F.array_sort(F.collect_set("doc_id")).alias("doc_ids"))


def positive_queries(judgements: DataFrame) -> DataFrame:
    """query_id and the ordinal at which it first has a positive document."""
    return positive(judgements).groupBy("query_id").agg(F.min("ordinal").alias("first"))


def last_wins(rows: DataFrame, keys: list[str], ordinal: str = "ordinal") -> DataFrame:
    """One row per key, the one of greatest ordinal."""
    others = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), ordinal).alias("_r")).select(*keys, "_r.*")


def assert_unique(rows: DataFrame, key: str) -> DataFrame:
    twice = rows.groupBy(key).count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"duplicate {key}: {twice[0][0]}")
    return rows


def only_ids(corpus: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents with these ids: a semi-join, pushed to the scan as a broadcast if there are few ids."""
    return corpus.join(small(ids.select("doc_id").distinct()), "doc_id", "left_semi")


def one(corpus: DataFrame, doc_id) -> DataFrame:
    """Point lookup; statistics in a corpus sorted or bucketed by doc_id let the scan skip the rest."""
    return corpus.where(F.col("doc_id") == F.lit(doc_id))


def is_poisoned(doc_id: Column, metadata: Column | None = None) -> Column:
    """Ids that begin with IPI_, or a truthy `_poisoned` in the metadata."""
    flag = F.startswith(doc_id.cast("string"), F.lit("IPI_"))
    if metadata is None:
        return flag
    mark = F.lower(F.trim(metadata["_poisoned"]))
    return flag | F.coalesce(~mark.isin("", "false", "0", "none", "null"), F.lit(False))


def by_flag(rows: DataFrame, flag: Column, poisoned: bool | None = None) -> DataFrame:
    return rows if poisoned is None else rows.where(flag if poisoned else ~flag)


def first_of(*columns: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c.cast("string"), F.lit("")) for c in columns])


def write_jsonl(rows: DataFrame, path: str) -> None:
    """One JSON object per line through Spark's committer: whole files or none."""
    rows.write.mode("errorifexists").option("ignoreNullFields", False).json(path)


def remaining(queries: DataFrame, done: DataFrame) -> DataFrame:
    """Queries without a finished trace row: where a stopped run goes on."""
    return queries.join(done.select("query_id").distinct(), "query_id", "left_anti")


def append_traces(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def content_key(corpus: DataFrame) -> DataFrame:
    """One row: a 16-digit key of all texts that does not depend on their order, made of sums of digests.

    Indexes are kept in folders named by it; sums combine before the shuffle, so no task sees all texts.
    """
    part = lambda i: F.sum(F.conv(F.substring(F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), "text")), 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)"))
    sums = corpus.agg(*[F.coalesce(part(i), F.lit(0)).cast("string").alias(f"s{i}") for i in range(4)], F.count(F.lit(1)).cast("string").alias("n"))
    return sums.select(F.substring(F.md5(F.concat_ws("-", "n", "s0", "s1", "s2", "s3")), 1, 16).alias("key"))


def save_index(vectors: DataFrame, folder: str, **facts) -> None:
    """doc_id and unit vectors as Parquet, facts as JSON beside them."""
    vectors.write.mode("overwrite").parquet(f"{folder}/vectors")
    spark = vectors.sparkSession
    spark.createDataFrame([(json.dumps(facts, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/facts")


def load_index(spark: SparkSession, folder: str) -> tuple[DataFrame, dict]:
    return spark.read.parquet(f"{folder}/vectors"), json.loads(spark.read.text(f"{folder}/facts").first()[0])


def index_exists(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/vectors/_SUCCESS")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def resolved(config: dict, corpus: str, tier: str, **overrides) -> dict:
    """A copy of config[corpus][tier] with the overrides that are not empty."""
    if corpus not in config or tier not in config[corpus]:
        raise ValueError(f"unknown corpus or tier: {corpus}/{tier}")
    return dict(config[corpus][tier]) | {k: v for k, v in overrides.items() if v}


def markdown(rows: DataFrame, title: str, most: int = 1000) -> str:
    """A Markdown table of a summary (a table that is small by nature; more than `most` rows is an error)."""
    got = rows.limit(most + 1).collect()
    if len(got) > most:
        raise ValueError("too many rows for a report")
    cell = lambda x: "" if x is None else str(x).replace("|", "\\|")
    head = [f"# {title}", "", "| " + " | ".join(rows.columns) + " |", "|" + " --- |" * len(rows.columns)]
    return "\n".join(head + ["| " + " | ".join(map(cell, r)) + " |" for r in got]) + "\n"


def write_report(rows: DataFrame, folder: str, title: str) -> None:
    """The same summary as JSON, CSV and Markdown."""
    rows.coalesce(1).write.mode("overwrite").json(f"{folder}/json")
    rows.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{folder}/csv")
    rows.sparkSession.createDataFrame([(markdown(rows, title),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/markdown")
