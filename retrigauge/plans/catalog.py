"""Where plans register: a query, its function and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


class Tables:
    """The tables of one scale factor as DataFrames; corpus and questions are the reference's roles for two of them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @property
    def corpus(self) -> DataFrame:
        """doc_id, title (empty: these documents have none), text, source, lang."""
        return self.documents.selectExpr("doc_id", "'' AS title", "text", "source", "lang")

    @property
    def questions(self) -> DataFrame:
        return self.benchmark.selectExpr("item_id AS query_id", "text AS query")

    @property
    def question_count(self) -> int:
        return self.benchmark.count()
