"""Retrieval over a stream of query files: append, and go on where a stopped run ended."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.retrieval import bm25_retrieve
from ..sources.io import append_traces


def retrieve_stream(spark: SparkSession, queries: str, corpus: DataFrame, k: int, out: str, checkpoint: str) -> None:
    """Every new JSON file of queries(query_id, query) under `queries` is answered once and appended to `out`.

    The checkpoint remembers which files are done; a run handles what is there and ends.
    """

    def answer(batch: DataFrame, number: int) -> None:
        append_traces(bm25_retrieve(corpus, batch, k), out)

    source = spark.readStream.schema("query_id long, query string").json(queries)
    run = source.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    run.awaitTermination()
