"""Tables, shared storage and word rules that the training-data operators have in common."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of an Arrow batch, beyond which a batch ends with the row that reached it.
BATCH_BYTES = 16 << 20
#: One word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows of a table beyond which a join never sends it whole.
WHOLE_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a folder of our own where all run on this machine."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="retrigauge-")
        atexit.register(shutil.rmtree, where, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/retrigauge/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: lineage ends here and survives a lost executor."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def merged(df: DataFrame, n: int) -> DataFrame:
    """df, of n rows at most, for a join: beyond WHOLE_ROWS it joins by shuffle. Spark would judge by the size of its compressed files."""
    return df.hint("merge") if n > WHOLE_ROWS else df


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """At most `rows` rows and BATCH_BYTES in an Arrow batch from now on: whole texts are long, and workers hold a batch at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows or int(spark.conf.get(key)) <= 0:
        spark.conf.set(key, str(rows))
