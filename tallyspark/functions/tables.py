"""Tables in the shared folder that cut a plan which several others read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset, a temporary one in local mode; on a cluster an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", base)
    return base


def cut(df: DataFrame, tag: str) -> DataFrame:
    """Writes `df` once and reads it again: what is built on it reads columns of a table, not the plan anew."""
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def is_small(df: DataFrame, rows: int = 50_000, chars: int = 8_000_000) -> bool:
    """Whether a table may be broadcast, by a count that ends past `rows`. Spark does not know the size of one made of rows or aggregates."""
    n, size = df.limit(rows + 1).agg(F.count("*"), F.coalesce(F.sum(F.length(F.to_csv(F.struct("*")))), F.lit(0))).first()
    return n <= rows and size <= chars
