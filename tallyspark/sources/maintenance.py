"""Keeping derived tables true to the captures: backfill, upsert, dims, quarantine, staleness."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.variants import strict_json

DECODED = ("tools_called", "stop_sequences", "context_management", "segments", "observed", "models")


def pending(calls: DataFrame, g: DataFrame, version: str) -> DataFrame:
    """Captures without a derived row of this parser version."""
    done = g.filter(F.col("parser_version") == version).select(F.col("call_id").alias("id"))
    return calls.join(done, "id", "left_anti")


def quarantine(calls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good captures, failures): a payload that is there and no JSON fails with its stage."""
    bad = lambda c: F.col(c).isNotNull() & strict_json(F.col(c)).isNull()
    stage = F.when(bad("request_body"), "request").when(bad("response_body"), "response").when(bad("response_reconstructed"), "reconstructed")
    x = calls.withColumn("_stage", stage)
    failures = x.filter("_stage IS NOT NULL").select(F.col("id").alias("call_id"), F.col("_stage").alias("stage"), F.lit("invalid JSON").alias("error"), F.lit(False).alias("panicked"), F.col("timestamp_start").alias("at"))
    return x.filter("_stage IS NULL").drop("_stage"), failures


def backfill_report(calls: DataFrame, derived: DataFrame, failures: DataFrame) -> DataFrame:
    """One row: how many captures were derived, failed, or are no inference."""
    n = lambda df, name: df.agg(F.count("*").alias(name))
    return n(derived, "derived").crossJoin(n(failures, "failed")).crossJoin(n(calls, "calls")).select("derived", "failed", (F.col("calls") - F.col("derived") - F.col("failed")).alias("skipped"))


def upsert(existing: DataFrame, new: DataFrame, key: str = "call_id") -> DataFrame:
    """The table after every row of the new keys is replaced."""
    return existing.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def upsert_partitions(existing: DataFrame, new: DataFrame, path: str, key: str = "call_id", day: str = "day") -> None:
    """Writes upsert() to day partitions, rewriting only those that the new rows or their old versions are in."""
    old = existing.join(new.select(key).distinct(), key, "left_semi").select(day)
    touched = old.unionByName(new.select(day)).distinct()
    out = upsert(existing.join(touched, day, "left_semi"), new, key)
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)


def merge_dims(new: DataFrame, existing: DataFrame, key: str | list[str]) -> DataFrame:
    """Rows of `new` to append: one for each key that is not there yet."""
    keys = [key] if isinstance(key, str) else key
    return new.dropDuplicates(keys).join(existing.select(*keys), keys, "left_anti")


def refresh_if_stale(meta: dict, parser_version: str, pricing_version: str) -> str:
    """What a stored version row asks for: rebuild, reprice or nothing."""
    if meta.get("parser_version") != parser_version:
        return "rebuild"
    return "reprice" if meta.get("pricing_version") != pricing_version else "nothing"


def to_records(df: DataFrame) -> DataFrame:
    """One JSON record a row; columns that hold JSON text are decoded into it."""
    cols = [F.try_parse_json(F.col(c)).alias(c) if c in DECODED and dict(df.dtypes)[c] == "string" else F.col(c) for c in df.columns]
    return df.select(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("record"))
