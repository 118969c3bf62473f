"""Captures at rest: explicit schema, redaction on write, append-only files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions.variants import quoted, strict_json

SCHEMA = """id long, timestamp_start timestamp, timestamp_first_chunk timestamp, timestamp_end timestamp, method string, url string, request_headers map<string,string>,
request_body string, response_status long, response_headers map<string,string>, response_body string, response_raw_sse string, response_reconstructed string, error string"""
#: Headers that hold credentials.
SECRET = ("authorization", "x-api-key", "proxy-authorization")
REDACTED = "<redacted>"


def read_calls(spark: SparkSession, path: str, form: str = "parquet") -> DataFrame:
    """Captures with payloads that are not JSON made null."""
    df = spark.read.format(form).schema(SCHEMA).load(path)
    return df.withColumns({c: F.when(strict_json(F.col(c)).isNotNull(), F.col(c)) for c in ("request_body", "response_body", "response_reconstructed")})


def newest(calls: DataFrame, limit: int = 50) -> DataFrame:
    return calls.orderBy(F.desc("id")).limit(limit)


def get_call(calls: DataFrame, call_id: int) -> DataFrame:
    """One capture; the filter reaches the files."""
    return calls.filter(F.col("id") == call_id)


def redact_headers(df: DataFrame) -> DataFrame:
    """Credential headers of requests and responses, in any case, replaced by a mark."""
    hide = lambda c: F.transform_values(c, lambda k, v: F.when(F.lower(k).isin(*SECRET), F.lit(REDACTED)).otherwise(v))
    return df.withColumns({c: hide(F.col(c)) for c in ("request_headers", "response_headers")})


def append_calls(df: DataFrame, path: str) -> None:
    """Adds captures, redacted; what is there is never rewritten.

    Files carry a Bloom filter of their ids, sized by what they hold: a look-up of one id opens the row groups that may have it,
    also where ids come out of order and every group spans most of them.
    """
    redact_headers(df).write.mode("append").option("parquet.bloom.filter.enabled#id", "true").option("parquet.bloom.filter.adaptive.enabled", "true").parquet(path)


def body_to_json(raw: Column) -> Column:
    """A body as JSON text: null if empty, itself if it is JSON, else a JSON string."""
    return F.when(raw == "", None).when(strict_json(raw).isNotNull(), raw).otherwise(quoted(raw))


def headers_map(rows: DataFrame) -> DataFrame:
    """(call_id, headers) of rows (call_id, pos, name, value): names in lower case, values of one name joined in order."""
    one = rows.groupBy("call_id", F.lower("name").alias("name")).agg(F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("v"))
    joined = F.array_join(F.transform("v", lambda x: x["value"]), ", ")
    return one.groupBy("call_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", joined.alias("value"))))).alias("headers"))
