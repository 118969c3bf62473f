"""The model catalogue: nested JSON to rate tables, its digest, a gate before it takes effect, and the one in force."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions.variants import flag, items, json_kind, sub, text, whole
from tallyspark.streaming.versions import read_manifest, versions, write_manifest

RATES = ("input", "output", "cache_read", "cache_write")


def load_catalog(df: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """(models, tiers) of rows of catalogue JSON: provider -> models -> record.

    A model without `cost` is unpriced. Rates need `input`; `output` is 0 if absent. Providers without
    models give no row.
    """
    as_map = lambda v: F.when(json_kind(v) == "OBJECT", v.cast("map<string,variant>"))
    p = df.select(F.explode(as_map(F.try_parse_json(column))).alias("provider", "p"))
    m = p.select("provider", F.explode(as_map(sub(F.col("p"), "$.models"))).alias("model_id", "m"))
    v = F.col("m")
    rate = lambda x, k: F.when(json_kind(sub(x, f"$.{k}")).isin("BIGINT", "DOUBLE") | json_kind(sub(x, f"$.{k}")).startswith("DECIMAL"), F.try_variant_get(x, f"$.{k}", "double"))
    cost = sub(v, "$.cost")
    priced = rate(v, "cost.input").isNotNull()
    own = {k: F.when(priced, F.coalesce(rate(v, f"cost.{k}"), F.lit(0.0)) if k == "output" else rate(v, f"cost.{k}")).alias(k) for k in RATES}
    models = m.select(
        "provider", "model_id", text(v, "$.name").alias("name"), text(v, "$.family").alias("family"), whole(v, "$.limit.context").alias("context_limit"), whole(v, "$.limit.input").alias("input_limit"), whole(v, "$.limit.output").alias("output_limit"),
        *own.values(), flag(v, "$.reasoning").alias("reasoning"), flag(v, "$.tool_call").alias("tool_call"), F.to_json(sub(v, "$.modalities")).alias("modalities"), (F.size(items(cost, "$.tiers")) > 0).alias("tiered"))
    t = m.select("provider", "model_id", F.explode(items(v, "$.cost.tiers")).alias("t"))
    tiers = t.select("provider", "model_id", whole(F.col("t"), "$.tier.size").alias("over_context"), *[(F.coalesce(rate(F.col("t"), k), F.lit(0.0)) if k == "output" else rate(F.col("t"), k)).alias(k) for k in RATES]).filter("over_context IS NOT NULL AND input IS NOT NULL")
    return models, tiers


def catalog_meta(models: DataFrame, provider: str = "provider", fetched_at: str | None = None, checked_at: str | None = None) -> DataFrame:
    """One row: digest of the catalogue, how many providers and models it has, and when it was fetched and last checked."""
    row = F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(models.columns)])), 256)
    # An order-free digest: no sort of all rows in one task.
    x = models.withColumn("h", row)
    return x.agg(F.sha2(F.concat_ws(":", F.bit_xor(F.xxhash64("h")), F.bit_xor(F.xxhash64(F.lit(1), "h")), F.count("*")), 256).alias("digest"), F.count_distinct(provider).alias("providers"), F.count("*").alias("models")).withColumns({n: F.lit(t).cast("timestamp") for n, t in (("fetched_at", fetched_at), ("checked_at", checked_at))})


def validate_catalog(models: DataFrame, required: tuple[str, ...] = ("anthropic", "openai")) -> DataFrame:
    """The catalogue itself; an error if a required provider is missing."""
    wanted = models.sparkSession.createDataFrame([(r,) for r in required], "provider string")
    missing = [r["provider"] for r in wanted.join(models, "provider", "left_anti").collect()]  # at most as many as are required
    if missing:
        raise ValueError(f"catalogue lacks {', '.join(sorted(missing))}")
    return models


TABLES = ("models", "tiers", "local")
Rates = tuple[DataFrame, DataFrame, DataFrame]


def digest(rates: Rates) -> str:
    """One digest of all three rate tables."""
    own = [catalog_meta(df, provider).first()["digest"] for df, provider in zip(rates, ("provider", "provider", "id"), strict=True)]
    return hashlib.sha256("".join(own).encode()).hexdigest()


def put_in_force(spark: SparkSession, root: str, rates: Rates, fetched_at: str | None = None, checked_at: str | None = None, required: tuple[str, ...] = ("anthropic", "openai")) -> str:
    """Makes rates the catalogue in force and returns their digest.

    They are written whole first; the manifest that points to them is renamed into place last, so a reader has the old
    ones or these. An error, and the old ones stay, if a required provider is missing. Rates equal to those in force are
    not written again: only when they were checked is noted.
    """
    validate_catalog(rates[0], required)
    new, known = digest(rates), read_manifest(spark, root, "rates")
    version = max(versions(spark, f"{root}/rates/manifest"), default=-1) + 1
    if known and known["digest"] == new:
        write_manifest(spark, root, "rates", version, known["parts"], "", digest=new, fetched_at=known["fetched_at"], checked_at=checked_at)
        return new
    for name, df in zip(TABLES, rates, strict=True):
        df.coalesce(1).write.mode("overwrite").parquet(f"{root}/rates/v={version}/{name}")  # a catalogue has thousands of rows
    write_manifest(spark, root, "rates", version, {name: version for name in TABLES}, "", digest=new, fetched_at=fetched_at, checked_at=checked_at)
    return new


def in_force(spark: SparkSession, root: str) -> tuple[Rates, dict]:
    """(rates, what is known of them: digest, fetched_at, checked_at) of the catalogue in force."""
    m = read_manifest(spark, root, "rates")
    if m is None:
        raise ValueError(f"no catalogue is in force in {root}")
    return tuple(spark.read.parquet(f"{root}/rates/v={m['parts'][name]}/{name}") for name in TABLES), {k: m[k] for k in ("digest", "fetched_at", "checked_at")}
