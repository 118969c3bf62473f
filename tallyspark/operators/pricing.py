"""Cost of calls: model resolution, context bands, historical rates and the cost columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.scalars import strip_alias
from tallyspark.functions.tables import is_small

#: Cache rates as multiples of the input rate where none are published; tokens a rate is for.
CACHE_READ, WRITE_5M, WRITE_1H, PER = 0.1, 1.25, 2.0, 1_000_000.0
RULES_VERSION = "rules-1"

def stamp(digest: str) -> str:
    """The pricing version of the rules and a catalogue digest."""
    return f"{RULES_VERSION}+cat:{digest[:12]}"


COSTS = ("cost_input_usd", "cost_output_usd", "cost_cache_write_usd", "cost_cache_read_usd", "cost_total_usd", "cost_uncached_equiv_usd")


def count_of(name: str) -> Column:
    """A token counter for arithmetic: null and negative values are 0."""
    return F.greatest(F.coalesce(F.col(name), F.lit(0)), F.lit(0)).cast("long")


def writes() -> tuple[Column, Column]:
    """Cache writes by lifetime; an unknown split counts as the short one."""
    unsplit = F.col("cache_creation_5m_tokens").isNull() & F.col("cache_creation_1h_tokens").isNull()
    return F.when(unsplit, count_of("cache_creation_tokens")).otherwise(count_of("cache_creation_5m_tokens")), F.when(unsplit, F.lit(0).cast("long")).otherwise(count_of("cache_creation_1h_tokens"))


def usage_reported() -> Column:
    """Whether a call reported any counter at all: without one its cost is unknown, not zero."""
    names = ("input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_5m_tokens", "cache_creation_1h_tokens", "cache_creation_tokens")
    return F.coalesce(*[F.col(n) for n in names]).isNotNull()


def resolve_models(g: DataFrame, models: DataFrame) -> DataFrame:
    """Adds cat_provider and cat_model: the catalogue row of (provider, model).

    Exact id within the provider, else its id without alias suffix within the provider, else the exact
    id under another provider (the first by name). Never a prefix.
    """
    models = models.select("provider", "model_id")
    # Calls have few models: in a shuffle by model a handful of tasks would take them all. Only a catalogue that is large by count is shuffled.
    small = F.broadcast if is_small(models) else lambda df: df
    ids = models.select(F.col("provider").alias("_p"), F.col("model_id").alias("_m"))
    other = models.groupBy(F.col("model_id").alias("_m")).agg(F.array_sort(F.collect_set("provider")).alias("_ps"))
    x = g.withColumn("_alias", strip_alias(F.col("model")))
    x = x.join(small(ids.select(F.col("_p").alias("_p1"), F.col("_m").alias("_m1"))), (F.col("provider") == F.col("_p1")) & (F.col("model") == F.col("_m1")), "left")
    x = x.join(small(ids.select(F.col("_p").alias("_p2"), F.col("_m").alias("_m2"))), (F.col("provider") == F.col("_p2")) & (F.col("_alias") == F.col("_m2")), "left")
    x = x.join(small(other.select(F.col("_m").alias("_m3"), "_ps")), F.col("model") == F.col("_m3"), "left")
    far = F.get(F.filter("_ps", lambda p: p != F.coalesce(F.col("provider"), F.lit(""))), F.lit(0))
    out = x.withColumn("cat_provider", F.coalesce("_p1", "_p2", far)).withColumn("cat_model", F.coalesce("_m1", "_m2", F.when(far.isNotNull(), F.col("_m3"))))
    return out.drop("_alias", "_p1", "_m1", "_p2", "_m2", "_m3", "_ps")


_RATES = ("input", "output", "cache_read", "cache_write")


def price_bands(models: DataFrame, tiers: DataFrame) -> DataFrame:
    """(provider, model_id, over, below, rates): the priced context ranges of each model; a bound is open below, closed above."""
    base = models.filter("input IS NOT NULL").select("provider", "model_id", F.lit(-1).cast("long").alias("over"), *_RATES)
    marks = base.unionByName(tiers.select("provider", "model_id", F.col("over_context").alias("over"), *_RATES))
    rates = F.struct("over", *[F.col(r) for r in _RATES])
    listed = marks.groupBy("provider", "model_id").agg(F.array_sort(F.collect_list(rates)).alias("r"))
    at = listed.select("provider", "model_id", "r", F.posexplode("r").alias("k", "b"))
    return at.select("provider", "model_id", "b.*", F.get("r", F.col("k") + 1)["over"].alias("below"))


def local_rates(local: DataFrame, most: int = 200) -> list:
    """The local rates: a handful, which become one expression and not a join. An error past `most`: those belong in the catalogue."""
    rows = local.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"over {most} local rates: put them in the catalogue")
    return rows


def price(g: DataFrame, models: DataFrame, tiers: DataFrame, local: DataFrame, version: str = RULES_VERSION) -> DataFrame:
    """Adds the cost columns, pricing_model_id and pricing_version.

    The band is that of the whole context (input, cache read and cache writes), strictly above its
    bound. A local rate with `until` beats the catalogue for calls before it; one without fills a gap.
    Costs are null where the model has no rate or no counter was reported; a reported zero costs 0.
    """
    five, hour = writes()
    x = resolve_models(g.drop(*COSTS, "pricing_model_id", "pricing_version"), models)
    x = x.withColumn("_five", five).withColumn("_hour", hour)
    x = x.withColumn("_ctx", count_of("input_tokens") + count_of("cache_read_tokens") + F.col("_five") + F.col("_hour"))
    bands = price_bands(models, tiers).select(*[F.col(c).alias(f"_b_{c}") for c in ("provider", "model_id", "over", "below", *_RATES)])
    bands = F.broadcast(bands) if is_small(models) and is_small(tiers) else bands
    x = x.join(bands, (F.col("cat_provider") == F.col("_b_provider")) & (F.col("cat_model") == F.col("_b_model_id")) & (F.col("_ctx") > F.col("_b_over")) & (F.col("_b_below").isNull() | (F.col("_ctx") <= F.col("_b_below"))), "left")
    past, gap = F.lit(None), F.lit(None)
    for r in reversed(local_rates(local)):
        rate = F.struct(F.lit(r["id"]).alias("id"), F.lit(float(r["input"])).alias("input"), F.lit(float(r["output"])).alias("output"))
        hit = F.col("model").startswith(r["id"]) if r["prefix"] else F.col("model") == r["id"]
        if r["until"] is None:
            gap = F.when(hit, rate).otherwise(gap)
        else:
            past = F.when(hit & (F.col("started_at") < F.lit(r["until"])), rate).otherwise(past)
    kind = "struct<id:string,input:double,output:double>"
    published = F.col("_b_input").isNotNull()
    x = x.withColumn("_local", F.coalesce(past.cast(kind), F.when(~published, gap.cast(kind))))
    own = F.col("_local").isNotNull()
    rate_in = F.when(own, F.col("_local.input")).otherwise(F.col("_b_input"))
    rate_out = F.when(own, F.col("_local.output")).otherwise(F.col("_b_output"))
    read = F.when(own, rate_in * CACHE_READ).otherwise(F.coalesce(F.col("_b_cache_read"), rate_in * CACHE_READ))
    write5 = F.when(own, rate_in * WRITE_5M).otherwise(F.coalesce(F.col("_b_cache_write"), rate_in * WRITE_5M))
    ok = usage_reported() & rate_in.isNotNull()
    put = lambda c: F.when(ok, c)
    cost_in, cost_out = count_of("input_tokens") * rate_in / PER, count_of("output_tokens") * rate_out / PER
    cost_write, cost_read = (F.col("_five") * write5 + F.col("_hour") * (rate_in * WRITE_1H)) / PER, count_of("cache_read_tokens") * read / PER
    x = x.withColumns({
        "cost_input_usd": put(cost_in), "cost_output_usd": put(cost_out), "cost_cache_write_usd": put(cost_write), "cost_cache_read_usd": put(cost_read),
        "cost_total_usd": put(cost_in + cost_out + cost_write + cost_read), "cost_uncached_equiv_usd": put(F.col("_ctx") * rate_in / PER + cost_out),
        "pricing_model_id": put(F.coalesce(F.col("cat_model"), F.col("_local.id"), F.col("model"))), "pricing_version": F.lit(version),
    })
    return x.drop("_five", "_hour", "_ctx", "_local", "cat_provider", "cat_model", *[f"_b_{c}" for c in ("provider", "model_id", "over", "below", *_RATES)])


def reprice(g: DataFrame, models: DataFrame, tiers: DataFrame, local: DataFrame, version: str = RULES_VERSION) -> DataFrame:
    """The same generations at other rates: reads no payload, and what cannot be priced loses its cost."""
    return price(g, models, tiers, local, version).select(*g.columns)


def savings() -> Column:
    """What the cache saved: never negative; null while a cost is unknown."""
    gap = F.col("cost_uncached_equiv_usd") - F.col("cost_total_usd")
    return F.when(gap.isNotNull(), F.greatest(gap, F.lit(0.0)))


def is_priced(g: DataFrame, models: DataFrame, local: DataFrame) -> DataFrame:
    """Adds `priced`: whether the catalogue or a local rate knows the model, whatever its window."""
    rated = models.filter("input IS NOT NULL")
    x = resolve_models(g, rated)
    hit = F.lit(False)
    for r in local_rates(local):
        hit = hit | (F.col("model").startswith(r["id"]) if r["prefix"] else F.col("model") == r["id"])
    return x.withColumn("priced", F.coalesce(F.col("cat_model").isNotNull() | hit, F.lit(False))).drop("cat_provider", "cat_model")
