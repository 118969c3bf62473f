"""What readers of live tables get without reading them whole: totals kept by day, pages by time, the change feed as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.plans import surfaces
from tallyspark.streaming.versions import latest_days, read_parts, read_table, write_parts

#: By what totals are kept; sums of all else that cost_by() shows.
AXES = ("provider", "model", "session_id", "agent_name")
SUMS = ("input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens", "cost_input_usd", "cost_output_usd", "cost_cache_write_usd", "cost_cache_read_usd", "cost_total_usd")


def partials(g: DataFrame) -> DataFrame:
    """Additive totals of calls by day and AXES."""
    day = F.coalesce(F.date_format("started_at", "yyyy-MM-dd"), F.lit("0000-00-00")).alias("part")
    return g.groupBy(day, *AXES).agg(
        F.count("*").alias("generations"), *[F.sum(c).alias(c) for c in SUMS], F.sum(F.coalesce("cost_uncached_equiv_usd", F.lit(0.0))).alias("uncached"), F.count("cost_total_usd").alias("priced"),
        F.sum(F.col("is_error").cast("long")).alias("errors"), F.min("started_at").alias("first_seen"), F.max("started_at").alias("last_seen"))


def refresh_totals(spark: SparkSession, root: str, version: int) -> None:
    """Makes the totals of those days anew whose calls this version wrote or removed: late, repeated and repriced calls are in them as they stand."""
    now, was = latest_days(spark, root, "generations"), latest_days(spark, root, "generations", version)
    touched = {d for d in now if now[d] != was.get(d)} | {d for d in was if d not in now}
    if touched or not was:
        write_parts(spark, root, "totals", version, partials(read_parts(spark, root, "generations", None, touched)), touched)


def cost_by(spark: SparkSession, root: str, axis: str = "model") -> DataFrame:
    """surfaces.cost_by() of the live calls, from their totals."""
    if axis not in surfaces.AXES:
        raise ValueError(f"unknown group_by {axis!r}; accepted: {', '.join(surfaces.AXES)}")
    bucket = F.to_date("first_seen").cast("string") if axis == "day" else F.col(surfaces.AXES[axis])
    saved = F.greatest(F.lit(0.0), F.sum("uncached") - F.sum(F.coalesce("cost_total_usd", F.lit(0.0))))
    x = read_table(spark, root, "totals").withColumn("bucket", bucket).filter("bucket IS NOT NULL")
    return x.groupBy("bucket").agg(F.sum("generations").alias("generations"), *[F.sum(c).alias(c) for c in SUMS], saved.alias("cache_savings_usd"), (F.sum("priced") / F.sum("generations")).alias("priced_share"))


def read_page(spark: SparkSession, root: str, name: str, at: str, tie: str, cursor: str | None = None, limit=None) -> DataFrame:
    """A keyset page of a live table, newest first, before the cursor (a UTC time).

    Days are read from the cursor's backwards, one, then four, then sixteen .., until they fill the page: what is read
    follows the page, not the table. Rows without a time are in no page after the first.
    """
    days = sorted((d for d in latest_days(spark, root, name) if not cursor or d <= cursor[:10]), reverse=True)
    take = 1
    while True:
        some = read_parts(spark, root, name, None, set(days[:take]))
        got = surfaces.page(some, at, tie, cursor, limit)
        if take >= len(days) or got.count() >= surfaces.page_limit(limit):
            return got
        take *= 4


CHANGES = "batch long, seq long, kind string, call_id long, session_id string, trace_id string"


def change_stream(spark: SparkSession, root: str, max_files: int = 100) -> DataFrame:
    """The change feed as a stream. A reader's checkpoint is its offset: started again it goes on where it stopped."""
    return spark.readStream.schema(CHANGES).option("maxFilesPerTrigger", max_files).option("recursiveFileLookup", "true").parquet(f"{root}/changes")


def feed_gaps(events: DataFrame) -> DataFrame:
    """(batch, kind, expected, found): where a reader's events of a batch are not all of 1..n, each once."""
    x = events.groupBy("batch", "kind").agg(F.max("seq").alias("expected"), F.count("*").alias("found"), F.count_distinct("seq").alias("different"))
    return x.filter("expected <> found OR expected <> different").drop("different")
