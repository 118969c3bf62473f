"""Documents to packed token ids: five stages, each over all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import crf_langid, decontaminate, jaccard_join, mixing, packing
from tallyspark.llm.common import written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: null or letterless text, or words of no clear label. Mixed languages stay."""
    known = crf_langid.identify_documents(docs)
    return known.filter((F.col("lang_pred") != "und") & (F.col("certainty") >= 0.5)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of linked ones: that with the smallest id, null last, and of these the least by hashes.

    Rows, not ids, are compared: an id of several rows, or none, neither joins texts nor keeps copies apart.
    """
    rest = [F.col(c) for c in docs.columns if c not in ("doc_id", "text")]
    key = F.struct(F.col("doc_id").isNull().alias("without"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("text"), F.xxhash64(F.lit("row"), "doc_id", "text", *rest).alias("row"))
    keyed = docs.withColumn("__tally_row", key)
    classes = written(jaccard_join.jaccard_classes(keyed.select("__tally_row", "text"), id_col="__tally_row"), "groups")
    first = F.col("__tally_row") == F.col("component_id")
    kept = keyed.join(classes.filter(~first).select("__tally_row").distinct(), "__tally_row", "left_anti")
    # Rows alike in every column have one key: where it stays, one of them does. Texts without words are not copies.
    twice = written(classes.filter(first & (F.col("n_shingles") > 0)).groupBy("__tally_row").count().filter("count > 1").select("__tally_row"), "twice")
    if twice.limit(1).count():
        same = kept.join(twice, "__tally_row", "left_semi").dropDuplicates(["__tally_row"])
        kept = kept.join(twice, "__tally_row", "left_anti").unionByName(same)
    return kept.select(*docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold benchmark passages."""
    out = decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.filter("NOT contaminated").select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draws the sources at flattened weights: large ones lose documents, small ones are read again."""
    return mixing.mix(docs).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the token ids of all texts."""
    return packing.pack_documents(docs)


STAGES = [("language_id", language_id), ("ngram_jaccard_join", near_duplicates), ("decontamination", decontaminated), ("mixing", mixed), ("packing", packed)]

#: The stages fit a model and tokenise: SQL cannot say them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
