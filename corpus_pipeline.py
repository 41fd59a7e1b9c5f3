"""A training corpus from raw documents: rules, near duplicates, personal data, mixing, encoding.

Each stage takes what its predecessor kept and is written before the next one reads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from riskframe.llm import mixing, near_dedup, pieces, pii, quality_rules
from riskframe.llm.common import prepared, stored

# no SQL: compression, hash minima, a trained field and merges are beyond it
ORACLE_SQL = None


def _sized(docs: DataFrame) -> DataFrame:
    """``n_chars`` of the text as it now is, where documents have that column."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep. Null, empty and too short texts go."""
    prepared(spark)
    return docs.withColumn("quality_", quality_rules.quality("text")).filter("quality_.kept").drop("quality_")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every near-duplicate group.

    Of rows with one id and one text one stays. Different texts under one id are documents of their own: the first by a
    hash of the text has the id, each other one counts with a number made from id and text, larger than any id in use.
    So does a row without id, with one made from its text: it stays only where no document with an id is its near
    duplicate.
    """
    prepared(spark)
    named = docs.withColumns({"no_": F.col("doc_id").cast("long"), "text_": F.xxhash64(F.coalesce("text", F.lit("")))})
    several = named.filter("no_ is not null").groupBy("no_").agg(F.min("text_").alias("x_"), F.max("text_").alias("y_")).filter("x_ < y_")
    several = stored(several.select(F.col("no_").alias("of_"), F.col("x_").alias("first_")), "pipeline-several")
    few = several.limit(near_dedup.BROADCAST_IDS + 1).count() <= near_dedup.BROADCAST_IDS
    named = named.join(F.broadcast(several) if few else several, F.col("no_") == F.col("of_"), "left")
    number = F.lit(1 << 62) + F.when(F.col("no_").isNull(), F.col("text_")).otherwise(F.xxhash64("no_", "text_")).bitwiseAND((1 << 61) - 1)
    stays = F.col("no_").isNotNull() & (F.col("of_").isNull() | (F.col("text_") == F.col("first_")))
    named = named.withColumn("id_", F.when(stays, F.col("no_")).otherwise(number)).drop("no_", "text_", "of_", "first_")
    groups = stored(near_dedup.near_duplicates(named, "id_", "text").select("id_", "kept"), "pipeline-groups")
    kept = near_dedup.with_ids(named, groups.filter("not kept").select("id_").distinct(), "id_", "left_anti")
    repeated = stored(groups.filter("kept").groupBy("id_").count().filter("count > 1").select("id_"), "pipeline-repeated")
    if not repeated.isEmpty():
        order = W.partitionBy("id_").orderBy(F.xxhash64("text"), "text")
        several = near_dedup.with_ids(kept, repeated, "id_").withColumn("place_", F.row_number().over(order)).filter("place_ = 1")
        kept = near_dedup.with_ids(kept, repeated, "id_", "left_anti").unionByName(several.drop("place_"))
    return kept.select(*docs.columns)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every span of personal data replaced by its kind in brackets."""
    prepared(spark)
    return _sized(docs.withColumn("text", pii.redacted(pii.fit(docs), "text"))).select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources in their target shares: documents left out, taken once, several times, or in part."""
    prepared(spark)
    return _sized(mixing.mixed_documents(docs)).select(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, n_pieces, ids, round_trip) of every row of the mix."""
    prepared(spark)
    found = docs.select("doc_id", "source", pieces.encoded(pieces.read_model(), "text").alias("x"))
    return found.select("doc_id", "source", "x.n_pieces", "x.ids", "x.round_trip")


STAGES = [
    ("quality_rules", quality),
    ("near_dedup", one_of_each_group),
    ("pii", without_personal_data),
    ("mixing", mixed),
    ("sentencepiece", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
