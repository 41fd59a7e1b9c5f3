"""Raw files to gold splits, each layer computed once, checked, and kept once complete."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from riskframe.functions.tables import FEATURES
from riskframe.operators.gold import FEATURE_VERSION, fit_categories, gold_features, home_group, time_split
from riskframe.operators.quality import bronze_checks, gold_checks, null_fractions, silver_checks
from riskframe.operators.silver import silver_loans, silver_rejected
from riskframe.contract import DEFAULT
from riskframe.sources.feature_store import feature_metadata
from riskframe.sources.layers import is_complete, read_raw_csv, write_checked, write_once


def bronze(spark: SparkSession, csv: str, columns: list[str], root: str, name: str, now: datetime,
           strict: bool = False, partitions: int | None = None, multi_line: bool | None = None) -> DataFrame:
    path = f"{root}/bronze/{name}"
    if not is_complete(spark, path):
        raw = read_raw_csv(spark, csv, columns, now, partitions, multi_line)
        write_checked(raw, path, bronze_checks, f"bronze {name}", strict)
    return spark.read.parquet(path)


def null_checks(df: DataFrame) -> DataFrame:
    """The null-fraction gate as a suite: one row per column."""
    return null_fractions(df).select(
        F.concat(F.col("feature"), F.lit("_mostly_present")).alias("expectation"),
        (F.col("null_fraction") <= DEFAULT.max_null_fraction).alias("success"),
        F.col("null_fraction").cast("string").alias("observed"),
    )


def silver(spark: SparkSession, bronze_rows: DataFrame, root: str, strict: bool = False) -> DataFrame:
    path = f"{root}/silver/accepted"
    if not is_complete(spark, path):
        suites = [("silver", None, silver_checks), ("silver nulls", None, null_checks)]
        write_checked(silver_loans(bronze_rows), path, suites, "silver", strict)
    return spark.read.parquet(path)


def rejected(spark: SparkSession, bronze_rows: DataFrame, root: str) -> DataFrame:
    path = f"{root}/silver/rejected"
    write_once(silver_rejected(bronze_rows), path)
    return spark.read.parquet(path)


def gold(spark: SparkSession, silver_rows: DataFrame, root: str, strict: bool = False) -> DataFrame:
    """Gold splits partitioned by ``split``, the stored encodings and the metadata document."""
    path = f"{root}/gold/features"
    if not is_complete(spark, path):
        encodings = f"{root}/gold/encodings"
        grouped = silver_rows.withColumn("home_ownership", home_group(F.col("home_ownership")))
        write_once(fit_categories(grouped), encodings)
        categories = spark.read.parquet(encodings)
        splits = time_split(gold_features(silver_rows, categories))
        suites = [(f"gold {s}", f"split = '{s}'", gold_checks) for s in ("train", "val", "test")]
        write_checked(splits, path, suites, "gold", strict, ["split"])
        feature_metadata(
            spark.read.parquet(path), categories, list(FEATURES), FEATURE_VERSION
        ).write.mode("overwrite").text(f"{root}/gold/metadata")
    return spark.read.parquet(path)
