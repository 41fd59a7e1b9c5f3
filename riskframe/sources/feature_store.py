"""Versioned applicant snapshots and training histograms."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from riskframe.functions.binning import linspace
from riskframe.functions.parsing import applicant_id, clean
from riskframe.functions.numeric import round_away
from riskframe.operators.distributions import histogram
from riskframe.operators.order import small_table
from riskframe.sources.versions import Manifest, VersionedTable

KEY = ["applicant_id", "feature_version"]


def check_contract(
    gold_version: int, model_version: int, gold_features: list[str], model_features: list[str]
) -> None:
    """Refuse to publish features a model was not built for; version 0 reads as 1."""
    if (gold_version or 1) != (model_version or 1):
        raise ValueError(f"feature version {gold_version} does not match model feature version {model_version}")
    if list(gold_features) != list(model_features):
        raise ValueError("feature columns do not match the model")


def snapshots(gold: DataFrame, features: list[str], version: int, computed_at: Column) -> DataFrame:
    """One row per loan with its features as a map and the share that is present."""
    values = [clean(F.col(f)) for f in features]
    present = sum((v.isNotNull().cast("int") for v in values), F.lit(0))
    return gold.select(
        F.when(F.col("id").isNull(), F.raise_error(F.lit("row has no loan id")))
        .otherwise(applicant_id(F.col("id")))
        .alias("applicant_id"),
        F.lit(version).alias("feature_version"),
        computed_at.alias("computed_at"),
        F.map_from_arrays(
            F.array(*[F.lit(f) for f in features]), F.array(*values)
        ).alias("features"),
        round_away(present / len(features), 3).alias("data_completeness"),
        clean(F.col("fico_score")).cast("int").alias("fico_score"),
        clean(F.col("grade_numeric")).cast("int").alias("grade"),
    )


def latest_rows(batch: DataFrame) -> DataFrame:
    """One row per key: the latest ``computed_at``, then the larger hash of the row.

    Keys that occur once, as a rule nearly all, are not grouped: only the keys are counted, and the rows of repeated ones
    meet. These keys are broadcast when there are few, by a count.
    """
    repeated = small_table(batch.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*[F.col(k).alias(f"__{k}") for k in KEY]))
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in KEY])
    payload = F.struct(*[c for c in batch.columns if c not in KEY])
    latest = (
        batch.join(repeated, same, "left_semi")
        .groupBy(*KEY)
        .agg(F.max_by(payload, F.struct("computed_at", F.xxhash64(F.to_json(payload)))).alias("r"))
        .select(*KEY, "r.*")
    )
    return batch.join(repeated, same, "left_anti").unionByName(latest.select(*batch.columns))


def upsert(store: DataFrame, batch: DataFrame) -> DataFrame:
    """The store after a batch: a batch row replaces the stored row of its key.

    Only the batch is reduced to one row per key (latest ``computed_at``, then
    the larger hash of the row); the store is filtered by an anti join and not
    regrouped.
    """
    kept = store.join(batch.select(*KEY), KEY, "left_anti")
    return kept.unionByName(latest_rows(batch).select(*store.columns))


def feature_table(spark: SparkSession, path: str) -> VersionedTable:
    """The snapshots on disk, one partition per feature version."""
    return VersionedTable(spark, path, "feature_version")


def write_upsert(table: VersionedTable, batch: DataFrame) -> Manifest:
    """Upsert a batch: only the feature versions in it are read and written anew, all others stay where they are.

    The batch is read for its versions, its repeated keys and its rows. Readers see the store before or after it. An empty
    batch makes no version.
    """
    base = table.manifest()
    touched = table.touched_by(batch)
    if not touched:
        return base
    old = table.read(touched, base.number) if base.schema else batch.limit(0)
    return table.replace(upsert(old.select(*batch.columns), batch), touched, base)


def training_distribution(scored: DataFrame, score: str, model_version: str, bins: int = 10) -> DataFrame:
    """One row per model: bin edges on [0, 1], counts per bin and the row count."""
    edges = linspace(0.0, 1.0, bins + 1)
    counts = histogram(scored, score, edges)
    total = scored.agg(F.count(F.lit(1))).scalar()
    return counts.agg(
        F.array_sort(F.collect_list(F.struct("bin", "count"))).alias("rows")  # one row per bin
    ).select(
        F.lit(model_version).alias("model_version"),
        F.lit(edges).alias("bin_edges"),
        F.col("rows.count").alias("bin_counts"),
        total.alias("total_count"),
    )


def feature_metadata(split_rows: DataFrame, categories: DataFrame, features: list[str], version: int) -> DataFrame:
    """One JSON document: columns, version, rows and default rate per split, encodings."""
    splits = split_rows.groupBy("split").agg(
        F.count(F.lit(1)).alias("rows"),
        round_away(F.avg(F.col("default").cast("double")), 4).alias("default_rate"),
    ).agg(
        F.expr("map_from_entries(array_sort(collect_list(struct(split, struct(rows, default_rate)))))").alias("splits")
    )
    encodings = (
        categories.groupBy("column")
        .agg(F.expr("map_from_entries(array_sort(collect_list(struct(category, code))))").alias("codes"))
        .agg(F.expr("map_from_entries(collect_list(struct(column, codes)))").alias("e"))
        .scalar()
    )
    return splits.select(
        F.to_json(
            F.struct(
                F.lit(list(features)).alias("feature_columns"),
                F.lit(len(features)).alias("n_features"),
                F.lit(version).alias("feature_version"),
                F.lit("default").alias("target"),
                F.col("splits"),
                encodings.alias("categorical_encodings"),
            )
        ).alias("metadata")
    )
