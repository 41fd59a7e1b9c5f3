"""Append-only decision and metric logs on partitioned Parquet."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from riskframe.operators.joins import labelled_rows, matched_outcomes, pending_applicants, retained
from riskframe.session import scratch_path
from riskframe.sources.layers import list_partitions, remove_directory
from riskframe.sources.versions import VersionedTable


def metric_row(metrics: DataFrame, name: str, value: str, model_version: str, measured_at: Column, details: Column) -> DataFrame:
    """A row of the metric log; the details become JSON."""
    return metrics.select(
        measured_at.alias("measured_at"),
        F.lit(name).alias("metric_name"),
        F.col(value).cast("decimal(8,5)").alias("metric_value"),
        F.lit(model_version).alias("model_version"),
        F.to_json(details).alias("details"),
    )


def append_metrics(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def append_decisions(rows: DataFrame, path: str) -> None:
    """Append decision envelopes, one partition per scoring date.

    The rebalance step gathers a day into few files and splits a busy day by
    its measured size.
    """
    (
        rows.withColumns(
            {
                "score": F.col("score").cast("decimal(6,5)"),
                "calibrated_pd": F.col("calibrated_pd").cast("decimal(6,5)"),
                "scored_date": F.to_date("scored_at"),
            }
        )
        .hint("rebalance", F.col("scored_date"))
        .write.mode("append")
        .partitionBy("scored_date")
        .parquet(path)
    )


def decision_table(spark: SparkSession, path: str) -> VersionedTable:
    """A decision log whose days can be rewritten, one partition per scoring date."""
    return VersionedTable(spark, path, "scored_date")


def write_backfill(table: VersionedTable, outcomes: DataFrame, now: Column, delay_days: int = 0) -> int:
    """Label the open rows of matured applicants in a stored log and return how many days were rewritten.

    Which applicants are due and which days hold open rows of theirs comes from a scan of three columns; only those days are read
    whole and written anew, all others stay where they are. Without a match no version is made.
    """
    base = table.manifest()
    log = table.read(number=base.number)
    path = scratch_path(table.spark, "backfill")
    matched_outcomes(pending_applicants(log, now, delay_days), outcomes).write.parquet(path)
    found = table.spark.read.schema("applicant_id string, label boolean").parquet(path)
    open_ = log.where("actual_default is null")
    days = table.touched_by(open_.join(found, "applicant_id", "left_semi").select("scored_date"))
    if days:
        old = table.read(days, base.number)
        done = labelled_rows(old.where("actual_default is null"), found, now)
        table.replace(old.where("actual_default is not null").unionByName(done), days, base)
    remove_directory(table.spark, path)
    return len(days)


def prune_decisions(spark: SparkSession, path: str, now: datetime, days: int) -> int:
    """Delete decisions older than the window and return how many.

    Whole days before the boundary are dropped as directories; only the
    boundary day is rewritten.
    """
    if days <= 0:
        raise ValueError("retention must be a positive number of days")
    boundary = now - timedelta(days=days)
    day = boundary.date().isoformat()
    expired = [d for d in list_partitions(spark, path, "scored_date") if d < day]
    log = spark.read.parquet(path)
    removed = log.where(F.col("scored_date") < F.lit(day).cast("date")).count() if expired else 0
    edge = log.where(F.col("scored_date") == F.lit(day).cast("date"))
    kept = retained(edge, F.lit(now).cast("timestamp"), days)
    counts = edge.agg(F.count(F.lit(1)).alias("n")).first()["n"], kept.count()
    if counts[0] != counts[1]:
        removed += counts[0] - counts[1]
        if counts[1]:
            # dynamic overwrite replaces this one partition; its rows are cut loose first
            held = kept.checkpoint() if spark.sparkContext.getCheckpointDir() else None
            if held is None:
                side = scratch_path(spark, "prune")
                kept.write.parquet(side)
                held = spark.read.parquet(side)
            held.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
                "scored_date"
            ).parquet(path)
        else:
            expired.append(day)
    for d in expired:
        remove_directory(spark, f"{path}/scored_date={d}")
    return removed
