"""Most recent rows, metric history and sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from riskframe.operators.order import hash_range, running_sums


def recent_scores(log: DataFrame, version: str, n: int, tie: str = "request_id") -> DataFrame:
    """The latest n scores of a model version (a bounded heap per partition)."""
    return (
        log.where(F.col("model_version") == version)
        .orderBy(F.col("scored_at").desc(), F.col(tie).desc())
        .limit(n)
        .select(tie, "scored_at", "score")
    )


def _logged(log: DataFrame, version: str, column: str, since: Column | None, until: Column | None) -> DataFrame:
    rows = log.where(F.col("model_version") == version)
    if since is not None:
        rows = rows.where(F.col(column) >= since)
    return rows if until is None else rows.where(F.col(column) < until)


def logged_scores(
    log: DataFrame, version: str, features: list[str] = (), since: Column | None = None, until: Column | None = None,
) -> DataFrame:
    """All scores of a model version in the caller's time window, by default the whole log, with their snapshots'
    values of the features; absent keys give NULL."""
    rows = _logged(log, version, "scored_at", since, until)
    return rows.select("score", *[F.try_element_at("feature_snapshot", F.lit(f)).alias(f) for f in features])


def logged_outcomes(log: DataFrame, version: str, since: Column | None = None, until: Column | None = None) -> DataFrame:
    """All scores of a model version with an outcome observed in the window, as (score, label)."""
    rows = _logged(log, version, "outcome_observed_at", since, until).where("actual_default is not null")
    return rows.select("score", F.col("actual_default").cast("int").alias("label"))


def recent_snapshots(log: DataFrame, version: str, n: int, features: list[str], tie: str = "request_id") -> DataFrame:
    """The latest n snapshots with one column per feature; absent keys give NULL."""
    return (
        log.where(F.col("model_version") == version)
        .orderBy(F.col("scored_at").desc(), F.col(tie).desc())
        .limit(n)
        .select(tie, *[F.try_element_at("feature_snapshot", F.lit(f)).alias(f) for f in features])
    )


def recent_outcomes(log: DataFrame, version: str, n: int, tie: str = "request_id") -> DataFrame:
    """The latest n scores whose outcome is known, as (score, label)."""
    return (
        log.where((F.col("model_version") == version) & F.col("actual_default").isNotNull())
        .orderBy(F.col("outcome_observed_at").desc(), F.col(tie).desc())
        .limit(n)
        .select(tie, "score", F.col("actual_default").cast("int").alias("label"))
    )


def metric_history(drift_log: DataFrame, metric: str, n: int) -> DataFrame:
    """The latest n rows of a metric, oldest first."""
    latest = (
        drift_log.where(F.col("metric_name") == metric)
        .orderBy(F.col("measured_at").desc(), F.col("model_version").desc())
        .limit(n)
    )
    return latest.orderBy("measured_at", "model_version")


def latest_metrics(drift_log: DataFrame) -> DataFrame:
    """The latest row of every metric."""
    newest = F.max(F.struct("measured_at", "model_version", "metric_value"))
    return drift_log.groupBy("metric_name").agg(newest.alias("m")).select("metric_name", "m.*")


def metric_details(drift_log: DataFrame, field: str = "csi") -> DataFrame:
    """The name -> value map under ``field`` of the JSON details, one row per entry."""
    parsed = F.from_json("details", f"{field} map<string,double>")
    return drift_log.select(
        "metric_name", "measured_at", "model_version", F.explode(parsed[field]).alias("feature", "value")
    ).orderBy(F.col("value").desc(), "feature")


def distinct_ids(store: DataFrame, n: int) -> DataFrame:
    return store.select("applicant_id").distinct().orderBy("applicant_id").limit(n)


def seeded_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """Exactly min(n, rows) rows, the same ones on every run.

    Rows are taken in the order of a hash of the unique key. Counts per hash
    slice locate the cut; only the slice that holds it is ordered.
    """
    bits = 16
    hashed = df.withColumn("__h", F.xxhash64(F.lit(seed), F.col(key)))
    sliced = hashed.withColumn("__slice", F.shiftrightunsigned("__h", 64 - bits))
    # 2**16 slices at most, so the running total is bounded
    counts = sliced.groupBy("__slice").agg(F.count(F.lit(1)).alias("c"))
    lower = Window.partitionBy(F.lit(0)).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    cut = (
        counts.withColumn("below", F.coalesce(F.sum("c").over(lower), F.lit(0)))
        .where(F.col("below") < n)
        .agg(F.max(F.struct("__slice", "below")).alias("cut"))
        .select("cut")
    )
    at = cut.scalar()
    # the slice that holds the cut is cut again by its next bits; only one part of it is ordered
    part = F.shiftrightunsigned(F.shiftleft("__h", bits), 64 - bits)
    inside = sliced.where(F.col("__slice") == at["__slice"]).withColumn("__part", part)
    below_part = Window.partitionBy(F.lit(0)).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = inside.groupBy("__part").agg(F.count(F.lit(1)).alias("c"))
    fine = (
        parts.withColumn("below", at["below"] + F.coalesce(F.sum("c").over(below_part), F.lit(0)))
        .where(F.col("below") < n)
        .agg(F.max(F.struct("__part", "below")).alias("cut"))
        .select("cut")
    ).scalar()
    order = Window.partitionBy("__part").orderBy("__h", key)
    marked = sliced.where(F.col("__slice") <= at["__slice"]).withColumn("__part", part)
    whole = marked.where((F.col("__slice") < at["__slice"]) | (F.col("__part") < fine["__part"]))
    edge = marked.where((F.col("__slice") == at["__slice"]) & (F.col("__part") == fine["__part"]))
    held = edge.withColumn("__r", F.row_number().over(order)).where(F.col("__r") + fine["below"] <= n)
    return whole.select(*df.columns).unionByName(held.select(*df.columns))


def row_positions(df: DataFrame, key: str, seed: int, groups: list[str] = (), group_limit: int | None = None) -> DataFrame:
    """Add a 0-based random-order ``position`` and the group ``size``; the key is unique."""
    groups = list(groups)
    marked = df.withColumn("__h", F.xxhash64(F.lit(seed), F.col(key))).withColumn("__one", F.lit(1).cast("bigint"))
    placed = running_sums(marked, "__h", ["__one"], groups, group_limit, index=hash_range(df, "__h"))
    return placed.withColumnsRenamed({"__one_before": "position", "__one_total": "size"}).drop("__h", "__one")
