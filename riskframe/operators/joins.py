"""Outcome backfill, feature lookup, admissibility and idempotent publishing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from riskframe.contract import DEFAULT, Contract
from riskframe.functions.parsing import loan_id


def older_than(ts: Column, now: Column, days: int) -> Column:
    return ts < now - F.make_dt_interval(F.lit(days))


def pending_applicants(log: DataFrame, now: Column, delay_days: int) -> DataFrame:
    """Distinct applicants with an unresolved decision older than the delay."""
    return (
        log.where(F.col("actual_default").isNull() & older_than(F.col("scored_at"), now, delay_days))
        .select("applicant_id")
        .distinct()
    )


def loan_labels(outcomes: DataFrame) -> DataFrame:
    """(loan_id, label), one row per loan id with a label; where a loan has several, a default counts."""
    rows = outcomes.select(F.col("id").cast("bigint").alias("loan_id"), F.col("label").cast("boolean").alias("label"))
    return rows.where("loan_id is not null and label is not null").groupBy("loan_id").agg(F.max("label").alias("label"))


def matched_outcomes(pending: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Pending applicants with the label found under their loan id (one row per applicant)."""
    return pending.withColumn("loan_id", loan_id(F.col("applicant_id"))).join(loan_labels(outcomes), "loan_id").select("applicant_id", "label")


def backfill_outcomes(log: DataFrame, outcomes: DataFrame, now: Column, delay_days: int = 0) -> DataFrame:
    """The log with every unresolved row of a matched applicant labelled and stamped.

    Applicants and outcomes are reduced to one row each before they meet, so no
    row of the log is repeated. Resolved rows pass by the join back to the log,
    whose skew is left to the adaptive split.
    """
    found = matched_outcomes(pending_applicants(log, now, delay_days), outcomes)
    open_ = log.where(F.col("actual_default").isNull())
    return log.where(F.col("actual_default").isNotNull()).unionByName(labelled_rows(open_, found, now))


def labelled_rows(open_rows: DataFrame, found: DataFrame, now: Column) -> DataFrame:
    """Open rows with the outcome of their applicant, where one was found, and the time it was seen."""
    joined = open_rows.join(found.withColumnRenamed("label", "__label"), "applicant_id", "left")
    seen = F.when(F.col("__label").isNotNull(), now).otherwise(F.col("outcome_observed_at"))
    return joined.withColumns({"outcome_observed_at": seen, "actual_default": F.col("__label")}).select(*open_rows.columns)


def backfill_report(log: DataFrame, outcomes: DataFrame, now: Column, delay_days: int = 0) -> DataFrame:
    """pending, matched and skipped applicants, and the log rows that change."""
    open_rows = log.where(F.col("actual_default").isNull()).groupBy("applicant_id").agg(
        F.count(F.lit(1)).alias("open_rows"),
        F.max(older_than(F.col("scored_at"), now, delay_days)).alias("due"),
    ).where("due")
    joined = open_rows.withColumn("loan_id", loan_id(F.col("applicant_id"))).join(loan_labels(outcomes), "loan_id", "left")
    hit = F.col("label").isNotNull()
    return joined.agg(
        F.count(F.lit(1)).alias("pending_applicants"),
        F.count_if(hit).alias("matched_applicants"),
        F.count_if(~hit).alias("skipped_unmatched"),
        F.coalesce(F.sum(F.when(hit, F.col("open_rows"))), F.lit(0)).alias("rows_updated"),
    )


SNAPSHOT = ["feature_version", "computed_at", "features", "data_completeness", "fico_score", "grade"]
STORE_ROWS_PER_TASK, REQUESTS_PER_TASK = 100_000, 500_000  # a snapshot takes about 1.5 KB of a task's memory
FEW_APPLICANTS = 100_000  # so many are broadcast to the store


def lookup_parts(width: int, requests: int, stored: int) -> int:
    """How many tasks share a lookup: the shuffle width, more if a task would hold too many snapshots or requests."""
    return max(width, stored // STORE_ROWS_PER_TASK, requests // REQUESTS_PER_TASK)


def lookup_features(requests: DataFrame, store: DataFrame, version: int) -> DataFrame:
    """Requests with their stored snapshot and a status: found, not_found, version_missing.

    Version 0 asks for the latest stored version; an exact one is filtered in
    the scan. The store has one row per applicant and version. Requests and their
    applicants are counted: of few applicants only their rows of the store go
    on, for many the store is counted too, and both sides are cut by applicant
    into as many parts as their rows need. A snapshot moves and is sorted once,
    and columns that the caller does not read do not move.
    """
    width = int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked = requests.agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("applicant_id").alias("applicants")).first()
    few = asked["applicants"] <= FEW_APPLICANTS
    if few:
        store = store.join(F.broadcast(requests.select("applicant_id").distinct()), "applicant_id", "left_semi")
    parts = lookup_parts(width, asked["n"], 0 if few else store.count())
    # cut like the requests, or the join would bring both to the shuffle width
    known = store.select("applicant_id").repartition(parts, "applicant_id").groupBy("applicant_id").agg(F.lit(True).alias("__known"))
    snapshots = store
    if version:
        snapshots = store.where(F.col("feature_version") == version)
    else:
        latest = F.max("feature_version").over(Window.partitionBy("applicant_id"))
        snapshots = store.repartition(parts, "applicant_id").withColumn("__latest", latest).where("feature_version = __latest")
    held = snapshots.select("applicant_id", F.lit(True).alias("__held"), *[F.col(c).alias(f"__snapshot_{c}") for c in SNAPSHOT])
    joined = requests.repartition(parts, "applicant_id").join(known, "applicant_id", "left").join(held, "applicant_id", "left")
    return joined.select(
        *requests.columns,
        F.when(F.col("__known").isNull(), "not_found")
        .when(F.col("__held").isNull(), "version_missing")
        .otherwise("found")
        .alias("status"),
        *[F.col(f"__snapshot_{c}").alias(c) for c in SNAPSHOT],
    )


def admissibility(
    looked_up: DataFrame, features: list[str], now: Column, model_feature_version: int,
    contract: Contract = DEFAULT,
) -> DataFrame:
    """Refine ``status`` of found snapshots: stale, version_mismatch, feature_missing or ok.

    A feature that is stored as NULL is admissible, an absent one is not.
    """
    age_hours = (F.unix_micros(now) - F.unix_micros(F.col("computed_at"))) / 3.6e9
    absent = F.array_except(
        F.array(*[F.lit(f) for f in features]), F.map_keys("features")
    )
    return looked_up.withColumn(
        "status",
        F.when(F.col("status") != "found", F.col("status"))
        .when(age_hours > contract.staleness_hours, "stale")
        .when(
            (F.lit(model_feature_version) != 0)
            & (F.col("feature_version") != 0)
            & (F.col("feature_version") != model_feature_version),
            "version_mismatch",
        )
        .when(F.size(absent) > 0, "feature_missing")
        .otherwise("ok"),
    )


def unpublished(candidates: DataFrame, log: DataFrame) -> DataFrame:
    """Candidates whose (metric_name, model_version) is not in the log yet."""
    return candidates.join(
        log.select("metric_name", "model_version").distinct(), ["metric_name", "model_version"], "left_anti"
    )


def with_validation(train: DataFrame, validation: DataFrame) -> DataFrame:
    """Training rows followed by validation rows, by column name."""
    return train.unionByName(validation)


def augmented_rows(accepted: DataFrame, rejected: DataFrame, validation: DataFrame, weight: float = 0.3) -> DataFrame:
    """Observed rows at weight 1 and pseudo-labelled rows at the given weight, flagged."""

    def tagged(df, w, pseudo):
        return df.withColumn("weight", F.lit(w)).withColumn("is_pseudo", F.lit(pseudo))

    return (
        tagged(accepted, 1.0, False)
        .unionByName(tagged(rejected, weight, True))
        .unionByName(tagged(validation, 1.0, False))
    )


def retained(log: DataFrame, now: Column, days: int, ts: str = "scored_at") -> DataFrame:
    """Rows inside the retention window."""
    if days <= 0:
        raise ValueError("retention must be a positive number of days")
    return log.where(~F.coalesce(older_than(F.col(ts), now, days), F.lit(False)))


def retention_report(log: DataFrame, now: Column, days: int, ts: str = "scored_at") -> DataFrame:
    if days <= 0:
        raise ValueError("retention must be a positive number of days")
    return log.agg(
        F.lit(days).alias("retention_days"),
        F.count_if(older_than(F.col(ts), now, days)).alias("rows_deleted"),
    )
