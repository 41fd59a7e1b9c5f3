"""Log, join, history, set and retention queries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from checks import sql as Q, views as V
from riskframe.functions.numeric import round_away
from checks.registry import query, rounded, stamp
from riskframe.functions.binning import linspace
from riskframe.functions.tables import FEATURES
from riskframe.operators import distributions as S, fairness as X, history as H, joins as J
from riskframe.session import scratch_path
from riskframe.sources import logs as L

DELAY = 30
RETAINED_DAYS = 30


def r(x: str, n: int = 6) -> str:
    return f"round({x}, {n})"


def text(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S')"


# ---------------------------------------------------------------- appends

@query("s7_append_metrics", Q.build(["drift_log"], """
SELECT metric_name, CAST(metric_value AS DOUBLE) AS metric_value, model_version FROM drift_log"""))
def append_metrics(spark, d):
    path = scratch_path(spark, "metric-log")
    rows = V.drift_log(spark, d)
    for half in (rows.where("metric_name < 'f'"), rows.where("metric_name >= 'f'")):
        L.append_metrics(half.withColumn("metric_value", F.col("metric_value").cast("decimal(8,5)")), path)
    return spark.read.parquet(path).select("metric_name", F.col("metric_value").cast("double").alias("metric_value"), "model_version")


@query("s8_append_decisions", Q.build(["scoring_log"], f"""
SELECT request_id, applicant_id, round(score, 5) AS score, decision, strftime(scored_at, '%Y-%m-%d') AS scored_date FROM scoring_log"""))
def append_decisions(spark, d):
    path = scratch_path(spark, "decision-log")
    L.append_decisions(V.scoring_log(spark, d).withColumn("calibrated_pd", F.lit(None).cast("double")), path)
    return spark.read.parquet(path).select(
        "request_id", "applicant_id", F.col("score").cast("double").alias("score"), "decision",
        F.date_format("scored_date", "yyyy-MM-dd").alias("scored_date"))


# ---------------------------------------------------------------- joins

NOW = f"TIMESTAMP '{V.NOW}'"
PENDING = f"SELECT DISTINCT applicant_id FROM scoring_log WHERE actual_default IS NULL AND scored_at < {NOW} - INTERVAL {DELAY} DAY"
MATCHED = "SELECT p.applicant_id, o.label FROM pending p JOIN outcomes o ON o.id = TRY_CAST(substr(p.applicant_id, 4) AS BIGINT)"


@query("j1_backfill_outcomes", Q.build(["scoring_log", "outcomes"], f"""
SELECT request_id, applicant_id, coalesce(actual_default, label) AS actual_default,
  {text(f'CASE WHEN actual_default IS NULL AND label IS NOT NULL THEN {NOW} ELSE outcome_observed_at END')} AS outcome_observed_at
FROM scoring_log LEFT JOIN matched USING (applicant_id)""", {"pending": PENDING, "matched": MATCHED}))
def backfill(spark, d):
    """Read back from a stored log after the days with matured rows were written anew."""
    table = L.decision_table(spark, scratch_path(spark, "decisions"))
    table.append(V.scoring_log(spark, d).withColumn("scored_date", F.to_date("scored_at")))
    L.write_backfill(table, V.outcomes(spark, d), V.now(), DELAY)
    return table.read().select("request_id", "applicant_id", "actual_default", stamp("outcome_observed_at"))


@query("j2_backfill_report", Q.build(["scoring_log", "outcomes"], """
SELECT (SELECT count(*) FROM pending) AS pending_applicants, (SELECT count(*) FROM matched) AS matched_applicants,
  (SELECT count(*) FROM pending) - (SELECT count(*) FROM matched) AS skipped_unmatched,
  (SELECT count(*) FROM scoring_log JOIN matched USING (applicant_id) WHERE actual_default IS NULL) AS rows_updated""",
                                     {"pending": PENDING, "matched": MATCHED}))
def backfill_report(spark, d):
    return J.backfill_report(V.scoring_log(spark, d), V.outcomes(spark, d), V.now(), DELAY)


LOOKED = """SELECT r.*, CASE WHEN k.applicant_id IS NULL THEN 'not_found' WHEN s.applicant_id IS NULL THEN 'version_missing' ELSE 'found' END AS status,
  s.feature_version, s.computed_at, s.lacks_dti, s.loan_to_income, s.dti, s.fico_score, s.grade
FROM requests r LEFT JOIN feature_store s ON s.applicant_id = r.applicant_id AND s.feature_version = 1
LEFT JOIN (SELECT DISTINCT applicant_id FROM feature_store) k ON k.applicant_id = r.applicant_id"""


@query("j3_lookup_exact_version", Q.build(["requests", "feature_store"], f"""
SELECT request_id, applicant_id, status, feature_version, {text('computed_at')} AS computed_at, fico_score, grade FROM looked""", {"looked": LOOKED}))
def lookup(spark, d):
    return J.lookup_features(V.requests(spark, d), V.feature_store(spark, d), 1).select(
        "request_id", "applicant_id", "status", "feature_version", stamp("computed_at"), "fico_score", "grade")


@query("j3_lookup_latest_version", Q.build(["requests", "feature_store"], """
SELECT request_id, CASE WHEN s.applicant_id IS NULL THEN 'not_found' ELSE 'found' END AS status, s.feature_version, s.fico_score
FROM requests r LEFT JOIN (SELECT * FROM feature_store QUALIFY row_number() OVER (PARTITION BY applicant_id ORDER BY feature_version DESC) = 1) s
  ON s.applicant_id = r.applicant_id"""))
def lookup_latest(spark, d):
    return J.lookup_features(V.requests(spark, d), V.feature_store(spark, d), 0).select("request_id", "status", "feature_version", "fico_score")


ADMITTED = f"""SELECT *, CASE WHEN status <> 'found' THEN status WHEN date_diff('second', computed_at, {NOW}) / 3600.0 > 720 THEN 'stale'
  WHEN lacks_dti THEN 'feature_missing' ELSE 'ok' END AS verdict FROM looked"""


@query("j4_admissibility", Q.build(["requests", "feature_store"], "SELECT request_id, verdict AS status FROM admitted", {"looked": LOOKED, "admitted": ADMITTED}))
def admissibility(spark, d):
    found = J.lookup_features(V.requests(spark, d), V.feature_store(spark, d), 1)
    return J.admissibility(found, ["dti", "fico_score", "loan_to_income"], V.now(), 1).select("request_id", "status")


@query("j4_admissibility_versions", Q.build(["requests", "feature_store"], f"""
SELECT request_id, CASE WHEN s.applicant_id IS NULL THEN 'not_found' WHEN date_diff('second', computed_at, {NOW}) / 3600.0 > 720 THEN 'stale'
  WHEN s.feature_version <> 1 THEN 'version_mismatch' WHEN lacks_dti THEN 'feature_missing' ELSE 'ok' END AS status
FROM requests r LEFT JOIN feature_store s ON s.applicant_id = r.applicant_id"""))
def admissibility_versions(spark, d):
    # looked up as latest, so that another version can meet the model
    found = J.lookup_features(V.requests(spark, d), V.feature_store(spark, d), 0)
    return J.admissibility(found, ["dti", "fico_score", "loan_to_income"], V.now(), 1).select("request_id", "status")


PUBLISHED = """SELECT 'user_' || user_id::VARCHAR AS metric_name, 'v1.' || (event_id % 3)::VARCHAR AS model_version, avg(value) AS metric_value FROM events {0} GROUP BY 1, 2"""


def _per_user(spark, d, condition):
    return V.table(spark, d, "events").where(condition).groupBy(
        F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("metric_name"),
        F.concat(F.lit("v1."), (F.col("event_id") % 3).cast("string")).alias("model_version"),
    ).agg(F.avg("value").alias("metric_value"))


@query("j6_unpublished_metrics", f"""
SELECT metric_name, model_version, {r('metric_value')} AS metric_value FROM ({PUBLISHED.format('')}) c
WHERE NOT EXISTS (SELECT 1 FROM ({PUBLISHED.format("WHERE event_type = 'purchase' AND ts < TIMESTAMP '2024-01-08'")}) l
  WHERE l.metric_name = c.metric_name AND l.model_version = c.model_version)""")
def unpublished(spark, d):
    log = _per_user(spark, d, "event_type = 'purchase' and ts < timestamp_ntz'2024-01-08 00:00:00'")
    return rounded(J.unpublished(_per_user(spark, d, "true"), log))


# ---------------------------------------------------------------- history

@query("t1_recent_scores", Q.build(["scoring_log"], f"""
SELECT request_id, {text('scored_at')} AS scored_at, {r('score')} AS score FROM scoring_log WHERE model_version = 'v1.1' ORDER BY scored_log_order DESC, request_id DESC LIMIT 500""".replace(
    "scored_log_order", "scoring_log.scored_at")))
def recent_scores(spark, d):
    return rounded(H.recent_scores(V.scoring_log(spark, d), "v1.1", 500).select("request_id", stamp("scored_at"), "score"))


@query("t2_recent_snapshots", Q.build(["scoring_log"], f"""
SELECT request_id, k, {r('value')} AS value, CAST(NULL AS DOUBLE) AS absent FROM scoring_log WHERE model_version = 'v1.1' ORDER BY scored_at DESC, request_id DESC LIMIT 500"""))
def recent_snapshots(spark, d):
    return rounded(H.recent_snapshots(V.scoring_log(spark, d), "v1.1", 500, ["k", "value", "absent"]))


@query("t3_recent_outcomes", Q.build(["scoring_log"], f"""
SELECT request_id, {r('score')} AS score, CAST(actual_default AS INTEGER) AS label FROM scoring_log
WHERE model_version = 'v1.1' AND actual_default IS NOT NULL ORDER BY outcome_observed_at DESC, request_id DESC LIMIT 500"""))
def recent_outcomes(spark, d):
    return rounded(H.recent_outcomes(V.scoring_log(spark, d), "v1.1", 500))


@query("t4_metric_history", Q.build(["drift_log"], f"""
SELECT {text('measured_at')} AS measured_at, metric_value, model_version FROM (
  SELECT * FROM drift_log WHERE metric_name = 'error' ORDER BY measured_at DESC, model_version DESC LIMIT 10)"""))
def metric_history(spark, d):
    return H.metric_history(V.drift_log(spark, d), "error", 10).select(stamp("measured_at"), "metric_value", "model_version")


@query("t4_latest_metrics", Q.build(["drift_log"], f"""
SELECT metric_name, {text('measured_at')} AS measured_at, model_version, metric_value FROM drift_log
QUALIFY row_number() OVER (PARTITION BY metric_name ORDER BY measured_at DESC, model_version DESC) = 1"""))
def latest_metrics(spark, d):
    return H.latest_metrics(V.drift_log(spark, d)).select("metric_name", stamp("measured_at"), "model_version", "metric_value")


@query("t6_metric_details", Q.build(["drift_log"], f"""
SELECT a.metric_name, {text('a.measured_at')} AS measured_at, b.metric_name AS feature, {r('b.metric_value', 5)} AS value
FROM drift_log a JOIN drift_log b ON a.measured_at = b.measured_at WHERE a.metric_name = 'error'"""))
def metric_details(spark, d):
    rows = V.drift_log(spark, d).where("metric_name = 'error'")
    return H.metric_details(rows).select("metric_name", stamp("measured_at"), "feature", round_away("value", 5).alias("value"))


@query("t7_distinct_ids", Q.build(["feature_store"], "SELECT DISTINCT applicant_id FROM feature_store ORDER BY applicant_id LIMIT 200"))
def distinct_ids(spark, d):
    return H.distinct_ids(V.feature_store(spark, d), 200)


@query("t8_pending_applicants", Q.build(["scoring_log"], PENDING))
def pending(spark, d):
    return J.pending_applicants(V.scoring_log(spark, d), V.now(), DELAY)


@query("t9_seeded_sample")
def sample(spark, d):
    """A fixed-size sample; repeatability and size are tested in pytest."""
    return H.seeded_sample(V.loans_raw(spark, d).select("id", "loan_amnt", "grade"), "id", 500)


# ---------------------------------------------------------------- unions and retention

@query("u1_train_with_validation", Q.build(["gold"], "SELECT id, \"default\", fico_score FROM gold WHERE split IN ('train', 'val')"))
def train_validation(spark, d):
    rows = V.gold(spark, d).select("id", "default", "fico_score", "split")
    return J.with_validation(rows.where("split = 'train'"), rows.where("split = 'val'")).drop("split")


@query("u2_augmented_rows", Q.build(["gold", "rejected_raw"], f"""
SELECT id, fico_score, "default", 1::DOUBLE AS weight, false AS is_pseudo FROM gold WHERE split IN ('train', 'val')
UNION ALL SELECT id, risk, CAST(risk < 600 AS INTEGER), 0.3::DOUBLE, true FROM rejected_raw WHERE risk IS NOT NULL"""))
def augmented(spark, d):
    rows = V.gold(spark, d).select("id", "fico_score", "default", "split")
    turned = V.rejected_raw(spark, d).where("Risk_Score is not null").select(
        "id", F.col("Risk_Score").alias("fico_score"), (F.col("Risk_Score") < 600).cast("int").alias("default"))
    return J.augmented_rows(rows.where("split = 'train'").drop("split"), turned, rows.where("split = 'val'").drop("split"))


@query("r1_retention_report", Q.build(["scoring_log"], f"""
SELECT {RETAINED_DAYS} AS retention_days, count(*) FILTER (WHERE scored_at < {NOW} - INTERVAL {RETAINED_DAYS} DAY) AS rows_deleted FROM scoring_log"""))
def retention_report(spark, d):
    return J.retention_report(V.scoring_log(spark, d), V.now(), RETAINED_DAYS)


@query("r1_prune_decisions", Q.build(["scoring_log"], f"""
SELECT request_id, {text('scored_at')} AS scored_at FROM scoring_log WHERE scored_at >= {NOW} - INTERVAL '{RETAINED_DAYS} days 12 hours'"""))
def prune(spark, d):
    path = scratch_path(spark, "pruned-log")
    L.append_decisions(V.scoring_log(spark, d).withColumn("calibrated_pd", F.lit(None).cast("double")), path)
    # noon, so that the boundary day is cut in two
    L.prune_decisions(spark, path, datetime(2024, 2, 14, 12), RETAINED_DAYS)
    return spark.read.parquet(path).select("request_id", stamp("scored_at"))
