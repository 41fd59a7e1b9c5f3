"""Batch scoring: requests -> snapshots -> decisions with reasons, or errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from riskframe.contract import DEFAULT, Contract
from riskframe.functions.parsing import applicant_id_problem
from riskframe.functions.scorecard import calibrated, decision, points
from riskframe.functions.numeric import round_away
from riskframe.operators.joins import admissibility, lookup_features
from riskframe.operators.trees import Ensemble, with_attributions, with_probability, with_reasons
from riskframe.sources.versions import VersionedTable


def decide(
    rows: DataFrame, ensemble: Ensemble, calibrator: tuple[list[float], list[float]] | None,
    contract: Contract = DEFAULT,
) -> DataFrame:
    """Add score, calibrated_pd, scaled_score and decision to rows of features.

    The decision uses the calibrated probability, or the raw one without a
    calibrator.
    """
    scored = with_probability(rows, ensemble, "score")
    if calibrator is None:
        return scored.withColumns(
            {
                "calibrated_pd": F.lit(None).cast("double"),
                "scaled_score": F.lit(None).cast("int"),
                "decision": decision(F.col("score"), contract),
            }
        )
    pd = F.col("calibrated_pd")
    return scored.withColumn("calibrated_pd", calibrated(F.col("score"), *calibrator)).withColumns(
        {"scaled_score": points(pd), "decision": decision(pd, contract)}
    )


def score_requests(
    requests: DataFrame, store: DataFrame, ensemble: Ensemble,
    calibrator: tuple[list[float], list[float]] | None, now: Column, model_version: str,
    feature_version: int, contract: Contract = DEFAULT,
) -> DataFrame:
    """One row per request; ``error`` is NULL for a decision and names the failure otherwise.

    ``requests`` has request_id and applicant_id. Nothing is dropped: results()
    and errors() split the frame, write_scored() writes both.
    """
    checked = requests.withColumn("problem", applicant_id_problem(F.col("applicant_id")))
    found = admissibility(
        lookup_features(checked, store, feature_version), ensemble.features, now, feature_version, contract
    )
    unpacked = found.withColumns(
        {f: F.try_element_at("features", F.lit(f)) for f in ensemble.features if f not in found.columns}
        | {f"__store_{c}": F.col(c) for c in ("fico_score", "grade")}
    )
    if "fico_score" in ensemble.features:
        unpacked = unpacked.withColumn("fico_score", F.try_element_at("features", F.lit("fico_score")))
    decided = decide(unpacked, ensemble, calibrator, contract)
    explained = with_reasons(with_attributions(decided, ensemble), contract=contract)
    failed = F.coalesce("problem", F.when(F.col("status") != "ok", F.col("status")))
    ok = failed.isNull()
    return explained.select(
        "request_id",
        "applicant_id",
        now.alias("scored_at"),
        failed.alias("error"),
        F.lit(model_version).alias("model_version"),
        F.when(ok, F.col("feature_version")).alias("feature_version"),
        F.when(ok, F.col("features")).alias("feature_snapshot"),
        F.when(ok, round_away("score", 5)).alias("score"),
        F.when(ok, round_away("calibrated_pd", 5)).alias("calibrated_pd"),
        F.when(ok, F.col("scaled_score")).alias("scaled_score"),
        F.when(ok, F.col("decision")).alias("decision"),
        F.when(ok, F.col("adverse_actions")).alias("adverse_actions"),
        F.when(ok, F.col("data_completeness")).alias("data_completeness"),
        F.when(ok, F.col("__store_fico_score")).alias("fico_score"),
        F.when(ok, F.col("__store_grade")).alias("grade"),
    )


def results(scored: DataFrame) -> DataFrame:
    return scored.where("error is null").drop("error")


def errors(scored: DataFrame) -> DataFrame:
    return scored.where("error is not null").select("request_id", "applicant_id", "scored_at", "error")


def scored_table(spark: SparkSession, path: str) -> VersionedTable:
    """Where scoring jobs write: decisions and failures as two partitions of one versioned table."""
    return VersionedTable(spark, path, "kind")


def write_scored(table: VersionedTable, scored: DataFrame, batch: int | None = None, writer: str = "batch") -> bool:
    """Write decisions and errors in one pass and commit them together.

    Both are computed once and staged under a directory of this write; readers see all of the batch or nothing of it. A batch
    number that this writer has committed before changes nothing and returns False.
    """
    kind = F.when(F.col("error").isNull(), F.lit("results")).otherwise(F.lit("errors"))
    return table.append(scored.withColumn("kind", kind), None if batch is None else writer, batch)


def written_results(table: VersionedTable) -> DataFrame:
    return results(table.read(["results"])).drop("kind")


def written_errors(table: VersionedTable) -> DataFrame:
    return errors(table.read(["errors"]))
