"""The weekly monitoring run as one Spark application."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from riskframe.contract import DEFAULT, Contract
from riskframe.operators.distributions import csi, drifted_features, psi
from riskframe.operators.history import logged_outcomes, logged_scores
from riskframe.operators.joins import backfill_outcomes
from riskframe.operators.trees import Ensemble, with_probability
from riskframe.operators.verdicts import drift_verdict, performance_verdict, retrain_decision


def drift(
    train: DataFrame, test: DataFrame, log: DataFrame | None, ensemble: Ensemble, version: str,
    features: list[str], contract: Contract = DEFAULT, since: Column | None = None, until: Column | None = None,
) -> DataFrame:
    """Score shift and feature shift against the training rows scored by the same model.

    All decisions of the caller's time window count, by default the whole log of this model. The test rows stand in
    when the log holds nothing for it.
    """
    reference = with_probability(train, ensemble, "score")
    production = None if log is None else logged_scores(log, version, features, since, until)
    real = production is not None and not production.isEmpty()
    if real:
        scores = production.select("score")
    else:
        scores, production = with_probability(test, ensemble, "score").select("score"), test
    shift = psi(reference.select("score"), scores.select(F.col("score").cast("double")), "score")
    drifted = drifted_features(csi(train, production, features), contract)
    n = scores.agg(F.count(F.lit(1))).scalar()
    return drift_verdict(shift, n, drifted, real, contract)


def performance(
    log: DataFrame | None, test_scored: DataFrame, version: str, baseline: dict[str, float],
    contract: Contract = DEFAULT, since: Column | None = None, until: Column | None = None,
) -> DataFrame:
    """Ranking power on all matured outcomes of the window, or on the scored test rows while they are few."""
    if log is not None:
        cohort = logged_outcomes(log, version, since, until)
        if cohort.limit(contract.min_outcomes).count() >= contract.min_outcomes:
            return performance_verdict(
                cohort.withColumn("score", F.col("score").cast("double")), "label", "score", baseline, contract
            )
    return performance_verdict(test_scored, "label", "score", baseline, contract)


def weekly(
    train: DataFrame, test: DataFrame, test_scored: DataFrame, log: DataFrame, outcomes: DataFrame,
    ensemble: Ensemble, version: str, features: list[str], baseline: dict[str, float], now: Column,
    delay_days: int = 0, contract: Contract = DEFAULT, since: Column | None = None, until: Column | None = None,
) -> dict[str, DataFrame]:
    """Backfill first, then both monitors, then the retrain decision."""
    matured = backfill_outcomes(log, outcomes, now, delay_days)
    shift = drift(train, test, log, ensemble, version, features, contract, since, until)
    power = performance(matured, test_scored, version, baseline, contract, since, until)
    return {
        "log": matured, "drift": shift, "performance": power,
        "decision": retrain_decision([shift, power]),
    }
