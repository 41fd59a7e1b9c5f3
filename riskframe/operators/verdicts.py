"""Monitoring verdicts and model comparison as one-row frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from riskframe.contract import DEFAULT, Contract
from riskframe.functions.numeric import round_away
from riskframe.operators.distributions import psi
from riskframe.operators.ranking import rank_order_breaks, ranking_metrics, score_deciles


def shift_status(value: Column, contract: Contract = DEFAULT) -> Column:
    return (
        F.when(value > contract.psi_critical, "CRITICAL")
        .when(value > contract.psi_warning, "WARNING")
        .otherwise("OK")
    )


def _no_reasons() -> Column:
    return F.array().cast("array<string>")


def drift_verdict(
    psi_row: DataFrame, n_scores: Column, drifted: DataFrame | None, real: bool, contract: Contract = DEFAULT
) -> DataFrame:
    """One row from a (psi) row, the number of production scores and drifted features.

    Proxy data never triggers anything; too few real scores wait.
    """
    n = F.col("n_observations")
    names = (
        _no_reasons()
        if drifted is None
        else drifted.agg(F.array_sort(F.collect_list("feature"))).scalar()  # at most one per feature
    )
    base = psi_row.select(
        F.col("psi").alias("raw"), n_scores.cast("bigint").alias("n_observations"), names.alias("drifted")
    )
    enough = n >= contract.min_drift_scores
    status = F.when(F.lit(real) & ~enough, "INSUFFICIENT_DATA").otherwise(shift_status(F.col("raw"), contract))
    shown = F.format_string("%.4f", round_away("raw", 4))
    flagged = base.withColumn("psi_status", status).withColumn("eligible", F.lit(real) & enough)
    retrain = F.col("eligible") & (F.col("psi_status") == "CRITICAL")
    return flagged.select(
        round_away("raw", 4).alias("psi"),
        "psi_status",
        "n_observations",
        F.col("eligible").alias("monitoring_eligible"),
        F.col("drifted").alias("drifted_features"),
        retrain.alias("needs_retrain"),
        F.when(retrain, F.array(F.concat(F.lit("psi_critical ("), shown, F.lit(")")))).otherwise(_no_reasons()).alias("retrain_reasons"),
        F.when(
            ~F.lit(real),
            F.concat(F.lit("DIAGNOSTIC ONLY. Score PSI ("), shown, F.lit(") uses the test-set proxy and cannot trigger automated retraining.")),
        )
        .when(
            F.col("psi_status") == "INSUFFICIENT_DATA",
            F.concat(
                F.lit("WAIT FOR MORE DATA. Only "), n.cast("string"),
                F.lit(f" production scores are available; at least {contract.min_drift_scores} are required for automated drift action."),
            ),
        )
        .when(
            F.col("psi_status") == "CRITICAL",
            F.concat(
                F.lit("RETRAIN RECOMMENDED. Score PSI ("), shown,
                F.lit(") exceeds critical threshold. The population applying for loans has shifted significantly from training data."),
            ),
        )
        .when(
            (F.col("psi_status") == "WARNING") & (F.size("drifted") > 0),
            F.concat(
                F.lit("MONITOR CLOSELY. Score PSI ("), shown,
                F.lit(") shows moderate drift. Features driving drift: "), F.array_join("drifted", ", "),
                F.lit(". If this persists for 2+ weeks, consider retraining."),
            ),
        )
        .when(
            F.col("psi_status") == "WARNING",
            F.concat(F.lit("MONITOR CLOSELY. Score PSI ("), shown, F.lit(") shows moderate drift but no individual features exceed CSI threshold.")),
        )
        .otherwise(F.concat(F.lit("No action needed. Score PSI ("), shown, F.lit(") is within normal range.")))
        .alias("recommendation"),
    )


def performance_verdict(
    scored: DataFrame, label: str, score: str, baseline: dict[str, float], contract: Contract = DEFAULT
) -> DataFrame:
    """One row comparing the cohort's AUC with the recorded test (else val) AUC."""
    reference = baseline.get("test", baseline.get("val"))
    metrics = ranking_metrics(scored, label, score)
    breaks = rank_order_breaks(score_deciles(scored, label, score)).scalar()
    base = metrics.select(
        "n", "auc", "ks", "gini",
        F.lit(reference).cast("double").alias("baseline_auc"),
        breaks.alias("rank_order_breaks"),
    ).withColumn("drop", F.col("baseline_auc") - F.col("auc"))
    one_class, no_base = F.col("auc").isNull(), F.col("baseline_auc").isNull()
    retrain = F.coalesce(F.col("drop") > contract.auc_drop_threshold, F.lit(False))
    shown = F.format_string("%.4f", round_away("drop", 4))
    limit = f"{contract.auc_drop_threshold:g}"
    return base.select(
        F.col("n").alias("n_observations"),
        round_away("auc", 4).alias("auc"),
        round_away("ks", 4).alias("ks"),
        round_away("gini", 4).alias("gini"),
        round_away("drop", 4).alias("auc_drop"),
        F.when(~one_class, F.col("rank_order_breaks")).otherwise(0).alias("rank_order_breaks"),
        retrain.alias("needs_retrain"),
        F.when(retrain, F.array(F.concat(F.lit("auc_drop ("), shown, F.lit(")")))).otherwise(_no_reasons()).alias("retrain_reasons"),
        F.when(
            one_class,
            "INSUFFICIENT OUTCOMES. Both default and non-default outcomes are required to compute AUC/KS; skipping this cohort.",
        )
        .when(
            no_base,
            "INSUFFICIENT BASELINE. The champion export records no test/val AUC to compare against; "
            "re-export the model. Degradation check skipped.",
        )
        .when(
            retrain,
            F.concat(
                F.lit("RETRAIN RECOMMENDED. AUC has dropped "), shown,
                F.lit(f" from training (threshold: {limit}). Current AUC: "), round_away("auc", 4).cast("string"), F.lit("."),
            ),
        )
        .when(
            F.col("rank_order_breaks") > contract.max_rank_breaks,
            F.concat(
                F.lit("INVESTIGATE. Rank ordering has "), F.col("rank_order_breaks").cast("string"),
                F.lit(" breaks across deciles. The model's discrimination is degrading even though AUC drop ("),
                shown, F.lit(") hasn't crossed the threshold yet."),
            ),
        )
        .otherwise(
            F.concat(
                F.lit("Model performance stable. AUC drop: "), shown, F.lit(f" (within {limit} threshold). Current KS: "),
                round_away("ks", 4).cast("string"), F.lit("."),
            )
        )
        .alias("recommendation"),
    )


def retrain_decision(verdicts: list[DataFrame]) -> DataFrame:
    """One row: retrain or skip_retrain, with the reasons of all verdicts in their order."""
    rows = None
    for i, v in enumerate(verdicts):
        one = v.select(F.lit(i).alias("i"), F.when(F.col("needs_retrain"), F.col("retrain_reasons")).otherwise(_no_reasons()).alias("r"))
        rows = one if rows is None else rows.unionByName(one)
    found = rows.agg(F.array_sort(F.collect_list(F.struct("i", "r"))).alias("all")).select(
        F.flatten(F.col("all.r")).alias("reasons")
    )
    return found.select(
        F.when(F.size("reasons") > 0, "retrain").otherwise("skip_retrain").alias("decision"),
        F.array_join("reasons", ", ").alias("reason"),
    )


def compare_models(scored: DataFrame, label: str, champion: str, challenger: str, smoothing: str = "laplace") -> DataFrame:
    """One row: rounded metrics of both score columns on the same rows, deltas and score PSI."""
    long = scored.select(label, F.col(champion).alias("champion"), F.col(challenger).alias("challenger")).unpivot(
        [label], ["champion", "challenger"], "model", "score"
    )
    m = ranking_metrics(long, label, "score", ["model"], group_limit=2)

    def of(model: str, c: str) -> Column:
        return F.max(F.when(F.col("model") == model, round_away(c, 4))).alias(f"{model}_{c}")

    wide = m.agg(*[of(model, c) for model in ("champion", "challenger") for c in ("auc", "ks", "gini")])
    shift = psi(
        scored.select(F.col(champion).alias("s")), scored.select(F.col(challenger).alias("s")), "s", smoothing=smoothing
    ).scalar()
    return wide.withColumns(
        {
            "auc_delta": round_away(F.col("challenger_auc") - F.col("champion_auc"), 4),
            "ks_delta": round_away(F.col("challenger_ks") - F.col("champion_ks"), 4),
            "score_psi": round_away(shift, 4),
        }
    )


def promotion_advice(comparison: DataFrame, gate: DataFrame, contract: Contract = DEFAULT) -> DataFrame:
    """Add ``gate`` and ``advice`` (PROMOTE, CONSIDER, DO NOT PROMOTE) to a comparison row.

    The gate is decisive; without a champion the challenger becomes the first model.
    """
    state = gate.select("gate").scalar()
    delta = F.col("challenger_auc") - F.col("champion_auc")
    return comparison.withColumn("gate", state).withColumn(
        "advice",
        F.when(F.col("champion_auc").isNull(), "PROMOTE")
        .when(F.col("gate") == "blocked", "DO NOT PROMOTE")
        .when(delta > contract.auc_promote_margin, "PROMOTE")
        .when(delta > -contract.auc_promote_margin, "CONSIDER")
        .otherwise("DO NOT PROMOTE"),
    )


def reject_inference_advice(comparison: DataFrame, summary: DataFrame, contract: Contract = DEFAULT) -> DataFrame:
    """Add the violations of the augmented model and the advice that follows."""
    names = summary.where("violation").agg(
        F.array_sort(F.collect_list(F.concat_ws("/", "attribute", "group")))
    ).scalar()
    return comparison.withColumn("violations", F.array_join(names, ", ")).withColumn(
        "advice",
        F.when(F.col("violations") != "", "DO NOT PROMOTE")
        .when((F.col("auc_delta") > 0) & (F.col("score_psi") < contract.psi_critical), "PROMOTE")
        .when(F.col("auc_delta") > 0, "CAUTION")
        .otherwise("KEEP CHAMPION"),
    )
