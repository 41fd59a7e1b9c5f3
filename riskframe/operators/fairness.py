"""Group outcomes, disparity measures and the promotion gate."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from riskframe.contract import DEFAULT, Contract
from riskframe.functions.parsing import clean
from riskframe.functions.scorecard import decision
from riskframe.functions.tables import PROTECTED_ATTRIBUTES
from riskframe.functions.numeric import round_away
from riskframe.operators.ranking import ranking_metrics


def _group_names(spark, attributes) -> DataFrame:
    rows = [
        (name, code, label, code == privileged)
        for name, (labels, privileged, _) in attributes.items()
        for code, label in labels.items()
    ]
    return F.broadcast(
        spark.createDataFrame(rows, "attribute string, code int, group string, privileged boolean")
    )


def _by_attribute(df: DataFrame, label: str, score: str, attributes) -> tuple[DataFrame, int]:
    """(label, score, attribute, code, group, privileged) rows and the number of groups."""
    present = [a for a in attributes if a in df.columns]
    names = _group_names(df.sparkSession, {a: attributes[a] for a in present})
    limit = sum(len(attributes[a][0]) for a in present)
    rows = (
        df.select(
            F.col(label).cast("int").alias("label"),
            clean(F.col(score)).alias("score"),
            *[F.col(a).cast("int").alias(a) for a in present],
        )
        .unpivot(["label", "score"], present, "attribute", "code")
        .join(names, ["attribute", "code"])
    )
    return rows, limit


def group_rates(
    df: DataFrame, label: str, score: str, attributes=PROTECTED_ATTRIBUTES, contract: Contract = DEFAULT
) -> DataFrame:
    """Rates of every group of every attribute in one aggregation, groups below 10 rows left out.

    ``approve_rate_good`` is the approval rate among rows that did not default.
    """
    rows, _ = _by_attribute(df, label, score, attributes)
    band = decision(F.col("score"), contract)
    approved = (band == "approve").cast("double")
    keys = ["attribute", "code", "group", "privileged"]
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("count"),
        round_away(F.avg("label"), 4).alias("default_rate"),
        round_away(F.avg(approved), 4).alias("approval_rate"),
        round_away(F.avg((band == "decline").cast("double")), 4).alias("decline_rate"),
        round_away(F.avg("score"), 4).alias("mean_score"),
        F.coalesce(F.avg(F.when(F.col("label") == 0, approved)), F.lit(0.0)).alias("approve_rate_good"),
    ).where(F.col("count") >= contract.min_group_rows)


def group_metrics(
    df: DataFrame, label: str, score: str, attributes=PROTECTED_ATTRIBUTES, contract: Contract = DEFAULT
) -> DataFrame:
    """``group_rates`` with the AUC of every group."""
    rows, limit = _by_attribute(df, label, score, attributes)
    auc = ranking_metrics(
        rows, "label", "score", ["attribute", "code"], group_limit=limit,
        bounds_from=df.select(F.col(score).alias("score")),
    ).select("attribute", "code", round_away("auc", 4).alias("auc"))
    return group_rates(df, label, score, attributes, contract).join(
        F.broadcast(auc), ["attribute", "code"], "left"  # one row per group
    )


def _with_privileged(groups: DataFrame, columns: list[str]) -> DataFrame:
    top = groups.where("privileged").select("attribute", *[F.col(c).alias(f"top_{c}") for c in columns])
    return groups.join(F.broadcast(top), "attribute", "left")  # one row per attribute


def disparate_impact(groups: DataFrame, contract: Contract = DEFAULT) -> DataFrame:
    """Approval rate over the privileged rate; no rows where that rate is missing or 0."""
    ratio = F.col("approval_rate") / F.col("top_approval_rate")
    return (
        _with_privileged(groups, ["approval_rate"])
        .where("top_approval_rate > 0")
        .select(
            "attribute",
            "group",
            "privileged",
            F.when(F.col("privileged"), 1.0).otherwise(round_away(ratio, 4)).alias("dir"),
            (~F.col("privileged") & (ratio < contract.dir_threshold)).alias("violation"),
        )
    )


def equal_opportunity(groups: DataFrame) -> DataFrame:
    """Difference to the privileged group in approvals among non-defaulters."""
    gap = F.col("approve_rate_good") - F.coalesce("top_approve_rate_good", F.lit(0.0))
    return _with_privileged(groups, ["approve_rate_good"]).select(
        "attribute", "group", round_away(gap, 4).alias("eod")
    )


def statistical_parity(groups: DataFrame) -> DataFrame:
    """Difference to the privileged group in approvals."""
    gap = F.col("approval_rate") - F.coalesce("top_approval_rate", F.lit(0.0))
    return _with_privileged(groups, ["approval_rate"]).select(
        "attribute", "group", round_away(gap, 4).alias("spd")
    )


def fairness_summary(groups: DataFrame, contract: Contract = DEFAULT) -> DataFrame:
    """One row per attribute and group with all measures and the violation flag."""
    ratio = F.col("approval_rate") / F.col("top_approval_rate")
    return (
        _with_privileged(groups, ["approval_rate", "approve_rate_good"])
        .where("top_approval_rate > 0")
        .select(
            "attribute",
            "group",
            "privileged",
            F.when(F.col("privileged"), 1.0).otherwise(round_away(ratio, 4)).alias("dir"),
            round_away(F.col("approve_rate_good") - F.col("top_approve_rate_good"), 4).alias("eod"),
            round_away(F.col("approval_rate") - F.col("top_approval_rate"), 4).alias("spd"),
            "approval_rate",
            "default_rate",
            (~F.col("privileged") & (ratio < contract.dir_threshold)).alias("violation"),
        )
    )


def fairness_report(
    df: DataFrame, label: str, score: str, attributes=PROTECTED_ATTRIBUTES, contract: Contract = DEFAULT
) -> DataFrame:
    return fairness_summary(group_rates(df, label, score, attributes, contract), contract)


def overall_rates(df: DataFrame, label: str, score: str, contract: Contract = DEFAULT) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("n_observations"),
        round_away(F.avg((F.col(score) < contract.approve_below).cast("double")), 4).alias("approval_rate"),
        round_away(F.avg(F.col(label).cast("double")), 4).alias("default_rate"),
    )


def worst_impact(summary: DataFrame) -> DataFrame:
    """The lowest ratio, starting at parity; an empty summary is an error."""
    return summary.agg(
        F.when(F.count(F.lit(1)) == 0, F.raise_error(F.lit("fairness summary has no groups")))
        .otherwise(F.least(F.lit(1.0), F.min("dir")))
        .alias("worst_dir")
    )


def gate_reasons(
    champion: DataFrame | None, challenger: DataFrame, contract: Contract = DEFAULT
) -> DataFrame:
    """(attribute, group, reason) of every group that blocks the challenger.

    A group blocks when its violation is new, or worse than the champion's by
    more than the tolerance.
    """
    now = challenger.where(F.col("dir") < contract.dir_threshold).select("attribute", "group", "dir")
    if champion is None:
        paired = now.withColumn("before", F.lit(None).cast("double"))
    else:
        earlier = champion.select("attribute", "group", F.col("dir").alias("before"))
        paired = now.join(earlier, ["attribute", "group"], "left")
    new = F.col("before").isNull() | (F.col("before") >= contract.dir_threshold)
    worse = F.col("dir") < F.col("before") - contract.dir_worsen_tolerance
    return paired.select(
        "attribute",
        "group",
        F.when(
            new,
            F.format_string(
                "%s/%s introduces a DIR violation (%.2f < %.2f)",
                "attribute", "group", "dir", F.lit(contract.dir_threshold),
            ),
        )
        .when(
            worse,
            F.format_string(
                "%s/%s worsens an existing DIR violation (champion %.2f -> challenger %.2f)",
                "attribute", "group", "before", "dir",
            ),
        )
        .alias("reason"),
    ).where("reason is not null")


def fairness_gate(
    spark, champion: DataFrame | None, challenger: DataFrame | None, has_champion: bool = True,
    contract: Contract = DEFAULT,
) -> DataFrame:
    """One row (gate, reasons): passed, blocked, or skipped without a champion."""
    if not has_champion:
        return spark.sql("select 'skipped' as gate, cast(array() as array<string>) as reasons")
    if challenger is None:
        return spark.sql(
            "select 'blocked' as gate, "
            "array('challenger fairness summary missing from training result') as reasons"
        )
    reasons = gate_reasons(champion, challenger, contract)
    return reasons.agg(F.array_sort(F.collect_list("reason")).alias("reasons")).select(
        F.when(F.size("reasons") > 0, "blocked").otherwise("passed").alias("gate"), "reasons"
    )


def validation_verdict(
    spark, challenger: DataFrame | None, champion: DataFrame | None, calibrated: bool,
    contract: Contract = DEFAULT,
) -> DataFrame:
    """One row (status, rationale). Missing fairness or calibration needs a review;
    violations inherited from the champion and not worsened are let through."""
    if challenger is None:
        return spark.createDataFrame(
            [("REVIEW REQUIRED", "No fairness analysis recorded; DIR compliance cannot be verified.")],
            "status string, rationale string",
        )
    now = challenger.where("violation").select("attribute", "group", "dir")
    if champion is None:
        paired = now.withColumn("before", F.lit(None).cast("double"))
    else:
        paired = now.join(
            champion.select("attribute", "group", F.col("dir").alias("before")),
            ["attribute", "group"],
            "left",
        )
    name = F.concat_ws("/", "attribute", "group")
    inherited = F.col("before") < contract.dir_threshold
    worse = F.col("dir") < F.col("before") - contract.dir_worsen_tolerance
    found = paired.select(
        F.when(
            F.coalesce(inherited & worse, F.lit(False)),
            F.concat(name, F.format_string(" (worsened: %.2f -> %.2f)", "before", "dir")),
        ).when(~F.coalesce(inherited, F.lit(False)), name).alias("blocking"),
        F.when(inherited & ~worse, name).alias("kept"),
    ).agg(
        F.array_sort(F.collect_list("blocking")).alias("blocking"),
        F.array_sort(F.collect_list("kept")).alias("kept"),
    )
    blocked = F.size("blocking") > 0
    return found.select(
        F.when(blocked | F.lit(not calibrated), "REVIEW REQUIRED").otherwise("APPROVED").alias("status"),
        F.when(
            blocked,
            F.concat(
                F.lit("Disparate Impact Ratio below the 0.80 four-fifths rule for: "),
                F.array_join("blocking", ", "),
                F.lit("."),
            ),
        )
        .when(
            F.lit(not calibrated),
            "Model is not calibrated; predicted scores are not usable as PDs.",
        )
        .when(
            F.size("kept") > 0,
            F.concat(
                F.lit(
                    "Discrimination, calibration, and fairness checks passed "
                    "(champion-relative: inherited DIR violations on "
                ),
                F.array_join("kept", ", "),
                F.lit(" not worsened)."),
            ),
        )
        .otherwise("Discrimination, calibration, and fairness checks passed.")
        .alias("rationale"),
    )
