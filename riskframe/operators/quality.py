"""Quality gates: one aggregation per frame, one result row per expectation."""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, functions as F

from riskframe.contract import DEFAULT, Contract
from riskframe.functions.tables import BINARY_COLUMNS, FEATURES
from riskframe.functions.numeric import round_away

logger = logging.getLogger(__name__)


class QualityError(ValueError):
    """A strict gate failed; nothing was written."""


class Expectation:
    """A name, the aggregate that is observed, and the test on all aggregates."""

    def __init__(self, name: str, observed: Column, passes):
        self.name, self.observed, self.passes = name, observed, passes


def _as_text(value: Column) -> Column:
    return value.cast("string")


def _evaluate(df: DataFrame, expectations: list[Expectation]) -> DataFrame:
    one = df.agg(
        *[
            F.struct(
                F.lit(i).alias("position"),
                F.lit(e.name).alias("expectation"),
                F.coalesce(e.passes, F.lit(False)).alias("success"),
                _as_text(e.observed).alias("observed"),
            ).alias(f"e{i}")
            for i, e in enumerate(expectations)
        ]
    )
    rows = F.array(*[F.col(f"e{i}") for i in range(len(expectations))])
    return one.select(F.inline(rows)).select("expectation", "success", "observed")


def _null_count(name: str) -> Column:
    return F.count_if(F.col(name).isNull())


def _rows() -> Column:
    return F.count(F.lit(1))


def _no_nulls(name: str) -> Expectation:
    return Expectation(f"{name}_not_null", _null_count(name), (_null_count(name) == 0) & (_rows() > 0))


def _missing(name: str) -> Expectation:
    return Expectation(f"{name}_exists", F.max(F.lit("column missing")), F.max(F.lit(False)))


def _all_pass(name: str, condition: Column) -> Expectation:
    """Every row must satisfy the condition; an empty frame does."""
    failed = F.count_if(~F.coalesce(condition, F.lit(False)))
    return Expectation(name, failed, failed == 0)


def _default_rate(target: str) -> Expectation:
    rate = F.avg(F.col(target).cast("double"))
    return Expectation(
        "default_rate_between_5_50_pct", round_away(rate, 4), (rate >= 0.05) & (rate <= 0.50)
    )


def bronze_checks(df: DataFrame) -> DataFrame:
    checks = [Expectation("row_count_gt_zero", _rows(), _rows() > 0)]
    for name in ("ingested_at", "source_file"):
        checks.append(_no_nulls(name) if name in df.columns else _missing(name))
    return _evaluate(df, checks)


def silver_checks(df: DataFrame) -> DataFrame:
    """Range checks fail on NULL here."""
    has = set(df.columns)
    checks = [Expectation("row_count_gt_zero", _rows(), _rows() > 0)]
    checks += [_no_nulls(c) for c in ("loan_amnt", "int_rate", "fico_score") if c in has]
    if "fico_score" in has:
        checks.append(_all_pass("fico_score_between_300_850", F.col("fico_score").between(300, 850)))
    if "annual_inc" in has:
        checks.append(_all_pass("annual_inc_non_negative", F.col("annual_inc") >= 0))
    if "dti" in has:
        checks.append(_all_pass("dti_between_0_100", F.col("dti").between(0, 100)))
    if "default" in has:
        target = F.col("default")
        checks.append(_all_pass("default_is_binary", target.isNull() | target.isin(0, 1)))
        checks.append(_default_rate("default"))
    return _evaluate(df, checks)


def gold_checks(df: DataFrame, expected=FEATURES, min_rows: int = 1000) -> DataFrame:
    """Range and flag checks ignore NULL here."""
    has = set(df.columns)
    checks = [Expectation(f"row_count_gt_{min_rows}", _rows(), _rows() > min_rows)]
    if expected is not None:
        absent = [c for c in expected if c not in has]
        checks.append(
            Expectation(
                "all_feature_columns_present",
                F.max(F.lit("all present" if not absent else "missing: " + ", ".join(absent))),
                F.coalesce(F.max(F.lit(not absent)), F.lit(not absent)),
            )
        )
    for name, top in (("grade_numeric", 7), ("sub_grade_numeric", 35)):
        if name in has:
            value = F.col(name)
            checks.append(_all_pass(f"{name}_between_1_{top}", value.isNull() | value.between(1, top)))
    for name in BINARY_COLUMNS:
        if name in has:
            value = F.col(name)
            checks.append(_all_pass(f"{name}_is_binary", value.isNull() | value.isin(0, 1)))
    if "default" in has:
        checks.append(_default_rate("default"))
    return _evaluate(df, checks)


def null_fractions(df: DataFrame, columns=None) -> DataFrame:
    """(feature, null_fraction) of every column in one pass."""
    columns = list(columns or df.columns)
    one = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns])
    return one.unpivot([], columns, "feature", "null_fraction")


def too_many_nulls(df: DataFrame, contract: Contract = DEFAULT, columns=None) -> DataFrame:
    return null_fractions(df, columns).where(F.col("null_fraction") > contract.max_null_fraction)


def value_report(df: DataFrame, columns) -> DataFrame:
    """Missing and infinite counts and rates per numeric feature."""
    columns = list(columns)
    one = df.agg(
        *[
            F.struct(
                F.lit(c).alias("feature"),
                F.count_if(F.col(c).isNull() | F.isnan(F.col(c).cast("double"))).alias("null_count"),
                F.count_if(F.abs(F.col(c).cast("double")) == float("inf")).alias("inf_count"),
                F.count(F.lit(1)).alias("n"),
            ).alias(f"__{i}")
            for i, c in enumerate(columns)
        ]
    )
    return one.select(F.inline(F.array(*[F.col(f"__{i}") for i in range(len(columns))]))).select(
        "feature",
        "null_count",
        F.try_divide("null_count", "n").alias("null_rate"),
        "inf_count",
    )


def run_gate(df: DataFrame, checks, layer: str, strict: bool = False) -> DataFrame:
    """Evaluate a suite before a sink. Strict failures raise, others are logged.

    The frame is returned unchanged, so the gate wraps a write:
    ``run_gate(df, silver_checks, "silver", strict).write...``
    """
    failed = [r["expectation"] for r in checks(df).where("not success").collect()]
    if failed:
        message = f"{layer}: {', '.join(failed)}"
        if strict:
            raise QualityError(message)
        logger.warning("quality gate failed for %s", message)
    return df
