"""Raw loan text -> typed, imputed, range-checked silver rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from riskframe.functions.parsing import (
    clean, employment_years, midpoint_half_even, month_date, months_between_half_even, percent,
    term_months,
)
from riskframe.functions.tables import (
    CORE_COLUMNS, DEFAULT_STATUSES, MEDIAN_COLUMNS, ORIGINATION_COLUMNS, PAID_STATUSES,
    REJECTED_RENAMES,
)
from riskframe.operators.order import exact_quantiles, value_counts

NEVER_DELINQUENT = 999.0
LENGTH_UNKNOWN = -1


def resolved_loans(df: DataFrame, status: str = "loan_status") -> DataFrame:
    """Loans with a known outcome and their binary target ``default``."""
    return df.where(F.col(status).isin(*DEFAULT_STATUSES, *PAID_STATUSES)).withColumn(
        "default", F.col(status).isin(*DEFAULT_STATUSES).cast("int")
    )


def origination_only(df: DataFrame) -> DataFrame:
    """Keep the id, the issue month, the target and what was known at origination."""
    lead = ["issue_d", "id"] if "issue_d" in df.columns else ["id"]
    return df.select(*lead, *ORIGINATION_COLUMNS, "default")


def drop_incomplete(df: DataFrame, columns=CORE_COLUMNS) -> DataFrame:
    return df.na.drop("any", subset=list(columns))


def typed_origination(df: DataFrame) -> DataFrame:
    """Parse the text columns and derive age of credit and mid FICO."""
    numeric = [
        "loan_amnt", "installment", "annual_inc", "dti", "delinq_2yrs", "inq_last_6mths",
        "mths_since_last_delinq", "open_acc", "pub_rec", "revol_bal", "revol_util", "total_acc",
        "mort_acc", "pub_rec_bankruptcies",
    ]
    return df.select(
        F.col("id").cast("bigint").alias("id"),
        month_date(F.col("issue_d")).alias("issue_d"),
        *[clean(F.col(c)).alias(c) for c in numeric],
        term_months(F.col("term")).alias("term"),
        percent(F.col("int_rate")).alias("int_rate"),
        "grade",
        "sub_grade",
        employment_years(F.col("emp_length")).alias("emp_length"),
        "home_ownership",
        "verification_status",
        "purpose",
        months_between_half_even(
            month_date(F.col("earliest_cr_line")), month_date(F.col("issue_d"))
        ).alias("credit_history_months"),
        midpoint_half_even(F.col("fico_range_low"), F.col("fico_range_high")).alias("fico_score"),
        "default",
    )


def fill_sentinels(df: DataFrame) -> DataFrame:
    """Never delinquent -> 999 months; unknown job length -> -1 with a flag."""
    return df.withColumns(
        {
            "mths_since_last_delinq": F.coalesce("mths_since_last_delinq", F.lit(NEVER_DELINQUENT)),
            "emp_length_missing": F.col("emp_length").isNull().cast("int"),
            "emp_length": F.coalesce("emp_length", F.lit(LENGTH_UNKNOWN)),
        }
    )


def column_medians(df: DataFrame, columns=MEDIAN_COLUMNS) -> DataFrame:
    """(feature, median) of every column, all columns in one pass."""
    columns = list(columns)
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        [], columns, "feature", "value"
    )
    # loan columns repeat their values: counted per value, the long rows are read once less
    counts = value_counts(long, "value", ["feature"])
    return exact_quantiles(
        counts, "value", [0.5], ["feature"], weight="n", group_limit=len(columns), bounds_from=long
    ).select("feature", F.get("quantiles", F.lit(0)).alias("median"))


def median_values(df: DataFrame, columns=MEDIAN_COLUMNS) -> dict[str, float]:
    """The fitted medians, one number per column."""
    return {r["feature"]: r["median"] for r in column_medians(df, columns).collect()}


def fill_medians(df: DataFrame, columns=MEDIAN_COLUMNS, fit_on: DataFrame | None = None) -> DataFrame:
    """Replace NULL by the column median of ``fit_on`` (default: the frame itself).

    The medians are fitted here, once, and become constants of the plan; a
    column without any value stays as it is.
    """
    medians = median_values(df if fit_on is None else fit_on, columns)
    wide = df.withColumns({c: F.col(c).cast("double") for c in columns})
    return wide.na.fill({c: m for c, m in medians.items() if m is not None})


def in_range(df: DataFrame) -> DataFrame:
    """Rows inside the plausible ranges; NULL fails."""
    return df.where(
        (F.col("annual_inc") >= 0)
        & F.col("dti").between(0, 100)
        & F.col("fico_score").between(300, 850)
    )


def range_failures(df: DataFrame) -> DataFrame:
    """How many rows each range check removes, in the order the checks run."""
    ok_income = F.coalesce(F.col("annual_inc") >= 0, F.lit(False))
    ok_dti = F.coalesce(F.col("dti").between(0, 100), F.lit(False))
    ok_fico = F.coalesce(F.col("fico_score").between(300, 850), F.lit(False))
    return df.agg(
        F.count(F.lit(1)).alias("rows_in"),
        F.count_if(~ok_income).alias("bad_income"),
        F.count_if(ok_income & ~ok_dti).alias("bad_dti"),
        F.count_if(ok_income & ok_dti & ~ok_fico).alias("bad_fico"),
        F.count_if(ok_income & ok_dti & ok_fico).alias("rows_out"),
    )


def cleaned_loans(raw: DataFrame) -> DataFrame:
    """Everything up to the sentinel fills, before medians are known."""
    return fill_sentinels(typed_origination(drop_incomplete(origination_only(resolved_loans(raw)))))


def silver_loans(raw: DataFrame, fit_on: DataFrame | None = None) -> DataFrame:
    """The silver table of accepted loans."""
    return in_range(fill_medians(cleaned_loans(raw), fit_on=fit_on))


def silver_rejected(raw: DataFrame) -> DataFrame:
    """Rejected applications in silver names; no outcome is known for them."""
    return (
        raw.withColumnsRenamed(REJECTED_RENAMES)
        .withColumn("emp_length", employment_years(F.col("emp_length")))
        .select(
            clean(F.col("loan_amnt")).alias("loan_amnt"),
            clean(F.col("fico_score")).alias("fico_score"),
            percent(F.col("dti").cast("string"), strict=False).alias("dti"),
            F.coalesce("emp_length", F.lit(LENGTH_UNKNOWN)).alias("emp_length"),
            F.col("emp_length").isNull().cast("int").alias("emp_length_missing"),
            "state",
            "application_date",
            F.lit(None).cast("int").alias("default"),
        )
        .where("loan_amnt is not null and fico_score is not null")
    )
