"""Silver -> model features, category codes and the time-aware split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from riskframe.functions.tables import CATEGORICAL_COLUMNS, FEATURES, GRADES, HOME_KEPT
from riskframe.operators.order import small_table

FEATURE_VERSION = 1
TRAIN_END = "2016-01-01"
VALIDATION_END = "2017-07-01"


def grade_number(grade: Column) -> Column:
    """A..G -> 1..7, anything else NULL."""
    return F.when((F.length(grade) == 1) & (F.instr(F.lit(GRADES), grade) > 0), F.instr(F.lit(GRADES), grade))


def sub_grade_number(sub_grade: Column) -> Column:
    """A1..G5 -> 1..35; text of another length is NULL, an unknown letter counts as 0."""
    letter = F.coalesce(grade_number(F.substring(sub_grade, 1, 1)), F.lit(0))
    return F.when(
        F.length(sub_grade) == 2, (letter - 1) * 5 + F.substring(sub_grade, 2, 1).cast("int")
    )


def above(value: Column, limit: float) -> Column:
    """1 above the limit, 0 otherwise and for NULL."""
    return F.coalesce((value > limit).cast("int"), F.lit(0))


def home_group(home: Column) -> Column:
    return F.when(home.isin(*HOME_KEPT), home).otherwise("OTHER")


def income_ratios(df: DataFrame) -> DataFrame:
    """log income, loan and payment burden relative to income, debt burden in thousands."""
    income = F.col("annual_inc")
    return df.withColumns(
        {
            "log_annual_inc": F.log1p(income),
            "loan_to_income": F.coalesce(F.col("loan_amnt") / F.nullif(income, F.lit(0.0)), F.lit(0.0)),
            "installment_to_income": F.coalesce(
                F.col("installment") / F.nullif(income / 12, F.lit(0.0)), F.lit(0.0)
            ),
            "dti_x_income": F.col("dti") * income / 1000,
        }
    )


def threshold_flags(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "delinq_ever": above(F.col("delinq_2yrs"), 0),
            "high_utilization": above(F.col("revol_util"), 75),
            "has_mortgage": above(F.col("mort_acc"), 0),
            "has_bankruptcy": above(F.col("pub_rec_bankruptcies"), 0),
        }
    )


def grade_numbers(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "grade_numeric": grade_number(F.col("grade")),
            "sub_grade_numeric": sub_grade_number(F.col("sub_grade")),
        }
    )


def fit_categories(df: DataFrame, columns=CATEGORICAL_COLUMNS) -> DataFrame:
    """(column, category, code): the sorted distinct values of each column from 0.

    The window sees distinct categories only.
    """
    columns = list(columns)
    found = (
        df.select(*[F.col(c).cast("string").alias(c) for c in columns])
        .unpivot([], columns, "column", "category")
        .where("category is not null")
        .distinct()
    )
    order = Window.partitionBy("column").orderBy("category")
    return found.withColumn("code", F.row_number().over(order) - 1)


def encode_categories(df: DataFrame, categories: DataFrame, columns=CATEGORICAL_COLUMNS) -> DataFrame:
    """Replace each category by its code; unseen and NULL become -1."""
    categories = small_table(categories)
    order = df.columns
    for c in columns:
        codes = categories.where(F.col("column") == c).select(
            F.col("category").alias(f"__{c}"), F.col("code").alias(f"__{c}_code")
        )
        df = df.join(codes, F.col(c).cast("string") == F.col(f"__{c}"), "left").withColumn(
            c, F.coalesce(f"__{c}_code", F.lit(-1))
        )
    return df.select(*order)


def decode_categories(
    df: DataFrame, column: str, categories: DataFrame | None, fallback: dict[int, str], label: str
) -> DataFrame:
    """Add the category text of a code; the fallback map serves when none was stored."""
    if categories is None:
        pairs = [F.lit(x) for item in fallback.items() for x in item]
        return df.withColumn(label, F.try_element_at(F.create_map(*pairs), F.col(column)))
    names = small_table(
        categories.where(F.col("column") == column).select(
            F.col("code").alias(column), F.col("category").alias(label)
        )
    )
    return df.join(names, column, "left")


def gold_features(silver: DataFrame, categories: DataFrame | None = None) -> DataFrame:
    """All model features as doubles, with id, issue month and target.

    ``categories`` is a stored encoding; without it one is fitted on the frame.
    """
    wide = grade_numbers(threshold_flags(income_ratios(silver))).withColumn(
        "home_ownership", home_group(F.col("home_ownership"))
    )
    if categories is None:
        categories = fit_categories(wide)
    return encode_categories(wide, categories).select(
        "id",
        "issue_d",
        F.col("default").cast("int").alias("default"),
        *[F.col(c).cast("double").alias(c) for c in FEATURES],
    )


def split_name(date: Column, train_end: str = TRAIN_END, validation_end: str = VALIDATION_END) -> Column:
    """train | val | test by date; NULL for an unknown date."""
    return (
        F.when(date < F.lit(train_end).cast("date"), "train")
        .when(date < F.lit(validation_end).cast("date"), "val")
        .when(date.isNotNull(), "test")
    )


def time_split(
    df: DataFrame, date: str = "issue_d", train_end: str = TRAIN_END, validation_end: str = VALIDATION_END
) -> DataFrame:
    """Add ``split`` and drop the date, which is no feature."""
    return (
        df.withColumn("split", split_name(F.col(date), train_end, validation_end))
        .where("split is not null")
        .drop(date)
    )
