"""Text, date and identifier parsing as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Month and day spellings seen in loan files, tried in this order.
DATE_FORMATS = ("MMM-yyyy", "yyyy-MM-dd", "yyyy-MM", "MM/dd/yyyy", "MMM-yy", "dd-MMM-yyyy")

# Fixed value: mean length of a month in days.
DAYS_PER_MONTH = 30.44

ID_PREFIX = "LC_"
MAX_ID_LENGTH = 64


def clean(value: Column) -> Column:
    """A double in which NaN has become NULL, the only missing value used here."""
    number = value.cast("double")
    return F.when(~F.isnan(number), number)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _integer(text: Column, strict: bool) -> Column:
    return text.cast("int") if strict else text.try_cast("int")


def term_months(text: Column, strict: bool = True) -> Column:
    """``" 36 months"`` -> 36."""
    return _integer(F.regexp_replace(strip(text), " months", ""), strict)


def employment_years(text: Column, strict: bool = True) -> Column:
    """``"10+ years"`` -> 10, ``"< 1 year"`` -> 0, ``"n/a"`` -> NULL, else the leading number."""
    body = strip(text)
    return (
        F.when(body.isNull() | (F.lower(body) == "n/a"), None)
        .when(body.startswith("< 1"), 0)
        .when(body.startswith("10+"), 10)
        .otherwise(_integer(F.regexp_extract(body, r"^(\S*)", 1), strict))
    )


def percent(text: Column, strict: bool = True) -> Column:
    """``"13.56%"`` -> 13.56. Strict text must be a number; lenient text turns to NULL."""
    body = strip(F.regexp_replace(text, "%", ""))
    return body.cast("double") if strict else body.try_cast("double")


def month_date(text: Column) -> Column:
    """A date from any of the known spellings; unknown text gives NULL."""
    return F.coalesce(*[F.try_to_date(text, fmt) for fmt in DATE_FORMATS])


def months_between_half_even(start: Column, end: Column) -> Column:
    """Whole months by mean month length, halves rounded to even."""
    return F.bround(F.datediff(end, start) / F.lit(DAYS_PER_MONTH), 0).cast("bigint")


def midpoint_half_even(low: Column, high: Column) -> Column:
    return F.bround((low.cast("double") + high.cast("double")) / 2, 0).cast("int")


def applicant_id(loan_id: Column) -> Column:
    return F.concat(F.lit(ID_PREFIX), loan_id.cast("bigint").cast("string"))


def loan_id(applicant: Column) -> Column:
    """The loan number inside an applicant id, NULL for every other text."""
    return F.regexp_extract(applicant, r"^LC_(\+?\d+|-0+)\z", 1).try_cast("bigint")


def applicant_id_problem(applicant: Column) -> Column:
    """Why an applicant id is refused; NULL for a good one. Length is in bytes."""
    return (
        F.when(applicant.isNull() | (applicant == ""), "applicant_id is required")
        .when(
            F.octet_length(applicant) > MAX_ID_LENGTH,
            f"applicant_id exceeds {MAX_ID_LENGTH} characters",
        )
        .when(
            ~applicant.rlike(r"^[A-Za-z0-9_-]+\z"),
            "applicant_id may contain only letters, digits, '_' and '-'",
        )
    )
