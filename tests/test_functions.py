"""Column expressions against hand values."""

import math

import pytest
from pyspark.sql import functions as F

from riskframe.contract import Contract
from riskframe.functions import binning, parsing, scorecard
from riskframe.operators import gold


@pytest.mark.parametrize("text,want", [(" 36 months", 36), ("36 months", 36), (" 60 months ", 60), (None, None)])
def test_term(value, text, want):
    assert value(parsing.term_months(F.col("t")), t=text) == want


@pytest.mark.parametrize(
    "text,want",
    [("5 years", 5), ("1 year", 1), ("10+ years", 10), ("< 1 year", 0), (" N/A ", None), ("n/a", None), (None, None)],
)
def test_employment(value, text, want):
    assert value(parsing.employment_years(F.col("t")), t=text) == want


def test_percent(value):
    assert value(parsing.percent(F.col("t")), t=" 13.56% ") == 13.56
    assert value(parsing.percent(F.col("t"), strict=False), t="n/a") is None
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        value(parsing.percent(F.col("t")), t="n/a")


@pytest.mark.parametrize(
    "text,want",
    [("Dec-2015", "2015-12-01"), ("2015-12-03", "2015-12-03"), ("12/03/2015", "2015-12-03"), ("2015-12", "2015-12-01"), ("soon", None)],
)
def test_month_date(value, text, want):
    got = value(parsing.month_date(F.col("t")), t=text)
    assert (str(got) if got else None) == want


@pytest.mark.parametrize(
    "text,want",
    [("LC_68407277", 68407277), ("LC_0", 0), ("LC_0000042", 42), ("LC_", None), ("XX_1", None), ("LC_notanumber", None), ("LC_-5", None), ("", None)],
)
def test_loan_id(value, text, want):
    assert value(parsing.loan_id(F.col("t")), t=text) == want


@pytest.mark.parametrize("text,good", [("abc-123", True), ("A_b-9", True), ("", False), (" ", False), ("a;b", False), ("a'b", False), ("x" * 65, False), ("x" * 64, True), ("ab\n", False)])
def test_applicant_id_problem(value, text, good):
    assert (value(parsing.applicant_id_problem(F.col("t")), t=text) is None) == good


@pytest.mark.parametrize("low,high,want", [(660.0, 664.0, 662), (661.0, 664.0, 662), (663.0, 664.0, 664)])
def test_mid_fico_rounds_half_to_even(value, low, high, want):
    assert value(parsing.midpoint_half_even(F.col("a"), F.col("b")), a=low, b=high) == want


@pytest.mark.parametrize("pd,want", [(1 / 31, 600), (1 / 61, 620), (1 / 121, 640), (1 / 16, 580)])
def test_points(value, pd, want):
    assert value(scorecard.points(F.col("p")), p=pd) == want


def test_points_finite_at_the_ends(value):
    low, high = value(scorecard.points(F.col("p")), p=1.0), value(scorecard.points(F.col("p")), p=0.0)
    assert -1500 <= low < high <= 1500


@pytest.mark.parametrize("p,want", [(0.01, 0.05), (0.1, 0.05), (0.15, 0.075), (0.2, 0.1), (0.3, 0.2), (0.4, 0.3), (0.9, 0.3)])
def test_calibrated(value, p, want):
    assert value(scorecard.calibrated(F.col("p"), [0.1, 0.2, 0.4], [0.05, 0.1, 0.3]), p=p) == pytest.approx(want, abs=1e-15)


def test_calibrator_of_one_point_and_bad_ones(value):
    for p in (0.0, 0.5, 1.0):
        assert value(scorecard.calibrated(F.col("p"), [0.5], [0.2]), p=p) == 0.2
    for xs, ys in (([], []), ([0.2, 0.1], [0.1, 0.2]), ([0.1], [0.1, 0.2])):
        with pytest.raises(ValueError):
            scorecard.calibrated(F.col("p"), xs, ys)


def test_many_breakpoints_match_interpolation(spark):
    import numpy as np

    xs = [i / 300 for i in range(301)]
    ys = sorted((math.sin(i) + 1) / 2 for i in range(301))
    got = spark.range(997).select((F.col("id") / 990 - 0.002).alias("p")).select("p", scorecard.calibrated(F.col("p"), xs, ys).alias("y")).toPandas()
    np.testing.assert_allclose(got.y, np.interp(got.p, xs, ys), atol=1e-12)


@pytest.mark.parametrize("pd,want", [(0.1499, "approve"), (0.15, "review"), (0.2999, "review"), (0.30, "decline")])
def test_decision(value, pd, want):
    assert value(scorecard.decision(F.col("p")), p=pd) == want


@pytest.mark.parametrize("v,left,right,right_low", [
    (0.0, 0, None, 0), (0.5, 0, 0, 0), (1.0, 1, 0, 0), (2.0, 2, 1, 1), (3.0, 2, 2, 2), (-0.1, None, None, None), (3.5, None, None, None), (float("nan"), None, None, None)])
def test_bins(value, v, left, right, right_low):
    edges = [0.0, 1.0, 2.0, 3.0]
    array = F.array(*[F.lit(e) for e in edges])
    for e, n in ((edges, None), (array, 6)):
        assert value(binning.left_closed_bin(F.col("v"), e, n), v=v) == left
        assert value(binning.right_closed_bin(F.col("v"), e, n), v=v) == right
        assert value(binning.right_closed_bin(F.col("v"), e, n, include_lowest=True), v=v) == right_low


def test_linspace_keeps_float_steps():
    edges = binning.linspace(0.0, 1.0, 11)
    assert edges[3] == 3 * 0.1 and edges[3] != 0.3 and edges[-1] == 1.0


@pytest.mark.parametrize("g,want", [("A", 1), ("G", 7), ("H", None), ("", None), ("AB", None)])
def test_grade(value, g, want):
    assert value(gold.grade_number(F.col("g")), g=g) == want


@pytest.mark.parametrize("g,want", [("A1", 1), ("G5", 35), ("B3", 8), ("A", None), ("A10", None), (None, None)])
def test_sub_grade(value, g, want):
    assert value(gold.sub_grade_number(F.col("g")), g=g) == want


def test_contract_refuses_nonsense():
    for bad in ({"approve_below": 0.4}, {"psi_warning": 0.3}, {"dir_threshold": 1.2}, {"dir_worsen_tolerance": 0.9}, {"min_drift_scores": 0}):
        with pytest.raises(ValueError):
            Contract(**bad)


def test_generated_methods_stay_small_enough_to_be_compiled(spark):
    from riskframe.session import configure

    assert configure(spark).conf.get("spark.sql.codegen.hugeMethodLimit") == "8000"
