"""Calibrated probability -> scorecard points -> decision."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F

from riskframe.contract import DEFAULT, Contract

# 600 points at good:bad odds of 30:1, 20 points double the odds.
BASE_POINTS = 600.0
BASE_ODDS = 30.0
POINTS_TO_DOUBLE_ODDS = 20.0
PD_FLOOR = 1e-6

FACTOR = POINTS_TO_DOUBLE_ODDS / math.log(2)
OFFSET = BASE_POINTS - FACTOR * math.log(BASE_ODDS)


def points(pd: Column) -> Column:
    """Integer points, halves rounded up, finite at probabilities 0 and 1."""
    p = F.least(F.greatest(pd, F.lit(PD_FLOOR)), F.lit(1 - PD_FLOOR))
    return F.when(
        pd.isNotNull(),
        F.floor(F.lit(OFFSET) + F.lit(FACTOR) * F.log((1 - p) / p) + 0.5).cast("int"),
    )


def decision(pd: Column, contract: Contract = DEFAULT) -> Column:
    return (
        F.when(pd < contract.approve_below, "approve")
        .when(pd < contract.review_below, "review")
        .when(pd.isNotNull(), "decline")
    )


MANY_BREAKPOINTS = 100


def _searched(raw: Column, xs: list[float], ys: list[float]) -> Column:
    x, y = np.array(xs, float), np.array(ys, float)

    @F.pandas_udf("double")
    def search(values: pd.Series) -> pd.Series:
        v = values.to_numpy(dtype=float, na_value=np.nan)
        at = np.clip(np.searchsorted(x, v, "left"), 1, len(x) - 1)
        width = x[at] - x[at - 1]
        with np.errstate(divide="ignore", invalid="ignore"):
            slope = np.where(width > 0, (y[at] - y[at - 1]) / width, 0.0)
        out = np.where(width > 0, slope * (v - x[at - 1]) + y[at - 1], y[at])
        out = np.where(v == x[at], y[at], out)
        out = np.where(v <= x[0], y[0], np.where(v >= x[-1], y[-1], out))
        return pd.Series(out).where(~np.isnan(v), None)

    return search(raw.cast("double"))


def calibrated(raw: Column, xs: list[float], ys: list[float]) -> Column:
    """Piecewise-linear map through the breakpoints, flat beyond both ends.

    A balanced tree of comparisons picks the segment; with many breakpoints an
    Arrow function searches them instead, with the same results, so that the
    plan does not grow with the calibrator.
    """
    if not xs or len(xs) != len(ys) or any(a > b for a, b in zip(xs, xs[1:])):
        raise ValueError("breakpoints must be sorted and paired")
    if len(xs) > MANY_BREAKPOINTS:
        return _searched(raw, xs, ys)

    def segment(i: int) -> Column:
        if xs[i] == xs[i - 1]:
            return F.lit(float(ys[i]))
        slope = (ys[i] - ys[i - 1]) / (xs[i] - xs[i - 1])
        return F.lit(slope) * (raw - F.lit(float(xs[i - 1]))) + F.lit(float(ys[i - 1]))

    def choose(low: int, high: int) -> Column:
        # first index with xs[index] >= raw lies in [low, high]
        if low == high:
            return F.when(raw == F.lit(float(xs[low])), F.lit(float(ys[low]))).otherwise(segment(low))
        mid = (low + high) // 2
        return F.when(raw <= F.lit(float(xs[mid])), choose(low, mid)).otherwise(choose(mid + 1, high))

    inner = choose(1, len(xs) - 1) if len(xs) > 1 else F.lit(float(ys[0]))
    return (
        F.when(raw.isNull(), None)
        .when(raw <= F.lit(float(xs[0])), F.lit(float(ys[0])))
        .when(raw >= F.lit(float(xs[-1])), F.lit(float(ys[-1])))
        .otherwise(inner)
    )
