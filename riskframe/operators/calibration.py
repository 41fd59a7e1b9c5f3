"""Calibration curves, Brier score and the isotonic calibrator."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from riskframe.functions.binning import clamped_right_closed_bin, left_closed_bin, linspace
from riskframe.functions.parsing import clean
from riskframe.operators.order import exact_quantiles, range_index
from riskframe.session import scratch_path


def _pairs(df, label, score):
    return df.select(
        clean(F.col(score)).alias("score"), F.col(label).cast("double").alias("label")
    ).where("score is not null and label is not null")


def calibration_curve(df: DataFrame, label: str, score: str, bins: int = 10) -> DataFrame:
    """Mean score and observed rate in equal-width right-closed bins on [0, 1]."""
    return (
        _pairs(df, label, score)
        .withColumn("bin", clamped_right_closed_bin(F.col("score"), linspace(0.0, 1.0, bins + 1)))
        .groupBy("bin")
        .agg(
            F.count(F.lit(1)).alias("count"),
            F.avg("score").alias("mean_predicted"),
            F.avg("label").alias("observed_rate"),
        )
    )


def reliability_table(df: DataFrame, label: str, score: str, bins: int = 10) -> DataFrame:
    """n, mean prediction and observed rate in quantile bins (left-closed, top closed).

    Equal edges are merged; a constant score gives one row.
    """
    pairs = _pairs(df, label, score)
    counts = pairs.groupBy("score").agg(
        F.count(F.lit(1)).alias("n"), F.sum("label").alias("positives")
    )
    edges = exact_quantiles(
        counts, "score", [i / bins for i in range(bins + 1)], weight="n", bounds_from=pairs
    ).select(F.array_distinct("quantiles").alias("edges"))
    return (
        counts.withColumn("edges", edges.scalar())
        .withColumn(
            "bin",
            F.when(F.size("edges") < 2, F.lit(0)).otherwise(
                left_closed_bin(F.col("score"), F.col("edges"), bins + 1)
            ),
        )
        .groupBy("bin")
        .agg(
            F.sum("n").alias("n"),
            (F.sum(F.col("score") * F.col("n")) / F.sum("n")).alias("mean_predicted"),
            (F.sum("positives") / F.sum("n")).alias("observed_rate"),
        )
    )


def brier_scores(df: DataFrame, label: str, scores: list[str]) -> DataFrame:
    """(series, brier) of several score columns in one pass."""
    y = F.col(label).cast("double")
    one = df.agg(*[F.avg(F.pow(clean(F.col(s)) - y, 2)).alias(s) for s in scores])
    return one.unpivot([], scores, "series", "brier")


def pooled(x: np.ndarray, s: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, ...]:
    """Adjacent violators pooled: (first x, last x, label sum, weight) of the blocks of points in order of x.

    Means are quotients of exact sums, so equal means are equal numbers and always pooled.
    """
    first, last, total, weight = [], [], [], []
    for a, b, v, k in zip(x[0].tolist(), x[1].tolist(), s.tolist(), w.tolist()):
        while total and total[-1] / weight[-1] >= v / k:
            a, v, k = first.pop(), v + total.pop(), k + weight.pop()
            last.pop()
        first.append(a), last.append(b), total.append(v), weight.append(k)
    return np.array(first), np.array(last), np.array(total), np.array(weight)


BLOCKS = "first double, last double, s double, w double"


BLOCKS_PER_RANGE = 50_000


def _pool(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("first")
    x = rows["first"].to_numpy(), rows["last"].to_numpy()
    return pd.DataFrame(dict(zip(("first", "last", "s", "w"), pooled(x, rows["s"].to_numpy(), rows["w"].to_numpy()))))


def _pooled_in(cut: DataFrame) -> DataFrame:
    """The blocks of every range pooled by themselves, with the range they lie in."""
    def pool(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return _pool(rows).assign(range=key[0])

    return cut.groupBy("range").applyInPandas(pool, BLOCKS + ", range int")


def _stored(blocks: DataFrame) -> DataFrame:
    path = scratch_path(blocks.sparkSession, "isotonic")
    blocks.write.parquet(path)
    return blocks.sparkSession.read.schema(blocks.schema).parquet(path)


def fit_isotonic(df: DataFrame, label: str, score: str, per_range: int = BLOCKS_PER_RANGE) -> DataFrame:
    """Breakpoints (x, y) of the isotonic fit of the label on the exact score.

    Rows are reduced to one per distinct score, cut into score ranges, and each range is pooled by itself. What then
    still falls lies across the borders of ranges, so the blocks are cut anew, with the borders of one round in the middle of the
    ranges of the next, until no range ends above where the next begins. A round that does not end a fall has pooled half a range
    into one block, so rounds are few. No task sees more than a range of blocks; of a range only its first and last
    mean are read. Every step ends in a breakpoint at its first and its last score.
    """
    points = (
        _pairs(df, label, score).groupBy("score").agg(F.sum("label").alias("s"), F.count(F.lit(1)).cast("double").alias("w"))
        .select(F.col("score").alias("first"), F.col("score").alias("last"), "s", "w")
    )
    blocks = _stored(_pooled_in(points.withColumn("range", range_index(points, "first").cast("int"))))
    mean, shift = F.col("s") / F.col("w"), 0.5
    while True:
        ends = blocks.groupBy("range").agg(
            F.min("first").alias("at"), F.min_by(mean, "first").alias("low"), F.max_by(mean, "first").alias("high"), F.count(F.lit(1)).alias("n")
        ).orderBy("at").collect()  # one row per range
        if all(a["high"] < b["low"] for a, b in zip(ends, ends[1:])):
            break
        n = -(-sum(r["n"] for r in ends) // per_range)
        bounds = blocks.agg(F.percentile_approx("first", [(i + shift) / n for i in range(0 if shift else 1, n)] or [0.0], 100 * n)).first()[0] if n > 1 else []
        bounds = sorted(set(bounds))
        index = F.size(F.filter(F.lit(bounds) if bounds else F.array().cast("array<double>"), lambda b: b <= F.col("first")))
        blocks = _stored(_pooled_in(blocks.drop("range").withColumn("range", index)))
        shift = 0.5 - shift
    return blocks.select(F.explode(F.array_distinct(F.array("first", "last"))).alias("x"), (F.col("s") / F.col("w")).alias("y"))


def calibrated_by_table(df: DataFrame, score: str, points: DataFrame, name: str = "calibrated_pd") -> DataFrame:
    """Add the piecewise-linear map through a table of breakpoints (x, y), of any size: flat beyond both ends.

    Distinct scores meet the breakpoints range by range; each range also gets the last breakpoint before it and the first one
    after it, and the values found are joined back on the score. A null or NaN score stays without a value; no breakpoints
    give none.
    """
    index = range_index(points, "x").cast("int")
    held = _stored(points.select(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).withColumn("range", index))
    ends = held.groupBy("range").agg(F.min(F.struct("x", "y")).alias("first"), F.max(F.struct("x", "y")).alias("last")).orderBy("range").collect()
    starts = [r["first"]["x"] for r in ends]
    before = {i: ends[i - 1]["last"] for i in range(1, len(ends))}
    after = {i: ends[i + 1]["first"] for i in range(len(ends) - 1)}
    after_all = df.sparkSession.sparkContext.broadcast(([r["range"] for r in ends], before, after))  # two points per range

    scores = df.select(clean(F.col(score)).alias("score")).where("score is not null").distinct()
    place = F.greatest(F.size(F.filter(F.lit(starts), lambda b: b <= F.col("score"))) - 1, F.lit(0)) if starts else F.lit(0)
    number = F.element_at(F.lit([r["range"] for r in ends]), place + 1) if ends else F.lit(0)

    def interpolate(key: tuple, rows: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        if not len(known):
            return pd.DataFrame({"score": rows["score"], "value": np.nan})
        ranges, before, after = after_all.value
        at = ranges.index(key[0])
        known = known.sort_values("x")
        x, y = known["x"].to_numpy(), known["y"].to_numpy()
        if at in before:
            x, y = np.r_[before[at]["x"], x], np.r_[before[at]["y"], y]
        if at in after:
            x, y = np.r_[x, after[at]["x"]], np.r_[y, after[at]["y"]]
        return pd.DataFrame({"score": rows["score"], "value": np.interp(rows["score"].to_numpy(), x, y)})

    asked = scores.withColumn("key", number.cast("int"))
    values = asked.groupBy("key").cogroup(held.groupBy("range")).applyInPandas(interpolate, "score double, value double")
    values = values.select(F.col("score").alias("__score"), F.nanvl("value", F.lit(None).cast("double")).alias(name))
    joined = df.withColumn("__raw", clean(F.col(score))).join(values, F.col("__raw") == F.col("__score"), "left")
    return joined.drop("__raw", "__score")


def breakpoints(points: DataFrame, max_points: int = 1_000_000) -> tuple[list[float], list[float]]:
    """The calibrator as two sorted lists; a calibrator is small by construction."""
    rows = points.select("x", "y").orderBy("x").limit(max_points + 1).collect()
    if not rows or len(rows) > max_points:
        raise ValueError(f"a calibrator needs 1..{max_points} breakpoints")
    return [r["x"] for r in rows], [r["y"] for r in rows]
