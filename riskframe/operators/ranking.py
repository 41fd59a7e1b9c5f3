"""Ranking power: AUC, KS, curves, deciles and gains."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from riskframe.functions.binning import right_closed_bin
from riskframe.functions.parsing import clean
from riskframe.operators.order import exact_quantiles, range_index, running_sums


def _scored(df, label, score, groups, extra=()):
    return df.select(
        *groups, *extra, clean(F.col(score)).alias("score"), F.col(label).cast("int").alias("label")
    ).where("score is not null and label is not null")


def score_ranks(
    df: DataFrame, label: str, score: str, groups: list[str] = (), group_limit: int | None = None,
    bounds_from: DataFrame | None = None,
) -> DataFrame:
    """One row per distinct (groups, score) with class counts and running class counts.

    ``bounds_from`` is a cheaper frame with a like ``score`` column to balance by.
    """
    groups = list(groups)
    scored = _scored(df, label, score, groups)
    counts = scored.groupBy(*groups, "score").agg(
        F.sum("label").alias("pos"), F.sum(1 - F.col("label")).alias("neg")
    )
    balance = scored if bounds_from is None else bounds_from.select(clean(F.col(score)).alias("score"))
    return running_sums(counts, "score", ["pos", "neg"], groups, group_limit, bounds_from=balance)


def ranking_metrics(
    df: DataFrame, label: str, score: str, groups: list[str] = (), group_limit: int | None = None,
    bounds_from: DataFrame | None = None,
) -> DataFrame:
    """auc (ties count half), ks (never below 0) and gini per group; NULL with one class."""
    ranks = score_ranks(df, label, score, groups, group_limit, bounds_from)
    pos_total, neg_total = F.col("pos_total").cast("double"), F.col("neg_total").cast("double")
    both = (F.col("pos_total") > 0) & (F.col("neg_total") > 0)
    # F.max over one constant value per group keeps this a single aggregation
    won = F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2))
    auc = won / F.max(F.when(both, pos_total * neg_total))
    gap = F.when(both, F.col("neg_before") / neg_total - F.col("pos_before") / pos_total)
    return (
        ranks.groupBy(*groups)
        .agg(
            F.sum(F.col("pos") + F.col("neg")).alias("n"),
            auc.alias("auc"),
            F.greatest(F.max(gap), F.when(F.max(both.cast("int")) == 1, F.lit(0.0))).alias("ks"),
        )
        .withColumn("gini", 2 * F.col("auc") - 1)
    )


def roc_auc(df: DataFrame, label: str, score: str, groups: list[str] = ()) -> DataFrame:
    return ranking_metrics(df, label, score, groups).select(*groups, "auc")


def ks_statistic(df: DataFrame, label: str, score: str, groups: list[str] = ()) -> DataFrame:
    return ranking_metrics(df, label, score, groups).select(*groups, "ks")


def has_both_classes(df: DataFrame, label: str, groups: list[str] = ()) -> DataFrame:
    return df.groupBy(*groups).agg(
        F.coalesce(F.min(label) != F.max(label), F.lit(False)).alias("both_classes")
    )


def roc_points(df: DataFrame, label: str, score: str, groups: list[str] = ()) -> DataFrame:
    """(threshold, fpr, tpr) at every distinct score, and the (0, 0) start per group."""
    ranks = score_ranks(df, label, score, groups)
    points = ranks.select(
        *groups,
        F.col("score").alias("threshold"),
        ((F.col("neg_total") - F.col("neg_before")) / F.col("neg_total")).alias("fpr"),
        ((F.col("pos_total") - F.col("pos_before")) / F.col("pos_total")).alias("tpr"),
        # the lowest score of a group also carries its starting point
        ((F.col("neg_before") == 0) & (F.col("pos_before") == 0)).alias("lowest"),
    )
    start = points.where("lowest").select(
        *groups, F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")
    )
    return points.drop("lowest").unionByName(start)


def precision_recall_points(df: DataFrame, label: str, score: str, groups: list[str] = ()) -> DataFrame:
    """(threshold, precision, recall) at every distinct score, and the closing (1, 0) point."""
    ranks = score_ranks(df, label, score, groups)
    hits = F.col("pos_total") - F.col("pos_before")
    flagged = hits + F.col("neg_total") - F.col("neg_before")
    points = ranks.select(
        *groups,
        F.col("score").alias("threshold"),
        (hits / flagged).alias("precision"),
        (hits / F.col("pos_total")).alias("recall"),
        ((F.col("neg_before") == 0) & (F.col("pos_before") == 0)).alias("lowest"),
    )
    close = points.where("lowest").select(
        *groups,
        F.lit(None).cast("double").alias("threshold"),
        F.lit(1.0).alias("precision"),
        F.lit(0.0).alias("recall"),
    )
    return points.drop("lowest").unionByName(close)


def score_deciles(df: DataFrame, label: str, score: str) -> DataFrame:
    """Count, default rate and mean score per right-closed decile of the score.

    Equal edges are merged, empty bins are left out and the index counts the
    remaining bins from 0. A constant score gives no row.
    """
    scored = _scored(df, label, score, [])
    counts = scored.groupBy("score").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("pos"))
    edges = exact_quantiles(
        counts, "score", [i / 10 for i in range(11)], weight="n", bounds_from=scored
    ).select(F.array_distinct("quantiles").alias("edges"))
    bins = (
        counts.withColumn("edges", edges.scalar())
        .withColumn("bin", right_closed_bin(F.col("score"), F.col("edges"), 11, include_lowest=True))
        .where("bin is not null")
        .groupBy("bin")
        .agg(
            F.sum("n").alias("count"),
            (F.sum("pos") / F.sum("n")).alias("default_rate"),
            (F.sum(F.col("score") * F.col("n")) / F.sum("n")).alias("avg_score"),
        )
    )
    # at most ten rows from here on
    order = Window.partitionBy(F.lit(0)).orderBy("bin")
    return bins.select(
        (F.row_number().over(order) - 1).alias("decile"), "count", "default_rate", "avg_score"
    )


def rank_order_breaks(deciles: DataFrame, index: str = "decile", rate: str = "default_rate") -> DataFrame:
    """How many bins have a lower rate than the bin before (at most ten rows in)."""
    previous = F.lag(rate).over(Window.partitionBy(F.lit(0)).orderBy(index))
    return deciles.select((F.col(rate) < previous).alias("broken")).agg(
        F.count_if(F.coalesce(F.col("broken"), F.lit(False))).alias("rank_order_breaks")
    )


def _decile_of_rank(rank, total):
    """1-based decile of a 1-based rank, right-closed on evenly spaced rank edges."""
    # smallest k with (rank-1)*10 <= (total-1)*k, in whole numbers
    step = F.greatest(total - 1, F.lit(1))
    return F.greatest(F.floor(((rank - 1) * 10 + step - 1) / step), F.lit(1)).cast("int")


def gains_table(df: DataFrame, label: str, score: str, tie_break: str) -> DataFrame:
    """Ten equal groups by (score, tie_break) with capture of the positives.

    ``tie_break`` is a unique number. Rows sharing a score are counted in cells
    of (score, range of tie_break); only the cells that straddle a group border,
    at most nine, are ranked row by row.
    """
    rows = _scored(df, label, score, [], [tie_break])
    rows = rows.withColumn("cell", range_index(rows, tie_break))
    counts = rows.groupBy("score", "cell").agg(
        F.count(F.lit(1)).alias("n"), F.sum("label").alias("pos")
    )
    # order cells by (score, cell): running sums over scores, then over the cells of a score
    by_score = running_sums(
        counts.groupBy("score").agg(F.sum("n").alias("n")), "score", ["n"], bounds_from=rows
    ).select("score", F.col("n_before").alias("score_before"), "n_total")
    within = Window.partitionBy("score").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = (
        counts.withColumn("cell_before", F.coalesce(F.sum("n").over(within), F.lit(0)))
        .join(by_score, "score")
        .withColumn("before", F.col("score_before") + F.col("cell_before"))
        .withColumn("first", _decile_of_rank(F.col("before") + 1, F.col("n_total")))
        .withColumn("last", _decile_of_rank(F.col("before") + F.col("n"), F.col("n_total")))
        .select("score", "cell", "n", "pos", "before", "n_total", "first", "last")
    )
    whole = cells.where("first = last").select(F.col("first").alias("decile"), "score", "n", "pos")
    borders = F.broadcast(  # ten groups have nine borders
        cells.where("first <> last").select("score", "cell", "before", "n_total")
    )
    split = (
        rows.join(borders, ["score", "cell"])
        .withColumn(
            "rank",
            F.col("before")
            + F.row_number().over(Window.partitionBy("score", "cell").orderBy(tie_break)),
        )
        .select(
            _decile_of_rank(F.col("rank"), F.col("n_total")).alias("decile"),
            "score",
            F.lit(1).cast("bigint").alias("n"),
            F.col("label").cast("bigint").alias("pos"),
        )
    )
    table = (
        whole.unionByName(split)
        .groupBy("decile")
        .agg(
            F.sum("n").alias("count"),
            F.sum("pos").alias("n_defaults"),
            (F.sum("pos") / F.sum("n")).alias("default_rate"),
            (F.sum(F.col("score") * F.col("n")) / F.sum("n")).alias("avg_score"),
            F.min("score").alias("min_score"),
            F.max("score").alias("max_score"),
        )
    )
    upto = Window.partitionBy(F.lit(0)).orderBy("decile").rowsBetween(Window.unboundedPreceding, 0)
    return table.withColumn("cumulative_defaults", F.sum("n_defaults").over(upto)).withColumn(
        "capture_rate",
        F.col("cumulative_defaults") / F.sum("n_defaults").over(Window.partitionBy(F.lit(0))),
    )


def top_capture(gains: DataFrame, groups: int = 3) -> DataFrame:
    """Share of positives inside the highest ``groups`` score groups."""
    return gains.agg(
        (
            F.sum(F.when(F.col("decile") > 10 - groups, F.col("n_defaults")).otherwise(0))
            / F.sum("n_defaults")
        ).alias("top_capture")
    )
