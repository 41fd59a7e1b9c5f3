"""Histograms and the shift statistics built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from riskframe.contract import DEFAULT, Contract
from riskframe.functions.binning import left_closed_bin, linspace
from riskframe.functions.parsing import clean
from riskframe.functions.numeric import round_away
from riskframe.operators.order import exact_quantiles

CLIP_FLOOR = 1e-6


def _all_bins(df: DataFrame, n: int) -> DataFrame:
    return df.sparkSession.range(n).select(F.col("id").cast("int").alias("bin"))


def histogram(df: DataFrame, value: str, edges: list[float], weight: str | None = None) -> DataFrame:
    """(bin, count) for every bin of [e_i, e_i+1), the last bin closed.

    Missing and out-of-range values are left out; empty bins count 0.
    """
    amount = F.sum(weight) if weight else F.count(F.lit(1))
    counts = (
        df.select(left_closed_bin(clean(F.col(value)), edges).alias("bin"), *([weight] if weight else []))
        .where("bin is not null")
        .groupBy("bin")
        .agg(amount.alias("n"))
    )
    return (
        _all_bins(df, len(edges) - 1)
        .join(counts, "bin", "left")
        .select("bin", F.coalesce("n", F.lit(0)).cast("bigint").alias("count"))
    )


def smoothed_shares(hist: DataFrame) -> DataFrame:
    """Add ``share`` = (count + 1) / (total + bins) to a (bin, count) frame."""
    size = hist.agg(F.struct(F.sum("count").alias("t"), F.count(F.lit(1)).alias("k"))).scalar()
    return hist.withColumn("share", (F.col("count") + 1) / (size["t"] + size["k"]))


def two_sided_histogram(
    expected: DataFrame, actual: DataFrame, value: str, edges: list[float]
) -> DataFrame:
    """(bin, expected_count, actual_count) with both sides counted in one aggregation."""
    both = expected.select(clean(F.col(value)).alias("v"), F.lit(1).alias("e")).unionByName(
        actual.select(clean(F.col(value)).alias("v"), F.lit(0).alias("e"))
    )
    counts = (
        both.select(left_closed_bin(F.col("v"), edges).alias("bin"), "e")
        .where("bin is not null")
        .groupBy("bin")
        .agg(F.sum("e").alias("ec"), F.sum(1 - F.col("e")).alias("ac"))
    )
    return (
        _all_bins(expected, len(edges) - 1)
        .join(counts, "bin", "left")
        .select(
            "bin",
            F.coalesce("ec", F.lit(0)).alias("expected_count"),
            F.coalesce("ac", F.lit(0)).alias("actual_count"),
        )
    )


def _share(count: str, total: Column, bins: Column, smoothing: str) -> Column:
    if smoothing == "laplace":
        return (F.col(count) + 1) / (total + bins)
    if smoothing == "clip":
        return F.greatest(F.try_divide(F.col(count), total), F.lit(CLIP_FLOOR))
    raise ValueError(f"unknown smoothing {smoothing!r}")


def psi_bins(two_sided: DataFrame, smoothing: str = "laplace") -> DataFrame:
    """Shares of both sides and the contribution of each bin."""
    size = two_sided.agg(
        F.struct(
            F.sum("expected_count").alias("e"),
            F.sum("actual_count").alias("a"),
            F.count(F.lit(1)).alias("k"),
        )
    ).scalar()
    return (
        two_sided.withColumn("expected_share", _share("expected_count", size["e"], size["k"], smoothing))
        .withColumn("actual_share", _share("actual_count", size["a"], size["k"], smoothing))
        .withColumn(
            "contribution",
            (F.col("actual_share") - F.col("expected_share"))
            * F.log(F.col("actual_share") / F.col("expected_share")),
        )
    )


def psi(
    expected: DataFrame,
    actual: DataFrame,
    value: str,
    bins: int = 10,
    smoothing: str = "laplace",
) -> DataFrame:
    """Population stability index over equal bins on [0, 1].

    ``laplace`` adds one to every bin (monitoring); ``clip`` floors the shares
    at 1e-6 (model comparison).
    """
    counted = two_sided_histogram(expected, actual, value, linspace(0.0, 1.0, bins + 1))
    return psi_bins(counted, smoothing).agg(F.sum("contribution").alias("psi"))


def csi(
    expected: DataFrame, actual: DataFrame, features: list[str], bins: int = 10
) -> DataFrame:
    """Characteristic stability index of every feature in one job.

    Edges are the distinct quantiles of both sides together. A feature without
    values, or with one value only, gets 0.
    """
    features = list(features)

    def side(df, flag):
        return df.select(*[clean(F.col(c)).alias(c) for c in features]).unpivot(
            [], features, "feature", "value"
        ).withColumn("e", F.lit(flag))

    rows = side(expected, 1).unionByName(side(actual, 0)).where("value is not null")
    values = rows.groupBy("feature", "value").agg(
        F.sum("e").alias("ec"), F.sum(1 - F.col("e")).alias("ac")
    )
    edges = exact_quantiles(
        values.withColumn("n", F.col("ec") + F.col("ac")),
        "value",
        [i / bins for i in range(bins + 1)],
        ["feature"],
        weight="n",
        group_limit=len(features),
        bounds_from=rows,
    ).select("feature", F.array_distinct("quantiles").alias("edges"))
    counted = (
        values.join(F.broadcast(edges), "feature")  # one row per feature
        .withColumn("bin", left_closed_bin(F.col("value"), F.col("edges"), bins + 1))
        .where("bin is not null")
        .groupBy("feature", "bin")
        .agg(
            F.sum("ec").alias("ec"), F.sum("ac").alias("ac"), F.max(F.size("edges") - 1).alias("k")
        )
    )
    # the edges are values of the data, but a bin may still be empty on both sides
    totals = counted.groupBy("feature").agg(
        F.sum("ec").alias("e"), F.sum("ac").alias("a"), F.max("k").alias("k"),
        F.expr("collect_list(struct(ec, ac))").alias("filled"),
    )
    expected_share, actual_share = "(b.ec + 1) / (e + k)", "(b.ac + 1) / (a + k)"
    per_feature = totals.selectExpr(
        "feature",
        f"""aggregate(filled, double(0), (s, b) ->
              s + ({actual_share} - {expected_share}) * ln(({actual_share}) / ({expected_share})))
            + (k - size(filled)) * (1 / (a + k) - 1 / (e + k)) * ln((e + k) / (a + k)) as csi""",
    )
    names = expected.sparkSession.createDataFrame([(f,) for f in features], "feature string")
    return names.join(per_feature, "feature", "left").select(
        "feature", F.coalesce("csi", F.lit(0.0)).alias("csi")
    )


def drifted_features(csi_rows: DataFrame, contract: Contract = DEFAULT) -> DataFrame:
    """Features whose index, rounded to 4, exceeds the threshold."""
    return csi_rows.withColumn("csi", round_away("csi", 4)).where(F.col("csi") > contract.csi_threshold)


def class_densities(
    df: DataFrame, features: list[str], label: str, bins: int = 50, clip: float = 0.99
) -> DataFrame:
    """Per (feature, label): equal-width density after cutting above the clip quantile."""
    features = list(features)
    rows = (
        df.select(F.col(label).cast("int").alias("label"), *[clean(F.col(c)).alias(c) for c in features])
        .unpivot(["label"], features, "feature", "value")
        .where("value is not null and label is not null")
    )
    keys = ["feature", "label"]
    values = rows.groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("n"))
    top = exact_quantiles(
        values, "value", [clip], keys, weight="n", group_limit=2 * len(features), bounds_from=rows
    ).select(*keys, F.get("quantiles", F.lit(0)).alias("top"))
    kept = values.join(F.broadcast(top), keys).where("value <= top").drop("top")
    extent = F.broadcast(  # one row per feature and class
        kept.groupBy(*keys).agg(
            F.min("value").alias("low"), F.max("value").alias("high"), F.sum("n").alias("total")
        )
    )
    # a single value gets a unit-wide extent around it
    low = F.when(F.col("low") == F.col("high"), F.col("low") - 0.5).otherwise(F.col("low"))
    high = F.when(F.col("low") == F.col("high"), F.col("high") + 0.5).otherwise(F.col("high"))
    binned = (
        kept.join(extent, keys)
        .select(*keys, "value", "n", "total", low.alias("low"), high.alias("high"))
        .withColumn("width", (F.col("high") - F.col("low")) / bins)
        .withColumn(
            "bin",
            F.least(F.floor((F.col("value") - F.col("low")) / F.col("width")), F.lit(bins - 1)).cast("int"),
        )
    )
    return binned.groupBy(*keys, "bin").agg(
        F.sum("n").alias("count"),
        (F.sum("n") / (F.max("total") * F.max("width"))).alias("density"),
    )
