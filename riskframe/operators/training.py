"""Carve-out, boosted trees, export, permutation importance, reject inference."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from riskframe.functions.parsing import clean
from riskframe.operators.bitscore import Scorer
from riskframe.operators.boosting import Boosted, BoostingParameters, boost
from riskframe.operators.history import row_positions
from riskframe.operators.joins import augmented_rows
from riskframe.operators.order import exact_quantiles, range_bounds
from riskframe.operators.silver import median_values
from riskframe.operators.trees import Ensemble, load_ensemble, with_probability, with_raw_score

# The two parameter sets, champion first.
CHAMPION = BoostingParameters(trees=1000, depth=6, learning_rate=0.05, min_rows=20, leaves=63, ridge=1.0)
CHALLENGER = BoostingParameters(trees=1200, depth=7, learning_rate=0.03, min_rows=30, leaves=63, ridge=2.0)

COUNTED_ROWS = 65_536  # scored rows whose distinct values are counted together


def carve_out(df: DataFrame, label: str, key: str, fraction: float | Column, seed: int = 42) -> DataFrame:
    """Add ``held_out``: per label, the rows with the lowest key hashes, as many as
    the fraction asks for. Exact, repeatable and stratified."""
    placed = row_positions(df, key, seed, [label], group_limit=16)
    share = fraction if isinstance(fraction, Column) else F.lit(float(fraction))
    return placed.withColumn(
        "held_out", F.col("position") < F.round(F.col("size") * share)
    ).drop("position", "size")


def early_stopping_rows(train: DataFrame, validation: DataFrame, label: str, key: str, seed: int = 42) -> DataFrame:
    """Train and validation together, with as large a carve-out as the validation share."""
    both = train.withColumn("__v", F.lit(0)).unionByName(validation.withColumn("__v", F.lit(1)))
    share = both.agg(F.avg("__v")).scalar()
    return carve_out(both.drop("__v"), label, key, share, seed)


def train_boosted(
    rows: DataFrame, features: list[str], label: str, held_out: str = "held_out",
    parameters: BoostingParameters = CHAMPION, weight: str | None = None,
) -> Boosted:
    """Boosted trees on the rows outside the carve-out, cut after the tree where the carve-out's AUC is best.

    Trees are added until that AUC has not risen for the patience; nothing is fitted twice. A carve-out without both
    labels keeps all trees.
    """
    return boost(rows, features, label, held_out, parameters, weight)


def export_nodes(spark, model: Boosted) -> DataFrame:
    """The node table of a fitted model: thresholds on the features, leaf values and their sums in log-odds."""
    return model.nodes(spark)


def verify_export(rows: DataFrame, model: Boosted, nodes: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Largest difference between the model and its exported nodes; refuses a mismatch.

    The model scores the rows as it was trained, walking its trees over bin numbers; the nodes score them by their thresholds.
    """
    features, shipped = model.features, rows.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def walked(values: pd.DataFrame) -> pd.Series:
        own = shipped.value
        x = values.to_numpy(dtype=float, na_value=np.nan)
        return pd.Series(1 / (1 + np.exp(-own.raw(own.bins.codes([x[:, k] for k in range(x.shape[1])])))))

    scored = rows.select(*features, walked(F.struct(*[clean(F.col(f)).alias(f) for f in features])).alias("__p"))
    again = with_probability(scored, load_ensemble(nodes), "__q")
    result = again.agg(F.max(F.abs(F.col("__p") - F.col("__q"))).alias("max_difference"), F.count(F.lit(1)).alias("rows"))
    return result.select(
        F.when(F.col("max_difference") > tolerance, F.raise_error(F.lit("exported trees do not reproduce the model")))
        .otherwise(F.col("max_difference")).alias("max_difference"),
        "rows",
    )


def _variant_counts(paired: DataFrame, ensemble: Ensemble, used: list[str], repeat: int, bounds: list[float]) -> DataFrame:
    """Distinct log-odds of the rows as they are (variant 0) and with each used feature from the donor, with their counts of
    both labels, packed per range of the log-odds. Every pair is scored once."""
    spark, place = paired.sparkSession, [1 + ensemble.features.index(f) for f in used]
    shipped, n, cuts = spark.sparkContext.broadcast(Scorer(ensemble.trees, ensemble.features, ensemble.baseline)), len(used), np.array(bounds)

    def counted(raw: np.ndarray, label: np.ndarray) -> Iterator[tuple]:
        order = np.argsort(raw)
        value, bad = raw[order], np.cumsum(label[order])
        last = np.flatnonzero(np.append(value[1:] != value[:-1], True))
        value, bad, rows = value[last], np.diff(bad[last], prepend=0), np.diff(last, prepend=-1)
        edges = [0, *np.searchsorted(value, cuts, "left"), len(value)]
        for at, (lo, hi) in enumerate(zip(edges, edges[1:])):
            if hi > lo:
                yield at, value[lo:hi].tobytes(), bad[lo:hi].astype(np.int32).tobytes(), (rows - bad)[lo:hi].astype(np.int32).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, model = [], 0, shipped.value

        def packed() -> pa.RecordBatch:
            raws, labels = (np.concatenate(p) for p in zip(*held))
            found = [(k, *part) for k in range(n + 1) for part in counted(raws[:, k], labels)]
            columns = [pa.array(c, t) for c, t in zip(zip(*found), (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))]
            return pa.RecordBatch.from_arrays([pa.array([repeat] * len(found), pa.int32()), *columns], ["repeat", "variant", "part", "v", "pos", "neg"])

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns]
            x = np.column_stack(columns[1:n + 1])
            donor = np.column_stack(columns[n + 1:])
            held.append((model.raw_with_donors(x, donor)[:, [0, *place]], columns[0].astype(np.int64)))
            size += batch.num_rows
            if size >= COUNTED_ROWS:
                yield packed()
                held, size = [], 0
        if size:
            yield packed()

    return paired.mapInArrow(run, "repeat int, variant int, part int, v binary, pos binary, neg binary")


def _variant_wins(counts: DataFrame) -> DataFrame:
    """Rows of both labels per (repeat, variant, part), and the pairs inside it that are in order; ties count half."""

    def ranked(table: pa.Table) -> pa.Table:
        v = np.concatenate([np.frombuffer(a.as_buffer()) for a in table.column("v")])
        pos, neg = (np.concatenate([np.frombuffer(a.as_buffer(), np.int32) for a in table.column(c)]).astype(np.int64) for c in ("pos", "neg"))
        order = np.argsort(v)
        v, pos, neg = v[order], pos[order], neg[order]
        first = np.flatnonzero(np.append(True, v[1:] != v[:-1]))
        pos, neg = np.add.reduceat(pos, first), np.add.reduceat(neg, first)
        won = float(np.sum(pos * (np.cumsum(neg) - neg + neg / 2)))
        key = [pa.array([table.column(c)[0].as_py()], pa.int32()) for c in ("repeat", "variant", "part")]
        return pa.Table.from_arrays([*key, pa.array([int(pos.sum())]), pa.array([int(neg.sum())]), pa.array([won])], ["repeat", "variant", "part", "pos", "neg", "won"])

    return counts.groupBy("repeat", "variant", "part").applyInArrow(ranked, "repeat int, variant int, part int, pos long, neg long, won double")


def permutation_importance(
    df: DataFrame, ensemble: Ensemble, features: list[str], label: str, key: str,
    repeats: int = 5, seed: int = 42,
) -> DataFrame:
    """(feature, importance): mean AUC loss when one feature comes from another row.

    Each repeat puts the rows into a random circle and gives every row the next
    row as its donor: one join per repeat serves all features. The variants of
    a row are scored in place, once; their log-odds are counted per distinct value in the tasks that
    score them, and ranked per repeat, variant and range of values.
    """
    used = [f for f in ensemble.features if f in set(features)]
    inputs = ensemble.features
    rows = df.select(key, F.col(label).cast("int").alias("label"), *[clean(F.col(f)).alias(f) for f in inputs])
    bounds = range_bounds(with_raw_score(rows, ensemble, "raw").select("raw"), "raw") if used else []
    wins = None
    for repeat in range(repeats if used else 0):
        placed = row_positions(rows, key, seed + repeat)
        donors = placed.select(
            F.pmod(F.col("position") + 1, F.col("size")).alias("position"),
            *[F.col(f).alias(f"donor_{f}") for f in inputs],
        )
        paired = placed.join(donors, "position").where("label is not null").select("label", *inputs, *[f"donor_{f}" for f in inputs])
        one = _variant_counts(paired, ensemble, used, repeat, bounds)
        wins = one if wins is None else wins.unionByName(one)
    names = df.sparkSession.createDataFrame([(f,) for f in features], "feature string")
    if wins is None:
        return names.withColumn("importance", F.lit(0.0))
    # from here on one row per repeat, variant and part
    variant = Window.partitionBy("repeat", "variant")
    below = variant.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    auc = (
        _variant_wins(wins).withColumn("won", F.col("won") + F.col("pos") * F.coalesce(F.sum("neg").over(below), F.lit(0)))
        .groupBy("repeat", "variant")
        .agg(F.try_divide(F.sum("won"), F.sum("pos").cast("double") * F.sum("neg")).alias("auc"))
        .withColumn("base", F.max(F.when(F.col("variant") == 0, F.col("auc"))).over(Window.partitionBy("repeat")))
    )
    found = (
        auc.where("variant > 0")
        .groupBy(F.element_at(F.array(*[F.lit(f) for f in used]), F.col("variant")).alias("feature"))
        .agg(F.avg(F.col("base") - F.col("auc")).alias("importance"))
    )
    return names.join(F.broadcast(found), "feature", "left").select(
        "feature", F.coalesce("importance", F.lit(0.0)).alias("importance")
    )


def importance_shift(before: DataFrame, after: DataFrame) -> DataFrame:
    """Change of importance per feature, also relative where the base is not tiny."""
    base = F.abs("accepted_only")
    return (
        before.select("feature", F.col("importance").alias("accepted_only"))
        .join(after.select("feature", F.col("importance").alias("augmented")), "feature")
        .withColumn("shift", F.col("augmented") - F.col("accepted_only"))
        .withColumn("relative_shift_pct", F.when(base > 1e-4, F.col("shift") / base * 100))
    )


# ---------------------------------------------------------------- reject inference

REJECT_MULTIPLIER = 2.0
REJECT_CAP = 0.60
REJECT_WEIGHT = 0.3


def align_rejected(rejected: DataFrame, train: DataFrame, features: list[str], key: str) -> DataFrame:
    """Rejected rows in the feature space: shared columns kept, the rest training medians."""
    medians = median_values(train, features)
    shared = set(rejected.columns)

    def value(f: str) -> Column:
        fill = F.lit(medians.get(f)).cast("double")
        return F.coalesce(clean(F.col(f)), fill) if f in shared else fill

    return rejected.select(key, *[value(f).alias(f) for f in features])


def reject_rate(train: DataFrame, label: str = "default") -> DataFrame:
    return train.agg(
        F.least(F.avg(F.col(label).cast("double")) * REJECT_MULTIPLIER, F.lit(REJECT_CAP)).alias("rate")
    )


def pseudo_labels(scored: DataFrame, score: str, rate: float) -> DataFrame:
    """Label 1 for the riskiest share: scores at or above the (1 - rate) quantile."""
    cut = exact_quantiles(scored, score, [1 - rate]).select(F.get("quantiles", F.lit(0))).scalar()
    return scored.withColumn("default", (F.col(score) >= cut).cast("int"))


def train_augmented(
    accepted: DataFrame, rejected: DataFrame, validation: DataFrame, features: list[str],
    label: str, key: str, parameters: BoostingParameters = CHAMPION, seed: int = 42,
):
    """Fit on observed and pseudo-labelled rows; return the fit and the carve-out
    rows with observed labels only, which alone may feed a calibrator."""
    columns = [key, *features, label]
    rows = augmented_rows(
        accepted.select(*columns), rejected.select(*columns), validation.select(*columns), REJECT_WEIGHT
    )
    n_val, n_all = validation.count(), rows.count()
    carved = carve_out(rows, label, key, n_val / n_all, seed)
    fitted = train_boosted(carved, features, label, "held_out", parameters, "weight")
    return fitted, carved.where("held_out and not is_pseudo").select(*columns)
