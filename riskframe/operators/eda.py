"""Descriptive tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from riskframe.functions.binning import right_closed_bin
from riskframe.functions.parsing import clean
from riskframe.operators.order import exact_quantiles

FICO_BANDS = [600.0, 650.0, 700.0, 750.0, 800.0, 850.0]


def rate_by(df: DataFrame, key: str, label: str) -> DataFrame:
    return (
        df.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.avg(F.col(label).cast("double")).alias("default_rate"), F.count(F.lit(1)).alias("count"))
    )


def rate_by_band(df: DataFrame, value: str, label: str, edges=FICO_BANDS) -> DataFrame:
    """Rate and count in right-closed bands; values outside are dropped."""
    names = [f"{int(a)}-{int(b)}" for a, b in zip(edges, edges[1:])]
    banded = df.select(
        F.get(
            F.array(*[F.lit(n) for n in names]), right_closed_bin(F.col(value).cast("double"), edges)
        ).alias("band"),
        label,
    )
    return rate_by(banded, "band", label)


def split_drift(df: DataFrame, label: str = "default", split: str = "split") -> DataFrame:
    """Rows, class counts and default rate per split."""
    return df.groupBy(split).agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(F.col(label).cast("bigint")).alias("defaults"),
        F.sum((1 - F.col(label)).cast("bigint")).alias("non_defaults"),
        F.avg(F.col(label).cast("double")).alias("default_rate"),
    )


def describe(df: DataFrame, features: list[str]) -> DataFrame:
    """count, mean, std, min, quartiles and max per feature, in one long pass."""
    features = list(features)
    rows = (
        df.select(*[clean(F.col(c)).alias(c) for c in features])
        .unpivot([], features, "feature", "value")
        .where("value is not null")
    )
    values = rows.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    quartiles = exact_quantiles(
        values, "value", [0.25, 0.5, 0.75], ["feature"], weight="n",
        group_limit=len(features), bounds_from=rows,
    )
    plain = rows.groupBy("feature").agg(
        F.count(F.lit(1)).alias("count"),
        F.avg("value").alias("mean"),
        F.stddev("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    return plain.join(F.broadcast(quartiles), "feature").select(  # one row per feature
        "feature", "count", "mean", "std", "min",
        F.get("quantiles", F.lit(0)).alias("p25"),
        F.get("quantiles", F.lit(1)).alias("p50"),
        F.get("quantiles", F.lit(2)).alias("p75"),
        "max",
    )


def co_moments(df: DataFrame, rows: list[str], columns: list[str]) -> DataFrame:
    """(a, b, n, corr): Pearson's correlation of each column in ``rows`` with each in ``columns``, over the rows that have both.

    One pass: a task keeps, for all pairs at once, how many rows have both values, both means and the centred sums of squares and
    products, as matrices that each batch updates; Spark merges them column by column. ``corr`` is null with fewer than two
    rows or without variance, NaN where a value is infinite.
    """
    names = list(dict.fromkeys([*rows, *columns]))
    left, right = [names.index(c) for c in rows], [names.index(c) for c in columns]
    shape = (6, len(rows), len(columns))  # n, mean of a, mean of b, squares of a, squares of b, products; infinite pairs apart

    def merged(m: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Chan's update of the moments of two sets of rows."""
        n = m[0] + k[0]
        share = np.divide(k[0], n, out=np.zeros_like(n), where=n > 0)
        da, db, both = k[1] - m[1], k[2] - m[2], m[0] * share
        return np.stack([n, m[1] + da * share, m[2] + db * share, m[3] + k[3] + da * da * both, m[4] + k[4] + db * db * both, m[5] + k[5] + da * db * both])

    def of_batch(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        endless = np.isinf(x)
        there = ~np.isnan(x)
        own = (there & ~endless).astype(float)
        shift = np.where(own > 0, x, 0).sum(axis=0) / np.maximum(own.sum(axis=0), 1)
        z = np.where(own > 0, x - shift, 0.0)
        za, zb, ma, mb = z[:, left], z[:, right], own[:, left], own[:, right]
        n = ma.T @ mb
        some = np.maximum(n, 1)
        sa, sb = za.T @ mb, ma.T @ zb
        moments = np.stack([
            n, sa / some + shift[left][:, None], sb / some + shift[right][None, :], (za * za).T @ mb - sa * sa / some,
            ma.T @ (zb * zb) - sb * sb / some, za.T @ zb - sa * sb / some,
        ])
        both = there.astype(float)
        odd = endless.astype(float)
        return moments, odd[:, left].T @ both[:, right] + both[:, left].T @ odd[:, right]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total, odd = np.zeros(shape), np.zeros(shape[1:])
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns])
            moments, infinite = of_batch(x)
            total, odd = merged(total, moments), odd + infinite
        data = [np.vstack([total[:, i], odd[None, i]]).tobytes() for i in range(shape[1])]
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(shape[1]), pa.int32()), pa.array([TaskContext.get().partitionId()] * shape[1], pa.int64()), pa.array(data, pa.binary())],
            ["row", "task", "moments"],
        )

    def join(table: pa.Table) -> pa.Table:
        total, odd = np.zeros((6, 1, shape[2])), np.zeros(shape[2])
        parts = table.column("moments").combine_chunks()
        for i in np.argsort(table.column("task").to_numpy()):  # the same sum whatever order the parts arrive in
            part = np.frombuffer(parts[int(i)].as_buffer()).reshape(7, shape[2])
            total, odd = merged(total, part[:6, None, :]), odd + part[6]
        n, at, bt, a, b, ab = total[:, 0]
        with np.errstate(invalid="ignore", divide="ignore"):
            corr = np.where(odd > 0, np.nan, ab / np.sqrt(a * b))
        # below the rounding of the values themselves there is no variance
        known = (odd > 0) | (n > 1) & (a > n * (1e-13 * at) ** 2) & (b > n * (1e-13 * bt) ** 2)
        values = [float(v) if k else None for v, k in zip(np.where(odd > 0, corr, np.clip(corr, -1, 1)), known)]
        name = rows[table.column("row")[0].as_py()]
        return pa.table({
            "a": pa.array([name] * shape[2], pa.string()), "b": pa.array(columns, pa.string()),
            "n": pa.array((n + 0.5).astype(np.int64)), "corr": pa.array(values, pa.float64()),
        })

    inputs = df.select(*[clean(F.col(c)).alias(f"c{i}") for i, c in enumerate(names)])
    parts = inputs.mapInArrow(count, "row int, task long, moments binary")
    return parts.groupBy("row").applyInArrow(join, "a string, b string, n long, corr double")


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, corr) for every unordered pair of different columns, in one pass."""
    place = F.create_map(*[x for i, c in enumerate(columns) for x in (F.lit(c), F.lit(i))])
    both = co_moments(df, columns, columns)
    return both.where(place[F.col("a")] < place[F.col("b")]).select("a", "b", "corr")


def top_correlations(df: DataFrame, features: list[str], target: str, n: int = 15) -> DataFrame:
    """The n features with the largest absolute correlation with the target."""
    found = co_moments(df, [target], features).select(F.col("b").alias("feature"), "corr")
    return found.where("corr is not null and not isnan(corr)").orderBy(F.abs("corr").desc(), "feature").limit(n)
