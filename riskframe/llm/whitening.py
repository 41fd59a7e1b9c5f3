"""Embedding whitening by mixed-precision refinement.

The covariance is summed by Spark from integers, centred by the rounded mean before they are multiplied, so it does not
depend on the order of the sums. Its eigenvectors are found in float32 and then corrected by the matrix products of Ogita
and Aishima in extended precision, each round doubling the right digits. Eigenvalues too close for a round to part
are rotated among themselves by the eigenvectors of their small block first. What reaches the driver is d sums and d * d products.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from riskframe.llm.common import stored
from riskframe.llm.vectors import largest, matrix, scaled, usable

ROUNDS = 12
WIDEST = 256  # dimensions up to which the last rounds use extended precision; beyond, double
LONG = 1 << 63


# ---------------------------------------------------------------- eigenvectors

def _groups(values: np.ndarray, gap: float) -> list[np.ndarray]:
    """Positions of sorted eigenvalues in runs whose neighbours lie within the gap."""
    cuts = np.flatnonzero(np.abs(np.diff(values)) > gap) + 1
    return np.split(np.arange(len(values)), cuts)


def refined(a: np.ndarray, x: np.ndarray, kind=np.longdouble, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and eigenvectors of the symmetric matrix ``a`` from approximate eigenvectors ``x``, with
    products taken in the precision ``kind``.

    With R = I - X'X and S = X'AX a round adds X E, where E takes the error along each pair of columns from S and R, or R / 2
    within a cluster of eigenvalues. A cluster is solved on its own block S - m I with its centre m taken off, and X
    is turned by that solution. Ends when neither R nor the parted entries of S still change.
    """
    a, x = a.astype(kind), x.astype(kind)
    d, one = len(a), np.eye(len(a), dtype=kind)
    scale = max(float(np.abs(a).sum(axis=1).max()), np.finfo(float).tiny)
    small, before = 4 * float(np.finfo(kind).eps) * d, math.inf
    for _ in range(rounds):
        r, s = one - x.T @ x, x.T @ (a @ x)
        values = np.diagonal(s) / (1 - np.diagonal(r))
        order = np.argsort(-values, kind="stable")
        if (order != np.arange(d)).any():
            x, values, r, s = x[:, order], values[order], r[np.ix_(order, order)], s[np.ix_(order, order)]
        off = s - np.diag(values)
        gap = 2 * float(np.linalg.norm(off.astype(float)) + scale * np.linalg.norm(r.astype(float)))
        gap = max(gap, 64 * float(np.finfo(float).eps) * scale)
        label = np.empty(d, int)
        turned = False
        for k, at in enumerate(_groups(values.astype(float), gap)):
            label[at] = k
            if len(at) > 1:
                # the block's own eigenvectors, with the orthogonality error of its columns in the metric
                centre = values[at].mean()
                block = (s[np.ix_(at, at)] - centre * (one - r)[np.ix_(at, at)]).astype(float)
                level = np.abs(block).max()
                if level > 0 and np.abs(block - np.diag(np.diagonal(block))).max() > small * scale:
                    _, turn = np.linalg.eigh((block + block.T) / (2 * level))
                    x[:, at] = x[:, at] @ turn[:, ::-1].astype(kind)
                    turned = True
        if turned:
            r, s = one - x.T @ x, x.T @ (a @ x)
            values = np.diagonal(s) / (1 - np.diagonal(r))
        apart = np.abs(values[None, :] - values[:, None])
        near = (label[:, None] == label[None, :]) & (apart <= gap)
        with np.errstate(divide="ignore", invalid="ignore"):
            e = np.where(near | (apart == 0), r / 2, (s + values[None, :] * r) / (values[None, :] - values[:, None]))
        np.fill_diagonal(e, np.diagonal(r) / 2)
        x = x + x @ e
        change = float(np.abs(e).max()) if d else 0.0
        if change <= small or (change >= before / 2 and change < 1e-15):
            break
        before = change
    for _ in range(3):  # vectors of close eigenvalues may still lean on each other: only R, without a choice of directions
        x = x + x @ ((one - x.T @ x) / 2)
    values = np.diagonal(x.T @ (a @ x)) / np.diagonal(x.T @ x)
    order = np.argsort(-values, kind="stable")
    return values[order].astype(float), x[:, order].astype(float)


def eigen(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and unit eigenvectors of a covariance, to double precision.

    Each vector's largest entry is made positive, so a rerun gives the same signs. A matrix of zeros has unit vectors.
    """
    d = len(v)
    level = float(np.abs(v).max()) if d else 0.0
    if not level:
        return np.zeros(d), np.eye(d)
    unit = v / level
    _, rough = np.linalg.eigh(unit.astype(np.float32))
    values, vectors = refined(unit, rough[:, ::-1], np.float64)
    if d <= WIDEST:
        values, vectors = refined(unit, vectors)
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(d)])
    return np.maximum(values, 0.0) * level, vectors * signs


# ---------------------------------------------------------------- distributed sums

def _summed(rows: DataFrame, dims: int, run) -> np.ndarray:
    """Sum over all tasks of the arrays that ``run`` makes of a batch: width * dims numbers."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            made = run(matrix(batch.column(0), dims))
            total = made if total is None else total + made
        if total is not None:
            flat = total.ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat)), pa.int64()), pa.array(flat, pa.float64())], ["at", "v"])

    found = rows.select("x").mapInArrow(partial, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(max((r["at"] for r in found), default=-1) + 1)
    for r in found:
        out[r["at"]] = r["v"]
    return out


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over the dimensions of (n * x - S) squared, exact; null past the long range."""
    reach = n * largest(x) + max(map(abs, sums), default=0)
    if reach * reach * len(sums) < LONG / 2:
        y = n * x - np.array(sums, np.int64)
        return (y * y).sum(axis=1).tolist()
    y = n * x.astype(object) - np.array(sums, object)
    return [t if t < LONG else None for t in (y * y).sum(axis=1).tolist()]


@dataclass(frozen=True)
class Whitening:
    """What is fitted: n vectors, their sums, and the leading eigenvalues, unit vectors and shares of the trace."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    explained: np.ndarray

    def project(self, x: np.ndarray) -> np.ndarray:
        """The whitened components of integer rows; a component without variance is 0."""
        mean = np.array([s / self.n for s in self.sums]) if self.n else np.zeros(0)
        with np.errstate(divide="ignore", invalid="ignore"):
            inverse = np.where(self.values > 0, 1 / np.sqrt(self.values), 0.0)
        return ((x - mean) @ self.vectors) * inverse


def fit(points: DataFrame, components: int = 4) -> Whitening:
    """Fit on the distinct rows of the column ``x`` (array of longs) of a stored frame."""
    shape = points.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size("x")), F.lit(0)).alias("d")).first()
    n, d = shape["n"], shape["d"]
    if not n or not d:
        return Whitening(n, [0] * d, np.zeros(0), np.zeros((d, 0)), np.zeros(0))
    each = points.select(F.posexplode("x").alias("at", "v")).groupBy("at").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("s"))
    sums = [0] * d
    for r in each.collect():  # one row per dimension
        sums[r["at"]] = int(r["s"])
    middle = np.array([min(max(round(s / n), -LONG), LONG - 1) for s in sums], np.int64)

    def outer(x: np.ndarray) -> np.ndarray:
        y = x.astype(np.float64) - middle  # integers: exact, like their products and sums while below 2^53
        return np.vstack([y.sum(axis=0), y.T @ y])

    total = _summed(points, d, outer).reshape(d + 1, d)
    rest = total[0] / n
    covariance = total[1:] / n - np.outer(rest, rest)
    values, vectors = eigen((covariance + covariance.T) / 2)
    # eigenvalues below the rounding of the covariance are no variance
    values = np.where(values > 8 * d * np.finfo(float).eps * values[0], values, 0.0)
    k, trace = min(components, d), float(np.trace(covariance))
    return Whitening(n, sums, values[:k], vectors[:, :k], values[:k] / trace if trace > 0 else np.zeros(k))


def identity_error(points: DataFrame, model: Whitening) -> float:
    """The largest absolute entry of the whitened points' covariance minus the identity."""
    k = len(model.values)
    if not model.n or not k:
        return 0.0

    def outer(x: np.ndarray) -> np.ndarray:
        w = model.project(x)
        return np.vstack([w.sum(axis=0), w.T @ w])

    total = _summed(points, len(model.sums), outer).reshape(k + 1, k) / model.n
    return float(np.abs(total[1:] - np.outer(total[0], total[0]) - np.eye(k)).max())


def whitened(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = 4, scale: int = 256) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error), one row per row of the input and component.

    The fit list is every distinct integer vector once. A row whose vector is null or holds null, NaN or an infinity
    takes no part and gives no rows; one with a null or repeated id is a row like any other. Vectors shorter than the
    longest are padded by zeros, an empty one is all zeros; fewer dimensions than components give as many components as there
    are dimensions. A component without variance (one distinct vector, say) has whitened 0 and explained 0, and the
    identity error says 1. ``deviation`` is exact, and null where it does not fit in a long. Other columns play
    no part; no rows give no rows.
    """
    kind = dict(df.select(F.col(vec_id).alias("i")).dtypes)["i"]
    bare = usable(df.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("v")), "v")
    rows = stored(bare.select("vec_id", scaled("v", scale).alias("x")), "whitening-rows")
    longest = rows.agg(F.coalesce(F.max(F.size("x")), F.lit(0))).first()[0]
    padded = rows.select(F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(longest) - F.size("x"))).alias("x"))
    points = stored(padded.distinct(), "whitening-points")
    model = fit(points, components)
    error = identity_error(points, model)
    d, k = len(model.sums), len(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(1), d)
            rows = len(x)
            far = _deviations(x, model.n, model.sums)
            each = np.repeat(np.arange(rows), k)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                    pa.array(np.full(rows * k, model.n), pa.int64()), pa.array([far[i] for i in each], pa.int64()),
                    pa.array(model.project(x).ravel(), pa.float64()), pa.array(np.tile(model.explained, rows), pa.float64()),
                    pa.array(np.full(rows * k, error), pa.float64()),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(
        run, f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    )
