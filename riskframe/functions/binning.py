"""Bin indexes by comparing a value with a short list of edges.

The edges are either Python floats or an array column of at most ``n_edges``
elements. Each edge becomes one comparison, so the whole index stays inside
generated code (no higher-order function, no ``width_bucket`` rescaling).
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, functions as F


def linspace(low: float, high: float, n: int) -> list[float]:
    """n evenly spaced edges as low + i*step in doubles, with an exact last edge."""
    step = (high - low) / (n - 1)
    return [low + i * step for i in range(n - 1)] + [float(high)]


def edge_columns(edges, n_edges: int | None = None) -> list[Column]:
    if isinstance(edges, Column):
        return [F.get(edges, F.lit(i)) for i in range(n_edges)]
    return [F.lit(float(e)) for e in edges]


def _count(conditions) -> Column:
    return reduce(add, [F.coalesce(c.cast("int"), F.lit(0)) for c in conditions])


def _shape(edges, n_edges):
    if isinstance(edges, Column):
        size = F.size(edges)
        return size, F.get(edges, F.lit(0)), F.get(edges, size - 1)
    return F.lit(len(edges)), F.lit(float(edges[0])), F.lit(float(edges[-1]))


def left_closed_bin(value: Column, edges, n_edges: int | None = None) -> Column:
    """Index of [e_i, e_i+1), the last bin closed; NULL outside the edges."""
    columns = edge_columns(edges, n_edges)
    size, first, last = _shape(edges, n_edges)
    hits = _count([c <= value for c in columns])
    inside = value.isNotNull() & ~F.isnan(value) & (value >= first) & (value <= last) & (size >= 2)
    return F.when(inside, F.least(hits - 1, size - 2))


def right_closed_bin(
    value: Column, edges, n_edges: int | None = None, include_lowest: bool = False
) -> Column:
    """Index of (e_i, e_i+1]; NULL outside. The lowest edge joins bin 0 on request."""
    columns = edge_columns(edges, n_edges)
    size, first, last = _shape(edges, n_edges)
    hits = _count([c < value for c in columns])
    low_ok = (value >= first) if include_lowest else (value > first)
    inside = value.isNotNull() & ~F.isnan(value) & low_ok & (value <= last) & (size >= 2)
    return F.when(inside, F.greatest(hits - 1, F.lit(0)))


def clamped_right_closed_bin(value: Column, edges: list[float]) -> Column:
    """Right-closed index that puts values beyond the outer edges in the outer bins."""
    return F.when(
        value.isNotNull() & ~F.isnan(value),
        _count([F.lit(float(e)) < value for e in edges[1:-1]]),
    )
