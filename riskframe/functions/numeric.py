"""Rounding."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def round_away(value: Column | str, digits: int = 0) -> Column:
    """Halves away from zero on the scaled double, as the scoring side rounds."""
    column = F.col(value) if isinstance(value, str) else value
    scale = float(10**digits)
    return F.round(column * F.lit(scale), 0) / F.lit(scale)
