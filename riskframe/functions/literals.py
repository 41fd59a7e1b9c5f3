"""Numbers written into SQL expressions."""

from __future__ import annotations

import math


def sql_double(x: float) -> str:
    """A double literal that reads back to the same bits."""
    x = float(x)
    return f"{x!r}D" if math.isfinite(x) else f"double('{x!r}')"


def sql_doubles(xs) -> str:
    return f"array({', '.join(sql_double(x) for x in xs)})"
