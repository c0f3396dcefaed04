"""Rounding to decimal digits as SQL engines do on doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(x: Column | str, digits: int) -> Column:
    """x times a power of ten, to the nearest whole number (halves away from zero), divided again.

    Spark's own round takes the shortest decimal spelling of a double: 0.145 counts as a tie there, though the double is below it.
    """
    scale = float(10**digits)
    return F.round((F.col(x) if isinstance(x, str) else x) * scale) / scale
