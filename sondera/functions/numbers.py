"""Numeric column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def unit_value(c: Column) -> Column:
    """The value where it is a number in [0, 1]; null otherwise (null, NaN, out of range)."""
    v = c.cast("double")
    return F.when(~F.isnan(v) & v.between(0.0, 1.0), v)
