"""Whole-number arithmetic that stays exact for any 64-bit value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def int_div(a: Column, b: Column) -> Column:
    """Whole-number quotient, truncated towards zero; never goes through a double."""
    return F.call_function("div", a, b)


def floor_div(a: Column, n: int) -> Column:
    """Whole-number quotient rounded down, also for negative ``a``."""
    return int_div(a - F.pmod(a, F.lit(n)), F.lit(n))
