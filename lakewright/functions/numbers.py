"""Arithmetic with the reference dialect's rounding and sign rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_away(x: Column, places: int) -> Column:
    """Round half away from zero; negative places round to tens, hundreds and so on."""
    return F.round(x, places)


def floor_div(a: Column, b: Column, whole: bool = False) -> Column:
    """Quotient rounded down, null for division by 0.

    ``whole`` says that both are whole numbers, which are then divided as such
    and stay exact beyond 2 ** 53.
    """
    divisor = F.nullif(b, F.lit(0))
    if not whole:
        return F.floor(a / divisor)
    down = (a % divisor != 0) & ((a < 0) != (b < 0))
    return F.call_function("div", a, divisor) - F.when(down, 1).otherwise(0)


def floor_mod(a: Column, b: Column) -> Column:
    """Remainder with the sign of the divisor, null for division by 0; exact for whole numbers."""
    rest = a % F.nullif(b, F.lit(0))
    return F.when((rest != 0) & ((rest < 0) != (b < 0)), rest + b).otherwise(rest)


def safe_sqrt(x: Column) -> Column:
    return F.when(x >= 0, F.sqrt(F.greatest(x, F.lit(0.0))))


def truncate(x: Column, places: int = 0) -> Column:
    scale = F.lit(float(10 ** places))
    return F.signum(x) * F.floor(F.abs(x) * scale) / scale


def array_mean(a: Column) -> Column:
    total = F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) > 0, total / F.nullif(F.size(a), F.lit(0)))


def array_median(a: Column) -> Column:
    ordered, n = F.array_sort(a), F.size(a)
    low = F.try_element_at(ordered, F.floor((n + 1) / 2).cast("int"))
    high = F.try_element_at(ordered, F.floor(n / 2 + 1).cast("int"))
    return F.when(n > 0, (low + high) / 2)


def array_stddev(a: Column) -> Column:
    """Sample standard deviation; null for fewer than two values."""
    mean, n = array_mean(a), F.size(a)
    squares = F.aggregate(F.transform(a, lambda x: (x - mean) * (x - mean)), F.lit(0.0), lambda s, x: s + x)
    return F.when(n >= 2, F.sqrt(squares / F.nullif(n - 1, F.lit(0))))
