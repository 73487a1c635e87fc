"""Column expressions: signal tests, distributions and reproducible random numbers."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Coefficients of the error function approximation 7.1.26 in Abramowitz and Stegun, Handbook of
# Mathematical Functions (absolute error below 1.5e-7).
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def has_signal(value: Column) -> Column:
    """True for a value that is present, not NaN and not exactly zero."""
    return value.isNotNull() & ~F.isnan(value) & (value != 0)


def finite_values(values: Column) -> Column:
    """An array without NaN; arrays without NaN pass through untouched."""
    return F.when(F.isnan(F.array_max(values)), F.filter(values, lambda v: ~F.isnan(v))).otherwise(values)


def normal_cdf(z: Column) -> Column:
    x = F.abs(z) / F.lit(math.sqrt(2.0))
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(ERF_P) * x)
    poly = F.lit(0.0)
    for a in reversed(ERF_A):
        poly = (poly + F.lit(a)) * t
    upper = F.lit(0.5) * poly * F.exp(-x * x)
    return F.when(z >= 0, F.lit(1.0) - upper).otherwise(upper)


def ieee_divide(a: Column, b: Column) -> Column:
    """Division that yields infinity or NaN on a zero divisor instead of an error."""
    return (
        F.when(b != 0, F.try_divide(a, b))
        .when(b.isNull() | a.isNull(), F.lit(None).cast("double"))
        .when(F.isnan(a) | (a == 0), F.lit(float("nan")))
        .when(a > 0, F.lit(float("inf")))
        .otherwise(F.lit(float("-inf")))
    )


def random_key(*parts: Column | str | int) -> Column:
    """A hexadecimal key that orders rows pseudo-randomly, whatever their partitioning."""
    return F.md5(F.concat_ws("|", *[p if isinstance(p, Column) else F.lit(str(p)) for p in parts]))


def key_number(key: Column, first: int, digits: int) -> Column:
    """Hexadecimal digits of a random key, from the 1-based position ``first`` on, as a number."""
    return F.conv(F.substring(key, first, digits), 16, 10).cast("long")


def uniform(key: Column, which: int = 0) -> Column:
    """One of the two independent uniform numbers strictly between 0 and 1 that a random key holds."""
    return (key_number(key, 1 + 13 * which, 13) + F.lit(0.5)) / F.lit(float(2**52))


def truncated_cauchy(u: Column, centre: float, scale: float, low: float, high: float) -> Column:
    """Inverse distribution function of a Cauchy distribution cut to [low, high]."""
    f_low = 0.5 + math.atan((low - centre) / scale) / math.pi
    f_high = 0.5 + math.atan((high - centre) / scale) / math.pi
    p = F.lit(f_low) + u * F.lit(f_high - f_low)
    return F.lit(centre) + F.lit(scale) * F.tan(F.lit(math.pi) * (p - F.lit(0.5)))


def exponential(u: Column) -> Column:
    """Inverse distribution function of the unit exponential distribution."""
    return -F.log(F.lit(1.0) - u)
