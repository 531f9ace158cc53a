"""Column helpers for rounding, angles and null-safe arithmetic.  Columns in, columns out; no Python UDFs."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def half_up(x, digits: int = 0) -> Column:
    """Round with .5 going toward +infinity (``floor(x*k + 0.5)/k``), unlike SQL ``round``."""
    k = 10.0 ** digits
    v = F.floor(c(x) * F.lit(k) + F.lit(0.5))
    return (v / F.lit(k)) if digits else v.cast("double")


def r1(x) -> Column:
    return half_up(x, 1)


def finite(x) -> Column:
    """The value, with NaN and infinities turned into null: unknown is null, never zero."""
    x = c(x)
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def clamp(x, lo, hi) -> Column:
    return F.when(c(x).isNotNull(), F.greatest(c(lo), F.least(c(hi), c(x))))   # greatest/least skip nulls


def wrap180(deg) -> Column:
    """An angle folded into [-180, 180)."""
    return F.pmod(c(deg) + 540.0, F.lit(360.0)) - 180.0


def tan_deg(deg) -> Column:
    return F.tan(c(deg) * (math.pi / 180.0))


def interp(x, x0, y0, x1, y1) -> Column:
    return c(y0) + (c(x) - c(x0)) / (c(x1) - c(x0)) * (c(y1) - c(y0))


def sign_int(x) -> Column:
    return F.signum(c(x)).cast("int")


def normal_cdf(z) -> Column:
    """Standard normal CDF through the published rational error-function approximation."""
    # fixed values: Abramowitz & Stegun 7.1.26
    p = 0.3275911
    a1, a2, a3, a4, a5 = 0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429
    z = c(z)
    x = F.abs(z) / math.sqrt(2.0)
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(p) * x)
    poly = F.lit(a5)
    for a in (a4, a3, a2, a1):
        poly = poly * t + F.lit(a)
    erf = F.lit(1.0) - poly * t * F.exp(-x * x)
    return F.when(z >= 0, (F.lit(1.0) + erf) / 2.0).otherwise((F.lit(1.0) - erf) / 2.0)
