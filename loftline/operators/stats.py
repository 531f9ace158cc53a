"""Weighted statistics per group, safe for groups of any size.

Medians and quantiles pre-aggregate equal values map-side, then walk cumulative weight through value ranges
(``carried_sums``), so a group with a third of all rows is spread over its value ranges and never sorted whole.
"""

from __future__ import annotations

import math
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loftline.operators.skew import carried_sums

ELL80_K = math.sqrt(-2 * math.log(0.2))


def cumulative(df: DataFrame, keys: Sequence[str], value: str, weight: Column | None = None, width: float = 16.0) -> DataFrame:
    """Distinct values per group with weight ``w``, running weight ``cum`` and group total ``tot``."""
    w = F.lit(1.0) if weight is None else weight
    pts = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("v")).agg(F.sum(w).alias("w"))
    pts = pts.withColumn("_b", F.floor(F.col("v") / width))
    return carried_sums(pts, keys, "_b", [F.col("v")], {"cum": F.col("w")}, totals=True).drop("_b").withColumnRenamed("cum_tot", "tot")


def weighted_median(df: DataFrame, keys: Sequence[str], value: str, weight: Column | None = None,
                    out: str = "median", width: float = 16.0) -> DataFrame:
    """A-04: first value whose running weight passes half; the midpoint when it lands exactly on half."""
    half = F.col("tot") / 2
    got = cumulative(df, keys, value, weight, width).groupBy(*keys).agg(
        F.max(F.when(F.abs(F.col("cum") - half) < 1e-9, F.col("v"))).alias("_lo"),
        F.min(F.when(F.col("cum") > half + 1e-9, F.col("v"))).alias("_hi"), F.max("v").alias("_mx"))
    return got.select(*keys, F.coalesce((F.col("_lo") + F.col("_hi")) / 2, "_hi", "_mx").alias(out))


def weighted_median_of(pairs) -> Column:
    """A-04 of an ``array<struct<v,w>>``, for groups that what they describe keeps small; nulls among v are left out."""
    a = F.array_sort(F.filter(pairs, lambda p: p["v"].isNotNull()))
    half = F.aggregate(a, F.lit(0.0), lambda s, p: s + p["w"]) / 2
    none = F.lit(None).cast("double")

    def step(s, p):
        cum = s["cum"] + p["w"]
        return F.struct(cum.alias("cum"), F.when(F.abs(cum - s["half"]) < 1e-9, p["v"]).otherwise(s["lo"]).alias("lo"),
                        F.when(s["hi"].isNull() & (cum > s["half"] + 1e-9), p["v"]).otherwise(s["hi"]).alias("hi"), s["half"].alias("half"))
    start = F.struct(F.lit(0.0).alias("cum"), none.alias("lo"), none.alias("hi"), half.alias("half"))
    return F.coalesce(F.aggregate(a, start, step, lambda s: F.coalesce((s["lo"] + s["hi"]) / 2, s["hi"])), F.get(a, F.size(a) - 1)["v"])


def weighted_quantiles(df: DataFrame, keys: Sequence[str], value: str, qs: dict[str, float],
                       weight: Column | None = None, width: float = 16.0) -> DataFrame:
    """A-05: the first value at which running weight reaches q of the total."""
    return cumulative(df, keys, value, weight, width).groupBy(*keys).agg(
        *[F.coalesce(F.min(F.when(F.col("cum") >= F.lit(q) * F.col("tot") - 1e-9, F.col("v"))), F.max("v")).alias(o)
          for o, q in qs.items()])


def moments(x: str, y: str | None, w: str) -> list[Column]:
    """A-02/A-03 sums for one map-side combined aggregate."""
    W, X = F.col(w), F.col(x)
    cols = [F.sum(W).alias("_W"), F.sum(W * W).alias("_W2"), F.sum(W * X).alias("_X"), F.sum(W * X * X).alias("_XX")]
    if y:
        Y = F.col(y)
        cols += [F.sum(W * Y).alias("_Y"), F.sum(W * Y * Y).alias("_YY"), F.sum(W * X * Y).alias("_XY")]
    return cols


def reliability_den(W="_W", W2="_W2") -> Column:
    d = F.col(W) - F.col(W2) / F.col(W)
    return F.when(d > 1e-12, d)


def w_mean(s="_X", W="_W") -> Column:
    return F.col(s) / F.col(W)


def w_var(ss="_XX", s="_X", W="_W", W2="_W2") -> Column:
    """Reliability-weighted variance; null when one row carries all the weight."""
    return F.greatest(F.lit(0.0), F.col(ss) - F.col(s) * F.col(s) / F.col(W)) / reliability_den(W, W2)


def w_cov(xy="_XY", x="_X", y="_Y", W="_W", W2="_W2") -> Column:
    return (F.col(xy) - F.col(x) * F.col(y) / F.col(W)) / reliability_den(W, W2)


def ell80(sxx, syy, sxy) -> Column:
    """A-06: full axes and tilt of the ellipse holding 80% of a 2-D normal with these covariances."""
    half = (sxx + syy) / 2
    disc = F.sqrt(F.pow((sxx - syy) / 2, 2) + sxy * sxy)
    k = 2 * ELL80_K
    return F.struct((k * F.sqrt(half + disc)).alias("w_yds"), (k * F.sqrt(F.greatest(F.lit(0.0), half - disc))).alias("h_yds"),
                    F.pmod(F.degrees(F.atan2(2 * sxy, sxx - syy)) / 2, F.lit(180.0)).alias("tilt_deg"))


def shrink(personal, prior, n_eff, k: float) -> Column:
    """A-12: toward the prior with weight k; a missing side returns the other."""
    p, q, n = personal, prior, n_eff
    return (F.when(p.isNull(), q).when(q.isNull(), p).when(~F.coalesce(n > 0, F.lit(False)), q)
            .otherwise((n * p + k * q) / (n + k)))
