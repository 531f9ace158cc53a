"""Roll-ups of shares back to counts, entry assembly, and violation queries that should come back empty (A-22, A-42, A-43)."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loftline.functions.numbers import half_up


def zone_rollup(df: DataFrame, keys: Sequence[str], shares: Sequence[str]) -> DataFrame:
    """A-22: percentages times n become counts, are added up, and must give n again (``adds_up``)."""
    g = df.groupBy(*keys).agg(F.sum("n").alias("n"), *[F.sum(half_up(F.col(s) * F.col("n") / 100).cast("bigint")).alias(s) for s in shares])
    tot = F.col(shares[0])
    for s in shares[1:]:
        tot = tot + F.col(s)
    return g.withColumn("adds_up", tot == F.col("n"))


def interpolated_quantiles(run: DataFrame, keys: Sequence[str], qs: dict[str, float]) -> DataFrame:
    """Linear-interpolated quantiles from the cumulative counts of ``stats.cumulative``."""
    cols = []
    for o, q in qs.items():
        pos = F.lit(q) * (F.col("tot") - 1)
        cols += [F.min(F.when(F.col("cum") > F.floor(pos), F.col("v"))).alias(f"_a{o}"), F.min(F.when(F.col("cum") > F.ceil(pos), F.col("v"))).alias(f"_b{o}"),
                 F.max(pos - F.floor(pos)).alias(f"_f{o}")]
    g = run.groupBy(*keys).agg(*cols)
    return g.select(*keys, *[(F.col(f"_a{o}") + (F.col(f"_b{o}") - F.col(f"_a{o}")) * F.col(f"_f{o}")).alias(o) for o in qs])


def assemble_entries(df: DataFrame, min_n: int = 5, big_miss_floor: float = 40.0) -> DataFrame:
    """A-42: spread from the IQR (dropped under five shots), big-miss distance, counts from shares."""
    return (df.withColumn("dist_sd", F.when(F.col("n") >= min_n, F.col("iqr") / 1.349))
            .withColumn("big_miss_lat", F.greatest(F.lit(big_miss_floor), F.col("width") / 2))
            .withColumn("penalty_count", half_up(F.col("pen") * F.col("n")).cast("bigint")))


def not_contiguous(bands: DataFrame, keys: Sequence[str], lo: str, hi: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(lo)
    return bands.withColumn("_p", F.lag(hi).over(w)).filter(F.col("_p") != F.col(lo)).drop("_p")


def outside_unit(df: DataFrame, share: str) -> DataFrame:
    return df.filter((F.col(share) < 0) | (F.col(share) > 1))


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")


def carry_over_total(entries: DataFrame) -> DataFrame:
    return entries.filter(F.col("carry_yds") > F.col("total_yds"))
