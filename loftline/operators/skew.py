"""Ordered work on keys of any size.

A window partitioned by a key that holds a third of all rows sorts that third in one task.  The helpers here
cut such a key into ordered buckets (a month, a year, a value range), run the native window inside
(key, bucket), and carry only a small summary per bucket across the cut.  Results equal the plain window.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _back(keys: Sequence[str], bucket: str):
    return Window.partitionBy(*keys).orderBy(bucket)


def carried_sums(df: DataFrame, keys: Sequence[str], bucket: str, order: Sequence[Column],
                 values: dict[str, Column], totals: bool = False) -> DataFrame:
    """Running sums of several values in (bucket, order) per key, in one pass; ``totals`` adds each key's ``<name>_tot``.

    Sub-totals per (key, bucket) are map-side combined; the window over them sees one row per bucket.
    """
    df = df.select("*", *[v.alias(f"_v_{o}") for o, v in values.items()])
    sub = df.groupBy(*keys, bucket).agg(*[F.sum(f"_v_{o}").alias(f"_s_{o}") for o in values])
    w = _back(keys, bucket).rowsBetween(Window.unboundedPreceding, -1)
    off = sub.select(*keys, bucket, *[F.coalesce(F.sum(f"_s_{o}").over(w), F.lit(0)).alias(f"_o_{o}") for o in values],
                     *[F.sum(f"_s_{o}").over(Window.partitionBy(*keys)).alias(f"{o}_tot") for o in values if totals])
    local = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = df.join(off, [*keys, bucket]).select(
        "*", *[(F.sum(f"_v_{o}").over(local) + F.col(f"_o_{o}")).alias(o) for o in values])
    return out.drop(*[f"_{k}_{o}" for o in values for k in "vo"])


def numbered(df: DataFrame, keys: Sequence[str], bucket: str, order: Sequence[Column], out: str = "pos") -> DataFrame:
    """Row number per key in (bucket, order), built from per-bucket counts."""
    sub = df.groupBy(*keys, bucket).agg(F.count(F.lit(1)).alias("_n"))
    w = _back(keys, bucket).rowsBetween(Window.unboundedPreceding, -1)
    off = sub.select(*keys, bucket, F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    local = Window.partitionBy(*keys, bucket).orderBy(*order)
    return (df.join(off, [*keys, bucket])
            .withColumn(out, F.row_number().over(local) + F.col("_off")).drop("_off"))


def with_halo(df: DataFrame, keys: Sequence[str], bucket: str, order: Sequence[str], before: int) -> DataFrame:
    """Rows plus, in front of every bucket, the ``before`` rows of the same key that precede it.

    ``_own`` is true for the bucket's own rows.  A window over (keys, bucket) that looks back at most
    ``before`` rows then gives what the window over (keys) would; filter on ``_own`` afterwards.  Each bucket
    passes on at most ``before`` rows, found with a limit Spark applies before the shuffle.
    """
    last = Window.partitionBy(*keys, bucket).orderBy(*[F.col(o).desc() for o in order])
    tail = (df.withColumn("_r", F.row_number().over(last)).filter(F.col("_r") <= before)
            .groupBy(*keys, bucket)
            .agg(F.sort_array(F.collect_list(F.struct(*order, *[c for c in df.columns
                                                                 if c not in (*keys, bucket, *order)]))).alias("_tail")))
    prev = _back(keys, bucket).rowsBetween(-before, -1)
    fed = tail.select(*keys, bucket, F.flatten(F.collect_list("_tail").over(prev)).alias("_h"))
    fed = fed.select(*keys, bucket, F.explode(F.slice(
        F.col("_h"), F.greatest(F.lit(1), F.size("_h") - before + 1), before)).alias("_h"))
    halo = fed.select(*keys, bucket, "_h.*", F.lit(False).alias("_own"))
    return df.withColumn("_own", F.lit(True)).unionByName(halo)


def salted_agg(df: DataFrame, keys: Sequence[str], partial: Sequence[Column], final: Sequence[Column],
               salt: Column, slices: int = 32) -> DataFrame:
    """Two-step aggregate for results that do not combine map-side (collected sets, user aggregates)."""
    s = F.pmod(F.xxhash64(salt), F.lit(slices))
    return (df.withColumn("_salt", s).groupBy(*keys, "_salt").agg(*partial)
            .groupBy(*keys).agg(*final))


def evaluated_once(df: DataFrame) -> DataFrame:
    """The same rows, with the computed columns made final.

    The optimiser copies a long expression into every place that uses it, filters included; passing the row
    through a one-element generator ends that, so wide arithmetic is planned and evaluated once.
    """
    return df.select(F.inline(F.array(F.struct(*[F.col(c) for c in df.columns]))))
