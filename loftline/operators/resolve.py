"""Entry resolution with per-field fallback and provenance (J-05), candidate lists (J-18), fallback rings (A-41)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loftline.functions.numbers import tan_deg
from loftline.operators import shots as S
from loftline.operators.stats import ELL80_K
from loftline.settings import DEFAULTS, LIE_CHAIN, Settings, lookup

KEYS = ["player_id", "club", "swing", "lie"]


def every_lie(entries: DataFrame) -> DataFrame:
    """Each club and swing of a bag asked for from each of the five lies."""
    return entries.select("player_id", "club", "swing").distinct().select(
        "player_id", "club", "swing", F.explode(F.array(*[F.lit(l) for l in LIE_CHAIN])).alias("lie"))


def resolve(targets: DataFrame, entries: DataFrame, order: dict[str, int], cfg: Settings = DEFAULTS) -> DataFrame:
    """J-05: each field from the first lie of the chain that knows it; angle spread also from neighbouring clubs.

    One join on (player, swing), whose fan-out is a bag, and one map-side combined aggregate with a ``min_by``
    per field; no chain of self-joins.
    """
    chain = lookup(F.concat_ws(">", "lie", "_lie"), {f"{a}>{b}": i for a, ch in LIE_CHAIN.items() for i, b in enumerate(ch)}, 9)
    pos, pos2 = lookup(F.col("club"), order), lookup(F.col("_club"), order)
    away = 2 * F.abs(pos2 - pos) + F.when(pos2 > pos, 1).otherwise(0)
    own = F.col("club") == F.col("_club")
    e = entries.select("player_id", "swing", F.col("club").alias("_club"), F.col("lie").alias("_lie"), *[F.col(f).alias(f"_{f}") for f in (
        "total_yds", "dist_sd", "lat_sd_deg", "carry_yds", "carry_source", "n")])
    c = targets.join(e, ["player_id", "swing"]).withColumn("_rk", F.when(own, chain).otherwise(100 + away * 10 + chain))
    val = lambda f: F.struct(F.col(f"_{f}").alias("v"), F.col("_lie").alias("lie"), F.col("_club").alias("club"))
    at = lambda f, cond: F.when(cond & F.col(f"_{f}").isNotNull(), F.col("_rk"))
    g = c.groupBy(*KEYS).agg(
        F.min_by(val("total_yds"), at("total_yds", own)).alias("t"), F.min_by(val("dist_sd"), at("dist_sd", own)).alias("d"),
        F.min_by(F.struct(F.col("_carry_yds").alias("v"), F.col("_lie").alias("lie"), F.col("_carry_source").alias("src")), at("carry_yds", own)).alias("k"),
        F.min_by(val("lat_sd_deg"), at("lat_sd_deg", F.lit(True))).alias("l")).filter("t IS NOT NULL AND l IS NOT NULL")
    fam = S.club_family("club")
    g = g.withColumn("family", fam).withColumn("total", F.col("t.v")).withColumn("source_lie", F.col("t.lie"))
    measured = F.coalesce((F.col("k.lie") == F.col("source_lie")) & (F.col("k.src") == "measured"), F.lit(False))
    base = F.when(measured, F.col("k.v")).otherwise(F.col("total") - S.roll_yds("club", "swing", "family", "source_lie", cfg))
    factor = (1 + S.lie_adj("lie", "family", cfg)) / (1 + S.lie_adj("source_lie", "family", cfg))
    g = g.withColumn("_c0", base).withColumn("_f", factor).withColumn("_m", measured)
    roll = F.greatest(F.lit(0.0), F.col("total") - F.col("_c0")) * lookup(F.col("lie"), cfg.roll_lie_mult, 1.0)
    g = g.withColumn("roll", roll).withColumn("_spread", F.col("_c0") * F.col("_f"))
    carry = F.when(F.col("_m"), F.col("_spread")).otherwise(F.greatest(F.lit(0.0), F.col("total") * F.col("_f") - F.col("roll")))
    sd_mult = S.lie_sd("lie", cfg) / S.lie_sd(F.col("l.lie"), cfg)
    dist = F.coalesce(F.col("d.v") * F.col("_spread") / F.col("total"), lookup(F.col("family"), cfg.dist_sd_pct) * F.col("_spread")) * sd_mult
    return g.select(*KEYS, "family", "source_lie", "total", carry.alias("carry"), "roll", dist.alias("dist_sd"), F.col("l.v").alias("lat_sd_deg"),
                    (F.col("_spread") * tan_deg(F.col("l.v")) * sd_mult).alias("lateral_sd"), sd_mult.alias("lie_sd_mult"),
                    F.col("l.club").alias("lat_sd_club"), F.col("l.lie").alias("lat_sd_lie"))


def candidates(entries: DataFrame, order: dict[str, int], cfg: Settings = DEFAULTS) -> DataFrame:
    """J-18: every club and swing that resolves from a lie, without tee-only full swings off the tee."""
    asked = every_lie(entries).filter(~((F.col("swing") == "full") & (F.col("lie") != "tee") & F.col("club").isin(*cfg.tee_only_full)))
    return resolve(asked, entries, order, cfg)


def ring(df: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """A-41: the measured ellipse scaled by lie, else one from the two spreads, capped for display."""
    k = 2 * ELL80_K
    cap = F.lit(cfg.ring_draw_cap_yds)
    mult = F.col("lie_sd_mult")
    return df.withColumn("ring_w", F.coalesce(F.col("ell_w") * mult, F.when(F.col("dist_sd").isNotNull(), F.least(k * F.col("dist_sd"), cap)))).withColumn(
        "ring_h", F.coalesce(F.col("ell_h") * mult, F.when(F.col("lateral_sd").isNotNull(), F.least(k * F.col("lateral_sd"), cap)))).withColumn(
        "ring_tilt", F.coalesce(F.col("ell_tilt"), F.lit(90.0))).withColumn(
        "ring_source", F.when(F.col("ell_w").isNotNull(), "measured").otherwise("profile"))
