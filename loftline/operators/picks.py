"""Choosing among priced candidates of one decision (K-01 .. K-04, K-07, A-35).

A decision's candidates are what one player could hit from one spot.  All rules read one window partitioning,
so a decision table is shuffled once.  Columns: exp_score, par_prob, birdie, trouble, mean_yds, dist_to_target,
club, swing, ord (input order).
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loftline.settings import DEFAULTS, Settings

EPS = 1e-9


def _fit() -> Column:
    return F.abs(F.col("mean_yds") - F.col("dist_to_target"))


def plain_pick(df: DataFrame, keys: Sequence[str], pool: Column, out: str, cfg: Settings = DEFAULTS) -> DataFrame:
    """K-01: best par chance within tolerance, then lowest score within tolerance, then the best fit; marks the row."""
    w = Window.partitionBy(*keys)
    df = df.withColumn("_p", pool)
    df = df.withColumn("_b", F.col("_p") & (F.col("par_prob") >= F.max(F.when(F.col("_p"), F.col("par_prob"))).over(w) - cfg.par_tie - EPS))
    df = df.withColumn("_t", F.col("_b") & (F.col("exp_score") <= F.min(F.when(F.col("_b"), F.col("exp_score"))).over(w) + cfg.exp_tie))
    first = F.min(F.when(F.col("_t"), F.struct(_fit().alias("f"), F.col("ord").alias("o")))).over(w)
    return df.withColumn(out, F.col("_t") & (F.col("ord") == first["o"])).drop("_p", "_b", "_t")


def safe_pool(df: DataFrame, keys: Sequence[str], recovery: Column, forward: Column, cfg: Settings = DEFAULTS) -> DataFrame:
    """K-02: from a recovery lie only clean shots (trouble within 10%), else the least trouble among forward moves."""
    w = Window.partitionBy(*keys)
    clean = F.col("trouble") <= cfg.no_hero_max_trouble + EPS
    any_clean = F.max(clean).over(w)
    any_fwd = F.max(forward).over(w)
    base = F.when(any_fwd, forward).otherwise(F.lit(True))
    least = F.min(F.when(base, F.col("trouble"))).over(w)
    punch = base & (F.col("trouble") <= least + 0.02)
    return df.withColumn("pool", F.when(recovery, F.when(any_clean, clean).otherwise(punch)).otherwise(F.lit(True)))


def second_option(df: DataFrame, keys: Sequence[str], cfg: Settings = DEFAULTS) -> DataFrame:
    """K-03: the best birdie chance beside the safe pick, and whether it is really a different shot.

    ``safe`` marks the first pick.  Ties keep the safe one, then input order.
    """
    w = Window.partitionBy(*keys)
    row = F.struct("club", "swing", "birdie", "dist_to_target", "ord")
    df = df.withColumn("_s", F.max(F.when(F.col("safe"), row)).over(w))
    best = F.max(F.struct(F.col("birdie").alias("b"), F.when(F.col("safe"), 1).otherwise(0).alias("s"), (-F.col("ord")).alias("o"), row.alias("r")))
    g = df.groupBy(*keys).agg(best.alias("_a"), F.max(F.when(F.col("safe"), row)).alias("_s"))
    a, s = F.col("_a.r"), F.col("_s")
    gain = a["birdie"] - s["birdie"]
    longer = a["dist_to_target"] > s["dist_to_target"] + 2 * cfg.same_shot_target_yds
    line = (a["club"] == s["club"]) & (a["swing"] == s["swing"]) & (F.abs(a["dist_to_target"] - s["dist_to_target"]) <= cfg.same_shot_target_yds)
    return g.select(*keys, s["ord"].alias("safe_ord"), a["ord"].alias("aggr_ord"),
                    ((a["ord"] == s["ord"]) | line | ((gain < cfg.same_shot_birdie_gain) & ~longer)).alias("same_shot"))


def pin_rule(df: DataFrame, keys: Sequence[str], depth: Column, cfg: Settings = DEFAULTS) -> DataFrame:
    """K-07: clubs in order of weighted distance from the depth target (short counts double).

    Tie groups are anchored at their first club (within 2 yards of it), so group starts come from a fold over the
    decision's sorted club distances; the first group with a club passing the guards gives the pick.
    """
    miss = F.col("mean_yds") - depth
    df = df.withColumn("_k", F.when(miss < 0, -miss * cfg.pin_short_weight).otherwise(miss))
    w = Window.partitionBy(*keys)
    wc = Window.partitionBy(*keys, "club", "swing")
    best = F.max(F.when(F.col("safe"), F.struct("exp_score", "trouble"))).over(w)
    df = df.withColumn("_best", best).withColumn("_ck", F.min("_k").over(wc))
    df = df.withColumn("_all", F.array_sort(F.collect_set("_ck").over(w)))
    anchors = F.aggregate("_all", F.array().cast("array<double>"), lambda acc, v: F.when(
        (F.size(acc) == 0) | (v > F.element_at(acc, -1) + cfg.pin_tie_yds), F.array_append(acc, v)).otherwise(acc))
    df = df.withColumn("_g", F.array_max(F.filter(anchors, lambda v: v <= F.col("_ck"))))
    cost = F.col("exp_score") - F.col("_best.exp_score")
    more = F.col("trouble") - F.col("_best.trouble")
    ok = ((more <= cfg.pin_max_extra_trouble + EPS) & (cost <= cfg.pin_max_cost + EPS)
          & ((cost <= cfg.pin_free_strokes + EPS) | (more <= -cfg.pin_min_trouble_saved + EPS)))
    df = df.withColumn("_ok", ok)
    df = df.withColumn("_first", F.min(F.when(F.col("_ok"), F.col("_g"))).over(w)).filter(F.col("_ok") & (F.col("_g") == F.col("_first")))
    df = df.withColumn("_bp", F.max("par_prob").over(w)).filter(F.col("par_prob") >= F.col("_bp") - cfg.par_tie - EPS)
    return df.groupBy(*keys).agg(F.min(F.struct("exp_score", "ord", "club", "swing")).alias("p")).select(*keys, "p.ord", "p.club", "p.swing")


def guess_club(shots: DataFrame, totals: DataFrame, yds: str) -> DataFrame:
    """K-04: the club whose usual total is nearest the yards, first in bag order on ties; null without a bag.

    A player's bag is an array of a dozen clubs, joined by player; every shot stays one row.
    """
    bag = totals.groupBy("player_id").agg(F.collect_list(F.struct("total_yds", "order_no", "club")).alias("_bag"))
    near = F.array_min(F.transform("_bag", lambda b: F.struct(F.abs(b["total_yds"] - F.col(yds)).alias("d"), b["order_no"].alias("order_no"), b["club"].alias("club"))))
    return shots.join(bag, "player_id", "left").withColumn("club_guess", near["club"]).drop("_bag")


def sweep_report(calls: DataFrame, by: Sequence[str], rule: str = "rule") -> DataFrame:
    """A-35: per rule, how often it fired and moved the call, and what moving cost (mean and median cost, mean trouble change)."""
    from loftline.operators.stats import weighted_median
    moved = calls.filter(F.col("moved"))
    g = calls.groupBy(*by, rule).agg(F.count(F.lit(1)).alias("fired"), F.count(F.when(F.col("moved"), 1)).alias("moved_n"),
                                     F.avg(F.when(F.col("moved"), F.col("cost"))).alias("mean_cost"), F.avg(F.when(F.col("moved"), F.col("d_trouble"))).alias("mean_d_trouble"))
    med = weighted_median(moved, [*by, rule], "cost", None, "median_cost", width=0.25)
    return g.join(med, [*by, rule], "left")


def costly_moves(calls: DataFrame, by: Sequence[str], over: float = 0.3, top: int = 12, tie: str = "call_id") -> DataFrame:
    """A-35: the moved calls that cost more than ``over``, the ``top`` costliest of each group, and how many it has in all."""
    costly = calls.filter(F.col("moved") & (F.col("cost") > over))
    w = Window.partitionBy(*by).orderBy(F.col("cost").desc(), tie)
    first = costly.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= top)   # Spark keeps the top rows before it deals them
    return first.join(costly.groupBy(*by).agg(F.count(F.lit(1)).alias("costly")), list(by))
