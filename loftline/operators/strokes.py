"""Strokes-gained pricing: distance lookups, expected strokes, gains, finish chances, pattern statistics.

Distances are priced at whole yards, so every range rule becomes a table with one row per yard and lie, joined by
equality.  Past its last yard the baseline no longer changes; the handicap line goes on with the distance itself.
"""

from __future__ import annotations

import math
from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loftline.functions.numbers import c, half_up, normal_cdf
from loftline.operators.stats import ELL80_K, shrink
from loftline.operators.skew import evaluated_once
from loftline.settings import BASELINE_PUTTS, BUCKET_LIE, DEFAULTS, SHORT_BAND_LIE, Settings, lookup

#: Last yard of the baseline table.
MAX_YDS = 700


def shrink_rows(df: DataFrame, keys: Sequence[str], value: str, cfg: Settings = DEFAULTS) -> DataFrame:
    """A-12 bucket form: each bucket toward its group's shot-weighted mean; no value or no shots gives the mean."""
    live = (F.col("n") > 0) & F.col(value).isNotNull()
    grand = df.filter(live).groupBy(*keys).agg((F.sum(F.col("n") * F.col(value)) / F.sum("n")).alias("_prior"))
    n = F.when(live, F.col("n"))
    return df.join(grand, list(keys), "left").withColumn(value, shrink(F.col(value), F.col("_prior"), n, cfg.shrink_k)).drop("_prior")


# ---- J-06, J-07, J-08: lookups ------------------------------------------------------------------------

def range_join(df: DataFrame, bands: DataFrame, value: str, on: str | None = None) -> DataFrame:
    """J-06: half-open [from, to) bands, optionally per lie."""
    b = bands
    cond = (df[value] >= b["from_yds"]) & (df[value] < b["to_yds"])
    if on:
        cond = cond & (df[on] == b["band_lie"])
    return df.join(b, cond, "left")


def putt_bands(bands: DataFrame) -> DataFrame:
    """J-07 as half-open bands: ``to_ft`` counts in, and the last band takes everything beyond."""
    return bands.withColumn("from_ft", F.col("from_ft").cast("double")).withColumn(
        "until_ft", F.coalesce(F.col("to_ft").cast("double") + 1, F.lit(float("inf"))))


def putt_join(df: DataFrame, bands: DataFrame, ft: str) -> DataFrame:
    b = putt_bands(bands)
    return df.join(b, (df[ft] >= b["from_ft"]) & (df[ft] < b["until_ft"]), "left")


def segments(points: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """J-08: consecutive points as segments; the ends are opened so lookups clamp there."""
    w = Window.partitionBy(*keys).orderBy(x)
    s = points.select(*keys, F.col(x).alias("x0"), F.col(y).alias("y0"), F.lead(x).over(w).alias("x1"), F.lead(y).over(w).alias("y1"), F.lag(x).over(w).alias("_p"))
    return s.withColumn("lo", F.when(F.col("_p").isNull(), F.lit(float("-inf"))).otherwise(F.col("x0"))).withColumn(
        "hi", F.coalesce("x1", F.lit(float("inf")))).drop("_p")


def at(x) -> Column:
    """Value on the matched segment, clamped at both ends."""
    x = c(x)
    return F.when(F.col("x1").isNull() | (x <= F.col("x0")), F.col("y0")).otherwise(
        F.col("y0") + (x - F.col("x0")) / (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")))


def strokes_by_yard(baseline: DataFrame) -> DataFrame:
    """Expected strokes per lie and whole yard (0..700): the tee inside 100 yards reads the fairway column."""
    seg = segments(baseline.filter(F.col("strokes").isNotNull()), ["lie"], "yds", "strokes")
    yds = baseline.select("lie").distinct().select("lie", F.explode(F.sequence(F.lit(0), F.lit(MAX_YDS))).alias("d"))
    yds = yds.withColumn("read", F.when((F.col("lie") == "tee") & (F.col("d") < 100), "fairway").otherwise(F.col("lie")))
    s = seg.withColumnRenamed("lie", "read")
    return yds.join(s, (yds["read"] == s["read"]) & (yds["d"] >= s["lo"]) & (yds["d"] < s["hi"])).select(
        yds["lie"], yds["d"], at(yds["d"]).alias("base"))


def putts_at(ft) -> Column:
    """Expected putts from a distance: piecewise linear on the fixed published points."""
    x = c(ft)
    out = F.when(x <= BASELINE_PUTTS[0][0], BASELINE_PUTTS[0][1])
    for (a, ya), (b, yb) in zip(BASELINE_PUTTS, BASELINE_PUTTS[1:]):
        out = out.when(x <= b, F.lit(float(ya)) + (x - float(a)) / float(b - a) * (float(yb) - float(ya)))
    return out.otherwise(BASELINE_PUTTS[-1][1])


# ---- A-33: isotonic -----------------------------------------------------------------------------------

def isotonic(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Non-decreasing fit as max over starts of min over ends of the block mean; nulls are left out.

    A column is one lie's distance table, so its length is that of the table, whatever the number of shots behind it.
    """
    w = Window.partitionBy(*keys).orderBy(x)
    p = (df.filter(F.col(y).isNotNull()).withColumn("_i", F.row_number().over(w)).withColumn("_c", F.sum(y).over(w)))
    arr = p.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_i", x, y, "_c"))).alias("a"))

    def fit(k):
        starts = F.transform(F.slice("a", F.lit(1), k), lambda s: F.array_min(F.transform(
            F.slice("a", k, F.size("a") - k + 1), lambda e: (e["_c"] - s["_c"] + s[y]) / (e["_i"] - s["_i"] + 1))))
        return F.array_max(starts)
    out = arr.withColumn("f", F.transform(F.sequence(F.lit(1), F.size("a")), fit))
    return out.select(*keys, F.posexplode("f").alias("_k", "fit"), "a").select(*keys, F.get("a", F.col("_k"))[x].alias(x), half_up("fit", 6).alias("fit"))


# ---- A-36, A-37, A-38 ---------------------------------------------------------------------------------

def handicap_prior(d, cfg: Settings = DEFAULTS) -> Column:
    t, n = cfg.hcp_line_tour, cfg.hcp_line_ninety
    return F.lit(cfg.hcp_blend) * (F.lit(n[0] - t[0]) + F.lit(n[1] - t[1]) * c(d))


def price(df: DataFrame, table: DataFrame, yds: str, lie: str, out: str) -> DataFrame:
    """Attach a price: one equality join on (lie, whole yard); past the last yard the baseline stays as it is there."""
    t = table.select(F.col("lie").alias("_l"), F.col("d").alias("_d"), F.col("e").alias(out))
    k = F.least(F.lit(MAX_YDS), half_up(yds)).cast("int")
    l = F.when(F.col(lie) == "trees", "recovery").when(F.col(lie) == "green", "fairway").otherwise(F.col(lie))
    df = df.withColumn("_kd", k).withColumn("_kl", l)
    return df.join(t, (df["_kd"] == t["_d"]) & (df["_kl"] == t["_l"]), "left").drop("_kd", "_kl", "_d", "_l")


def expected_for(df: DataFrame, profiles: DataFrame, base: DataFrame, asks: Sequence[tuple[str, str, str]], putt_deficit: float, cfg: Settings = DEFAULTS) -> DataFrame:
    """A-36 by the player's own profile: for each of ``asks`` (yards, lie, out) the column ``out`` with the strokes expected there.

    ``profiles``: player_id, ``bands`` (J-06) array<struct<band_lie,from_yds,to_yds,sg,prox_ft>>, ``putts`` (J-07)
    array<struct<from_ft,to_ft,make_pct,three_pct>>.  Strokes depend on player, lie and whole yard alone, so the different
    places that are asked for are priced once, and shots meet their prices by equality; no array rides on a shot and no
    table of players x lies x yards is built.
    """
    keyed, places = df, None
    for yds, lie, out in asks:
        keyed = keyed.withColumns({f"_d_{out}": half_up(yds), f"_l_{out}": F.col(lie)})
        own = keyed.select("player_id", F.col(f"_l_{out}").alias("_lie"), F.col(f"_d_{out}").alias("_yd"))
        places = own if places is None else places.unionByName(own)
    priced = _priced(places.distinct().join(profiles.select("player_id", "bands", "putts"), "player_id"), base, putt_deficit, cfg)
    for _, _, out in asks:
        t = priced.select("player_id", F.col("_lie").alias(f"_l_{out}"), F.col("_yd").alias(f"_d_{out}"), F.col("e").alias(out))
        keyed = keyed.join(t, ["player_id", f"_l_{out}", f"_d_{out}"], "left").drop(f"_l_{out}", f"_d_{out}")
    return keyed


def _priced(places: DataFrame, base: DataFrame, putt_deficit: float, cfg: Settings) -> DataFrame:
    """(player_id, _lie, _yd, e): expected strokes from a lie and whole yards, by the profile that the row carries."""
    d = F.col("_yd")
    flat = F.when(F.col("_lie") == "trees", "recovery").when(F.col("_lie") == "green", "fairway").otherwise(F.col("_lie"))
    own = price(places, base.withColumnRenamed("base", "e"), "_yd", "_lie", "_base").withColumn("_band_lie", F.when(d < 50, lookup(flat, SHORT_BAND_LIE)).otherwise(lookup(flat, BUCKET_LIE)))
    own = evaluated_once(own.withColumn("_b", F.get(F.filter("bands", lambda b: (b["band_lie"] == F.coalesce("_band_lie", F.lit("rough"))) & (d >= b["from_yds"]) & (d < b["to_yds"])), F.lit(0))))
    own = own.withColumn("_px", half_up(F.col("_b.prox_ft")))
    own = evaluated_once(own.withColumn("_p", F.get(F.filter("putts", lambda p: (F.col("_px") >= p["from_ft"]) & (p["to_ft"].isNull() | (F.col("_px") < p["to_ft"] + 1))), F.lit(0))).drop("bands", "putts"))
    mine = F.lit(1.0) + (1 - F.col("_p.make_pct")) + F.col("_p.three_pct")
    gap = F.when(F.col("_b.prox_ft").isNull(), F.lit(float(putt_deficit))).otherwise(F.greatest(F.lit(0.0), mine - putts_at("_b.prox_ft")))
    sg = F.when(F.col("_band_lie").isNotNull(), F.col("_b.sg"))
    personal = F.when(sg.isNull(), handicap_prior("_yd", cfg)).otherwise(-sg)
    return own.select("player_id", "_lie", "_yd", (F.col("_base") + personal + gap).alias("e"))


def category() -> Column:
    """A-37: the part of the game that a shot belongs to."""
    return (F.when(F.col("shot_type") == "putt", "putting").when(F.col("lie") == "tee", "off the tee")
            .when(F.col("to_pin_yds") < 50, "around the green").otherwise("approach"))


def strokes_gained(shots: DataFrame, profiles: DataFrame, base: DataFrame, putt_deficit: float, cfg: Settings = DEFAULTS) -> DataFrame:
    """A-37: E(start) - E(end) - 1 - penalty strokes, by the player's own profile, with its ``category``.

    A putt starts at expected putts from ``putt_ft``; a holed shot ends at 0, one on the green at expected putts from
    where it lies.
    """
    s = expected_for(shots, profiles, base, [("to_pin_yds", "lie", "e0"), ("end_to_pin", "end_lie", "e1")], putt_deficit, cfg)
    start = F.when(F.col("shot_type") == "putt", putts_at("putt_ft")).otherwise(F.col("e0"))
    end = F.when(F.col("holed"), 0.0).when(F.col("end_lie") == "green", putts_at(F.col("end_to_pin") * 3)).otherwise(F.col("e1"))
    return s.withColumn("sg", start - end - 1 - F.coalesce(F.col("penalty"), F.lit(0))).withColumn("category", category())


def hole_out_cdf(m, j, cfg: Settings = DEFAULTS) -> Column:
    """A-38: chance of holing out in at most j more strokes.

    Scores follow a split normal of mean m: two half bells that meet at the mode, each with the mass of its width,
    both wider the more strokes are expected; half a stroke is added as scores are whole.
    """
    over = F.greatest(F.lit(0.0), c(m) - 1)
    left, right = (F.greatest(F.lit(0.05), a + b * over) for a, b in (cfg.score_sd_left, cfg.score_sd_right))
    mode = c(m) - math.sqrt(2 / math.pi) * (right - left)
    x = c(j) + 0.5 - mode
    mass = lambda side: side / (left + right)
    below = 2 * mass(left) * normal_cdf(x / left)
    above = mass(left) + mass(right) * (2 * normal_cdf(x / right) - 1)
    return F.when(c(j) < 1, 0.0).otherwise(F.when(x <= 0, below).otherwise(above))


def putt_cdf(j, make, three) -> Column:
    return F.when(c(j) < 1, 0.0).when(c(j) == 1, c(make)).when(c(j) == 2, 1 - c(three)).otherwise(1.0)


def short_tail(obs, n, model, k: float) -> Column:
    """A-39: the observed short share shrunk to the model, as the surplus over it."""
    n, m = c(n), c(model)
    target = (n * c(obs) + k * m) / (n + k)
    return F.when((n > 0) & c(obs).isNotNull() & (m < 1) & (target > m), (target - m) / (1 - m)).otherwise(0.0)


def normal_short_share(over, dy, w, h, tilt) -> Column:
    """Share of an 80% ellipse's normal that finishes more than ``over`` short (+y is short)."""
    sw, sh = c(w) / 2 / ELL80_K, c(h) / 2 / ELL80_K
    sd = F.hypot(sw * F.sin(F.radians(c(tilt))), sh * F.cos(F.radians(c(tilt))))
    return F.when(sd > 0, 1 - normal_cdf((c(over) - F.coalesce(c(dy), F.lit(0.0))) / F.nullif(sd, F.lit(0.0)))).otherwise(0.0)


# ---- A-07, A-08, A-09, A-10 ---------------------------------------------------------------------------

def kernel(df: DataFrame, keys: Sequence[str], value: str, weight: str) -> DataFrame:
    """A-09 per axis: effective n, spread with the small-sample factor, IQR spread, bandwidth and pull."""
    from loftline.operators.stats import weighted_quantiles
    w, x = F.col(weight), F.col(value)
    g = df.groupBy(*keys).agg(F.sum(w).alias("_t"), F.sum(w * w).alias("_t2"), F.sum(w * x).alias("_x"), F.sum(w * x * x).alias("_xx"))
    q = weighted_quantiles(df, keys, value, {"q1": 0.25, "q3": 0.75}, w)
    n_eff = F.col("_t") * F.col("_t") / F.col("_t2")
    g = g.join(q, list(keys)).withColumn("n_eff", n_eff).withColumn("mean", F.col("_x") / F.col("_t"))
    v = F.greatest(F.lit(0.0), F.col("_xx") / F.col("_t") - F.col("mean") * F.col("mean"))
    g = g.withColumn("sd", F.sqrt(v * F.when(F.col("n_eff") > 1 + 1e-9, F.col("n_eff") / F.nullif(F.col("n_eff") - 1, F.lit(0.0))).otherwise(1.0)))
    iqr = F.col("q3") - F.col("q1")
    g = g.withColumn("_h", F.pow(F.greatest("n_eff", F.lit(1.0)), -1.0 / 6)).withColumn("_sk", F.least("sd", F.when(iqr > 0, iqr / 1.349).otherwise(F.col("sd"))))
    r = F.when(F.col("sd") > 0, F.least(F.lit(1.0), F.col("_h") * F.col("_sk") / F.nullif(F.col("sd"), F.lit(0.0)))).otherwise(0.0)
    return g.select(*keys, "n_eff", "mean", "sd", (F.col("_h") * F.col("_sk")).alias("kern"), F.sqrt(F.greatest(F.lit(0.0), 1 - r * r)).alias("pull"))


def good_window(df: DataFrame, keys: Sequence[str], total: str, wedge: Column) -> DataFrame:
    """A-07: shots outside a window round the median (20 yards; wedges max(8, 10%)) are mishits; median of the rest."""
    from loftline.operators.stats import weighted_median
    med = weighted_median(df, keys, total, None, "median_all")
    j = df.join(med, list(keys))
    win = F.when(wedge, F.greatest(F.lit(8.0), F.col("median_all") * 0.1)).otherwise(20.0)
    j = j.withColumn("_good", F.abs(F.col(total) - F.col("median_all")) <= win)
    g = j.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(~F.col("_good"), 1)).alias("mishits"), F.max("median_all").alias("median_all"))
    good = weighted_median(j.filter("_good"), keys, total, None, "median_good")
    return g.join(good, list(keys), "left").withColumn("mishit_rate", F.col("mishits") / F.col("n"))


def band_width(df: DataFrame, keys: Sequence[str], value: str, share: float = 0.65) -> DataFrame:
    """A-08: twice the interpolated quantile of absolute deviation from the median.

    Equal deviations are counted together and walked by value range, so the quantile is exact at any group size.
    """
    from loftline.operators.stats import cumulative, weighted_median
    med = weighted_median(df, keys, value, None, "_m")
    dev = df.join(med, list(keys)).withColumn("_d", F.abs(F.col(value) - F.col("_m")))
    run = cumulative(dev, keys, "_d", None, width=4.0)
    pos = F.lit(share) * (F.col("tot") - 1)
    lo, hi = F.floor(pos), F.ceil(pos)
    g = run.groupBy(*keys).agg(F.min(F.when(F.col("cum") > lo, F.col("v"))).alias("_a"), F.min(F.when(F.col("cum") > hi, F.col("v"))).alias("_b"), F.max(pos - lo).alias("_f"))
    return g.select(*keys, (2 * (F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_f"))).alias("band_yds"))


def trim_worst(df: DataFrame, keys: Sequence[str], x: str, y: str, order: str, share: float) -> DataFrame:
    """A-10: drop the share of rows farthest from the component-wise median, ties keeping the earlier row.

    Ranks come from per-distance-ring counts (``numbered``), so a hot group is ranked ring by ring.
    """
    from loftline.operators.skew import numbered
    from loftline.operators.stats import weighted_median
    med = weighted_median(df, keys, x, None, "_mx").join(weighted_median(df, keys, y, None, "_my"), list(keys))
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    j = df.join(med.join(n, list(keys)), list(keys)).withColumn("_d", F.hypot(F.col(x) - F.col("_mx"), F.col(y) - F.col("_my")))
    j = numbered(j.withColumn("_ring", F.floor(F.col("_d") / 8)), keys, "_ring", [F.col("_d"), F.col(order)], "_r")
    k = half_up(F.col("_n") * share)
    keep = F.when((F.col("_n") < 2) | (k <= 0), F.lit(True)).otherwise(F.col("_r") <= F.greatest(F.lit(1.0), F.col("_n") - k))
    return j.filter(keep).drop("_mx", "_my", "_n", "_d", "_ring", "_r")
