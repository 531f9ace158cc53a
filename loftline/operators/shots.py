"""Single-shot transforms: results, misses, routing, targets, normalisation, text.  All built-in expressions.

Shot columns used throughout: start (sx, sy), target (tx, ty) and end (ex, ey) in hole-frame yards;
start_acc_m, end_acc_m; club, swing, shot_type, lie; dist_miss_yds, lat_miss_yds, intended_yds.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loftline.functions.numbers import c, clamp, half_up, r1, tan_deg, wrap180
from loftline.functions.geo import haversine_m
from loftline.settings import (CLUB_FAMILY, CLUB_PATTERNS, CURVE_WORDS, DEFAULTS, MISS_SIDES, MISS_UNIT, ON_TARGET, RESULT_DIST, RESULT_LAT, SHAPES, WEDGES, YARDS_PER_METRE,
                               Settings, lookup)

DOT, MINUS = " · ", "−"


# ---- O-20, O-21: results ------------------------------------------------------------------------------

def miss_band(v, cfg: Settings = DEFAULTS) -> Column:
    """O-21: 0 under the slight threshold, +-1 up to the big one (inclusive), +-2 beyond."""
    v = c(v)
    a = F.abs(v)
    k = F.when(a < cfg.slight_yds, 0).when(a <= cfg.big_yds, 1).otherwise(2)
    return F.when(v.isNotNull(), (F.signum(v) * k).cast("int"))


def close_out(df: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """O-20: along and lateral miss of the end against the start-to-target line, and the on-target box test."""
    length = F.hypot(F.col("tx") - F.col("sx"), F.col("ty") - F.col("sy"))
    df = df.withColumn("_L", F.when(length > 1e-9, length))
    dx, dy = (F.col("tx") - F.col("sx")) / F.col("_L"), (F.col("ty") - F.col("sy")) / F.col("_L")
    vx, vy = F.col("ex") - F.col("sx"), F.col("ey") - F.col("sy")
    df = df.withColumn("_along", vx * dx + vy * dy).withColumn("_lat", vx * dy - vy * dx)
    df = (df.withColumn("distance_miss_yds", r1(F.col("_along") - F.col("_L")))
          .withColumn("lateral_miss_yds", r1("_lat"))
          .withColumn("intended", r1("_L")).withColumn("actual", r1("_along")))
    on = ((F.abs("distance_miss_yds") <= F.col("_L") * cfg.on_target_dist_pct)
          & (F.abs("lateral_miss_yds") <= F.col("_L") * math.tan(math.radians(cfg.on_target_lat_deg))))
    low = F.coalesce((F.col("start_acc_m") > cfg.low_acc_m), F.lit(False)) | F.coalesce(
        (F.col("end_acc_m") > cfg.low_acc_m), F.lit(False))
    return (df.withColumn("on_target", on)
            .withColumn("curve_auto", miss_band("lateral_miss_yds", cfg))
            .withColumn("dist_class", miss_band("distance_miss_yds", cfg))
            .withColumn("low_acc", low).drop("_L", "_along", "_lat"))


# ---- O-22: words --------------------------------------------------------------------------------------

def _whole(x) -> Column:
    return half_up(x).cast("bigint").cast("string")


def _sided(value: Column, words: tuple, unit: str = "") -> Column:
    """A whole number of yards with the word for its side."""
    side = F.when(value > 0, words[1]).otherwise(words[0])
    return F.concat_ws(" ", _whole(F.abs(value)), *([F.lit(unit)] if unit else []), side)


def miss_text(dist, lat, cfg: Settings = DEFAULTS) -> Column:
    """Both axes in whole yards, each only past the slight band; a single one with its unit."""
    axes = [(half_up(v), MISS_SIDES[axis]) for v, axis in ((dist, "dist"), (lat, "lat"))]

    def told(unit: str) -> Column:
        return F.array_compact(F.array(*[F.when(F.abs(v) >= cfg.slight_yds, _sided(v, words, unit)) for v, words in axes]))

    n = F.size(told(""))
    text = F.when(n == 2, F.array_join(told(""), DOT)).when(n == 1, F.array_join(told(MISS_UNIT), "")).otherwise(ON_TARGET)
    return F.when(c(dist).isNotNull() & c(lat).isNotNull(), text)


def result_text(dist, lat, dist_class) -> Column:
    """The distance band with its mark and the yards off line, both by the side's entry."""
    k, yds = F.coalesce(c(dist_class), F.lit(0)), _whole(F.abs(c(lat)))
    far = lookup(F.signum(k).cast("int"), {sign: F.concat(F.lit(mark), F.abs(k).cast("string"), F.lit(word)) for sign, (mark, word) in RESULT_DIST.items()}, "on")
    wide = F.when(yds == "0", yds).otherwise(F.concat(yds, lookup(F.signum(c(lat)).cast("int"), RESULT_LAT, "")))
    return F.when(c(dist).isNotNull() & c(lat).isNotNull(), F.concat_ws(DOT, far, wide))


def curve_readback(curve, shape) -> Column:
    """The table's words for the shape meant, the side and the size; none without a curve."""
    k = c(curve)
    meant = F.when(c(shape).isin("draw", "fade"), c(shape)).otherwise("straight")
    size = F.when(F.abs(k) == 2, 2).otherwise(1)
    return lookup(F.concat_ws(" ", meant, F.signum(k).cast("int").cast("string"), size.cast("string")), CURVE_WORDS)


# ---- O-23, O-43, O-24: routing ------------------------------------------------------------------------

def route(to_pin, lie) -> Column:
    return F.when(c(lie) == "green", "putt").when(c(to_pin) >= 75, "long").otherwise("shortGame")


def short_kind(to_pin, lie) -> Column:
    d = c(to_pin)
    return (F.when(d.isNull() | (d > 100) | (c(lie) == "green"), None).when(d >= 30, "wedge")
            .when(c(lie) == "sand", "bunker").otherwise("chip"))


def default_swing(club, to_pin) -> Column:
    return F.when(c(club).isin(*WEDGES) & (c(to_pin) <= 120), "finesse").otherwise("full")


def phase(dist_yds, hole_yards, inside_green) -> Column:
    """O-43: putt inside the green, short within 50 yds, tee while most of the hole is left, else approach."""
    d = c(dist_yds)
    return (F.when(c(inside_green), "putt").when(d.isNull(), None).when(d <= 50, "short")
            .when(d > c(hole_yards) - 40, "tee").otherwise("approach"))


def norm_line(line) -> Column:
    return F.when(c(line).isin("own", "custom"), "custom").otherwise(c(line))


def line_played(reach, d_safe, d_aggr, club, club_safe, club_aggr, source, cfg: Settings = DEFAULTS) -> Column:
    """O-24: nearer of the two option targets inside max(15, 10% of reach), else custom."""
    tol = F.greatest(F.lit(cfg.custom_line_min_yds), c(reach) * cfg.custom_line_pct)
    inf = F.lit(float("inf"))
    ds, da = F.coalesce(c(d_safe), inf), F.coalesce(c(d_aggr), inf)
    k = c(club)
    by_club = (F.when(k.isNull(), "custom").when(k == c(club_safe), "safe").when(k == c(club_aggr), "aggressive").otherwise("custom"))
    known = c(club_safe).isNotNull() | c(club_aggr).isNotNull()
    other = k.isNotNull() & known & ~F.coalesce(k == c(club_safe), F.lit(False)) & ~F.coalesce(k == c(club_aggr), F.lit(False))
    by_target = F.when(other | ((ds > tol) & (da > tol)), "custom").when(da < ds, "aggressive").otherwise("safe")
    return F.when((c(source) != "set") & (by_club != "custom") & (by_club != by_target), by_club).otherwise(by_target)


# ---- O-25, O-26: pattern miss and eligibility ---------------------------------------------------------

def pattern_lat(cfg: Settings = DEFAULTS, lat="lat_miss_yds") -> Column:
    """O-25: lateral miss measured from the line the shot was started on, less the wind allowed for."""
    to_target = F.degrees(F.atan2(F.col("tx") - F.col("sx"), F.col("ty") - F.col("sy")))
    turn = wrap180(F.col("start_line_deg") - to_target)
    length = F.hypot(F.col("tx") - F.col("sx"), F.col("ty") - F.col("sy"))
    own = (F.col("start_line_deg").isNotNull()) & (length > 1e-9) & (F.abs(turn) < 90)
    off = F.when(own, length * tan_deg(turn) + F.coalesce(F.col("curve_yds"), F.lit(0.0))).otherwise(F.col("aim_offset_yds"))
    lat = c(lat)
    return (F.when(lat.isNull(), None).when(F.col("aim_offset_yds").isNull(), lat)
            .otherwise(r1(lat - off - F.coalesce(F.col("wind_yds"), F.lit(0.0)))))


def teaches() -> Column:
    return F.coalesce(F.col("teach"), F.lit(True))


def has_misses() -> Column:
    return (~F.coalesce(F.col("end_assumed"), F.lit(False))
            & F.col("dist_miss_yds").isNotNull() & F.col("lat_miss_yds").isNotNull())


def miss_cause_sample(df: DataFrame) -> DataFrame:
    return df.filter(F.col("logged") != "skipped")


def actual_yds() -> Column:
    return F.col("intended_yds") + F.col("dist_miss_yds")


def eligible(df: DataFrame, totals: DataFrame | None = None, cfg: Settings = DEFAULTS) -> DataFrame:
    """O-26: shots that may teach a club's numbers.

    ``totals`` (player_id, club, swing, lie, total_yds) rules out distances no such club goes; it is a small
    per-player table, so the join is left to the planner's own size check.
    """
    df = df.filter(teaches() & (F.col("logged") != "skipped") & F.col("shot_type").isin("full", "finesse")
                   & F.col("club").isNotNull() & F.col("lie").isNotNull() & has_misses())
    if totals is None:
        return df
    df = df.join(totals, ["player_id", "club", "swing", "lie"], "left")
    a, t = actual_yds(), F.col("total_yds")
    return df.filter(a.isNull() | t.isNull() | ((a <= t * cfg.learn_max_ratio + cfg.learn_slack_yds) & (a >= t / 3)))


# ---- O-27: club family --------------------------------------------------------------------------------

def club_family(club) -> Column:
    """O-27: the table first, then the first naming pattern that fits the whole name."""
    out = lookup(c(club), CLUB_FAMILY)
    for pattern, family in CLUB_PATTERNS:
        out = F.coalesce(out, F.when(F.trim(c(club)).rlike(f"(?i)^({pattern})$"), family))
    return out


# ---- O-33: plays-like ---------------------------------------------------------------------------------

def wind_effect(speed, from_deg, bearing, yds, family, cfg: Settings = DEFAULTS) -> tuple[Column, Column]:
    """Yards added along the shot and pushed across it (+ right) by the wind."""
    w = cfg.wind
    rel = F.radians(c(from_deg) - c(bearing))
    head, right = c(speed) * F.cos(rel), c(speed) * F.sin(rel)
    loft = lookup(c(family), w["loft"], 1.0)
    tail = -head
    up = F.least(F.lit(w["head_cap"]), F.greatest(F.lit(0.0), (w["head_pct"] + w["head_curve"] * head) * head * loft))
    down = -F.least(F.lit(w["tail_cap"]), F.greatest(F.lit(0.0), (w["tail_pct"] + w["tail_curve"] * tail) * tail * loft))
    along = c(yds) * F.when(head > 0, up).otherwise(down)
    cross = -right * w["cross_pct"] * c(yds) * F.when(c(family) == "long", w["cross_long_mult"]).otherwise(1.0)
    return along, cross


def wind_words(speed, from_deg, bearing) -> Column:
    rel = F.radians(c(from_deg) - c(bearing))
    head, right = c(speed) * F.cos(rel), c(speed) * F.sin(rel)
    side = F.when(right > c(speed) * 0.05, "right").when(right < -c(speed) * 0.05, "left").otherwise("")
    tagged = lambda base: F.when(side == "", base).otherwise(F.concat(F.lit(base + "-"), side))
    return (F.when(F.abs(head) < c(speed) * 0.38, F.concat(F.lit("cross-from-"), F.when(side == "", "right").otherwise(side)))
            .when(head > 0, tagged("into")).otherwise(tagged("down")))


def plays_like(yds, along, rise, temp_f, elev_ft, carry_pct, cfg: Settings = DEFAULTS) -> Column:
    y = c(yds)
    temp = F.coalesce(y * cfg.temp_pct_per_10f * (cfg.profile_temp_f - c(temp_f)) / 10, F.lit(0.0))
    alt = F.coalesce(-y * cfg.alt_pct_per_1000ft * (c(elev_ft) - cfg.ref_elev_ft) / 1000, F.lit(0.0))
    p = c(carry_pct)
    form = F.when((p < 0) & (p > -100) & (y > 100), y * (100.0 / (100.0 + p) - 1)).otherwise(0.0)
    return y + F.coalesce(c(rise), F.lit(0.0)) * cfg.elev_factor + c(along) + temp + alt + form


# ---- O-34 ---------------------------------------------------------------------------------------------

def hole_wind(dir_deg, bearing) -> Column:
    return F.pmod(c(dir_deg) - c(bearing), F.lit(360.0))


def chip_wind(direction, bearing) -> Column:
    off = lookup(F.lower(c(direction)), {"into": 0.0, "helping": 180.0, "from left": -90.0, "from right": 90.0,
                                         "left": -90.0, "right": 90.0})
    return F.pmod(c(bearing) + off, F.lit(360.0))


# ---- O-40: curve, lie factor, roll --------------------------------------------------------------------

def lie_adj(lie, family, cfg: Settings = DEFAULTS) -> Column:
    out = lookup(c(lie), cfg.lie_dist_adj, 0.0)
    for l, fams in cfg.lie_dist_adj_family.items():
        out = F.when(c(lie) == l, F.coalesce(lookup(c(family), fams), out)).otherwise(out)
    return out


def lie_sd(lie, cfg: Settings = DEFAULTS) -> Column:
    return lookup(c(lie), cfg.lie_sd_mult, 1.0)


def roll_yds(club, swing, family, lie, cfg: Settings = DEFAULTS) -> Column:
    own = F.when(c(swing) == "full", lookup(c(club), cfg.roll_club))
    fam = F.when(c(swing) == "full", lookup(c(family), cfg.roll_full)).when(c(swing) == "finesse", lookup(c(family), cfg.roll_finesse))
    return F.when((c(lie) == "tee") & (c(family) == "long"), 0.0).otherwise(F.coalesce(own, fam, F.lit(0.0)))


def roll_cond(conditions, family, cfg: Settings = DEFAULTS) -> Column:
    return lookup(c(conditions), {k: lookup(c(family), v, 1.0) for k, v in cfg.roll_cond_mult.items()}, 1.0)


def curve_for(club, shape, cfg: Settings = DEFAULTS) -> Column:
    yds = lookup(c(club), {k: (v[1] if v[1] > 0 else cfg.curve_default_yds) for k, v in cfg.shot_shape.items()}, cfg.curve_default_yds)
    return F.when(c(shape) == "fade", yds).when(c(shape) == "draw", -yds).otherwise(0.0)


# ---- O-44: record normalisation -----------------------------------------------------------------------

def clamp_axis(v) -> Column:
    """A graded axis rounded into -2..2; not a number reads as 0 ("good"), only for graded putts."""
    v = c(v)
    return F.when(v.isNull() | F.isnan(v.cast("double")), 0).otherwise(clamp(half_up(v), -2.0, 2.0).cast("int"))


def normalise(df: DataFrame) -> DataFrame:
    """O-44: fill the defaults a stored record may lack; an explicit null for an ungraded axis stays null."""
    auto = F.col("logged") == "auto"
    kind = short_kind("to_pin_yds", "lie")
    kind = F.when(kind.isin("chip", "bunker", "pitch"), kind)
    return (df.withColumn("schema", F.lit(1))
            .withColumn("shape_n", F.when(F.col("shape").isin(*SHAPES), F.col("shape")).otherwise("straight"))
            .withColumn("curve_n", F.when(F.col("shape") == "draw", -1).when(F.col("shape") == "fade", 1).otherwise(0))
            .withColumn("contact_n", F.when(auto, F.col("contact")).otherwise(F.coalesce(F.col("contact"), F.lit(0))))
            .withColumn("line_n", norm_line("line_played"))
            .withColumn("short_kind", kind)
            .withColumn("shot_type_n", F.coalesce(F.when(kind.isNotNull(), "shortGame"), default_swing("club", "to_pin_yds")))
            .withColumn("reviewed_n", F.coalesce(F.col("reviewed"), ~F.col("logged").isin("auto", "skipped")))
            .withColumn("speed_axis", F.when(F.col("made"), None).otherwise(clamp_axis(F.col("dist_miss_yds") / 8)))
            .withColumn("putt_ft_n", half_up("putt_ft")))


# ---- O-45, O-46, O-47, O-50 ---------------------------------------------------------------------------

def shot_length(lat1, lng1, lat2, lng2, sx, sy, ex, ey) -> Column:
    gps = half_up(haversine_m(lat1, lng1, lat2, lng2) * YARDS_PER_METRE)
    return F.coalesce(gps, half_up(F.hypot(c(ex) - c(sx), c(ey) - c(sy))))


def pin_third(front, back, along) -> Column:
    third = (c(back) - c(front)) / 3
    return (F.when(~(third > 0), "middle").when(c(along) < c(front) + third, "front")
            .when(c(along) > c(back) - third, "back").otherwise("middle"))


def situation(shot_no, par, lie, quality, front, cfg: Settings = DEFAULTS) -> Column:
    bunker = (c(lie) == "sand") & (c(front) > cfg.fairway_bunker_min_yds)
    return F.struct(
        ((c(shot_no) == 1) & (c(par) >= 4) & (c(lie) == "tee")).alias("tee_shot"),
        ((c(lie) == "recovery") | ((c(lie) == "rough") & c(quality).isin("bad", "buried")) | bunker).alias("recovery"),
        bunker.alias("fairway_bunker"))


def aim_offset(pattern_yds, wind_yds, cfg: Settings = DEFAULTS) -> Column:
    drift = F.coalesce(c(pattern_yds), F.lit(0.0)) + F.coalesce(c(wind_yds), F.lit(0.0))
    return F.when(F.abs(drift) >= cfg.pattern_aim_min_yds, -drift).otherwise(0.0)


def aim_point(sx, sy, tx, ty, offset, curve) -> tuple[Column, Column]:
    o = F.coalesce(c(offset), F.lit(0.0)) - F.coalesce(c(curve), F.lit(0.0))
    dx, dy = c(tx) - c(sx), c(ty) - c(sy)
    length = F.nullif(F.hypot(dx, dy), F.lit(0.0))
    return F.coalesce(c(tx) + dy / length * o, c(tx)), F.coalesce(c(ty) - dx / length * o, c(ty))


def in_ellipse(x, y, cx, cy, w, h, tilt_deg) -> Column:
    a = F.radians(c(tilt_deg))
    dx, dy = c(x) - c(cx), c(y) - c(cy)
    u = (dx * F.cos(a) + dy * F.sin(a)) / (c(w) / 2)
    v = (dy * F.cos(a) - dx * F.sin(a)) / (c(h) / 2)
    return u * u + v * v <= 1 + 1e-12


def ellipse_box(w, h, tilt_deg) -> tuple[Column, Column]:
    """Half-width and half-height of the ellipse's bounding box."""
    a = F.radians(c(tilt_deg))
    p, q = c(w) / 2, c(h) / 2
    return (F.sqrt(F.pow(p * F.cos(a), 2) + F.pow(q * F.sin(a), 2)),
            F.sqrt(F.pow(p * F.sin(a), 2) + F.pow(q * F.cos(a), 2)))


# ---- O-41, O-51: sentences ----------------------------------------------------------------------------

def _one(x) -> Column:
    """A number to one decimal, whole numbers without the point."""
    v = r1(x)
    return F.when(v == F.floor(v), v.cast("bigint").cast("string")).otherwise(F.format_string("%.1f", v))


def reason_line(label, lat_sd, penalties, n, gir, prox, lie, short_pct, total, family) -> Column:
    """O-41: the first template whose fields are all known."""
    pct = lambda x: F.concat(_whole(c(x) * 100), F.lit("%"))
    spread = F.concat(F.lit(": "), _one(lat_sd), F.lit("° spread"))
    return F.coalesce(
        F.when(c(family) == "long", F.concat(c(label), spread, F.lit(", "), c(penalties).cast("string"), F.lit(" penalties in last "), c(n).cast("string"))),
        F.concat(c(label), F.lit(": "), pct(gir), F.lit(" GIR, "), _one(prox), F.lit(" ft median from "), c(lie), F.lit(" (n "), c(n).cast("string"), F.lit(")")),
        F.concat(c(label), spread, F.lit(", "), pct(short_pct), F.lit(" short (n "), c(n).cast("string"), F.lit(")")),
        F.concat(c(label), spread, F.lit(", "), _one(total), F.lit(" median")),
        F.concat(c(label), F.lit(": "), _one(total), F.lit(" median")),
        c(label))


def one_in(p) -> Column:
    p = c(p)
    return (F.when(~(p > 0) | p.isNull(), None).when(p <= 0.5, F.concat(F.lit("1 in "), _whole(F.lit(1.0) / p)))
            .otherwise(F.concat(_whole(p * 10), F.lit(" in 10"))))


def rise_text(yds) -> Column:
    y = c(yds)
    return (F.when(y.isNull(), None).when(F.abs(y) < 1, "level")
            .otherwise(F.concat(_whole(F.abs(y)), F.lit(" yds "), F.when(y > 0, "up").otherwise("down"))))


def short_game_line(band_lie, up_down, n, prox, yds) -> Column:
    lie = lookup(c(band_lie), {"fairway": "Fairway", "rough": "Rough", "bunker": "Bunker"}, "From here")
    few = F.when(c(n) < 10, F.concat(F.lit(" ("), c(n).cast("string"), F.lit(" shots)"))).otherwise("")
    ud = F.concat(F.lit("up and down "), _whole(c(up_down) * 100), F.lit("%"), few)
    lv = F.concat(F.lit("you leave it "), _whole(prox), F.lit(" ft"))
    return F.when(ud.isNotNull() | lv.isNotNull(),
                  F.concat(lie, F.lit(", "), _whole(yds), F.lit(" yds: "), F.concat_ws(DOT, ud, lv)))


def paid_text(delta) -> Column:
    g = -c(delta)
    return F.when(g >= 0, F.concat(F.lit("Aggression paid +"), F.format_string("%.1f", r1(g)))).otherwise(
        F.concat(F.lit("Aggression cost " + MINUS), F.format_string("%.1f", r1(F.abs(g)))))


# ---- O-04: miss words ---------------------------------------------------------------------------------

def miss_signs(text) -> tuple[Column, Column]:
    t = F.lower(c(text))
    pair = lambda a, b: F.when(t.rlike(f"\\b{a}\\b"), 1).when(t.rlike(f"\\b{b}\\b"), -1)
    return pair("long", "short"), pair("right", "left")
