"""Thresholds and small lookup tables.

Everything is a frozen value passed into the operators; ``merged`` overrides fields, going into nested
mappings key by key, so a job can change one threshold without restating the rest.
"""

from __future__ import annotations

from dataclasses import dataclass, field, fields, replace
from types import MappingProxyType
from typing import Any, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _fixed(d: dict) -> Mapping:
    return MappingProxyType(d)


# ---- fixed values: lookup tables whose entries decide results; kept as plain text -------------------

CLUB_FAMILY = _fixed({
    "Dr": "long", "2Hy": "long", "4Hy": "long", "2i": "long",
    "5i": "mid", "6i": "mid", "7i": "mid",
    "8i": "short", "9i": "short", "PW": "short",
    "GW": "wedge", "SW": "wedge", "LW": "wedge",
})
# names of clubs outside the table, as whole words in any case; the first that fits decides
CLUB_PATTERNS = (
    (r"dr|d|driver|\d+w|\d+hy?|\d+-?wood|\d+-?hybrid", "long"),
    (r"0*[0-4]i", "long"),
    (r"0*[5-7]i", "mid"),
    (r"\d+i", "short"),
    (r"pw", "short"),
    (r"gw|aw|sw|lw|uw", "wedge"),
    (r"(4[8-9]|5\d|6\d)°?", "wedge"),
)
FAMILIES = ("long", "mid", "short", "wedge")
WEDGES = ("GW", "SW", "LW")
SHAPES = ("draw", "straight", "fade")

# how a curve reads: shape meant, side it went to (-1 left, 1 right), size (1 or 2)
CURVE_WORDS = _fixed({
    "draw -1 1": "over-drew", "draw -1 2": "way over-drew", "draw 1 1": "held / under-drew", "draw 1 2": "held it, big",
    "fade -1 1": "held / under-faded", "fade -1 2": "held it, big", "fade 1 1": "over-faded", "fade 1 2": "way over-faded",
    "straight -1 1": "left", "straight -1 2": "well left", "straight 1 1": "right", "straight 1 2": "well right",
})
# words of a miss for each axis: under the target, over it
MISS_SIDES = _fixed({"dist": ("short", "long"), "lat": ("left", "right")})
ON_TARGET, MISS_UNIT = "on target", "yds"
# a derived result: marks and words under and over the target
RESULT_DIST = _fixed({-1: ("−", " short"), 1: ("+", " long")})
RESULT_LAT = _fixed({-1: " L", 1: " R"})
# what may stand between the name of a club and that of its course
NAME_BREAKS = "\\s\\-–—:|,·"

# lie -> lies to look at in order
LIE_CHAIN = _fixed({
    "tee": ("tee", "fairway", "rough"),
    "fairway": ("fairway", "tee", "rough"),
    "rough": ("rough", "fairway", "tee"),
    "sand": ("rough", "fairway", "tee"),
    "recovery": ("rough", "fairway", "tee"),
})
BUCKET_LIE = _fixed({"tee": "fairway", "fairway": "fairway", "rough": "rough"})
SHORT_BAND_LIE = _fixed({"tee": "fairway", "fairway": "fairway", "rough": "rough", "sand": "bunker",
                         "recovery": "rough", "trees": "rough"})
SURFACE_PRIORITY = ("green", "sand", "water", "tee", "fairway", "trees", "ob", "rough")

# expected putts by distance in feet (published averages)
BASELINE_PUTTS = (
    (1, 1.001), (2, 1.009), (3, 1.053), (4, 1.147), (5, 1.256), (6, 1.357), (7, 1.443), (8, 1.515),
    (9, 1.575), (10, 1.626), (15, 1.784), (20, 1.874), (30, 1.984), (40, 2.058), (50, 2.135),
    (60, 2.213), (90, 2.398),
)

EARTH_M = 6371008.8
YARDS_PER_METRE = 1.0936133
METRES_PER_YARD = 0.9144
MONTH_SECONDS = 30.436875 * 24 * 3600
COURSE_NOISE_WORDS = ("golf", "club", "course", "country", "cc", "gc", "the", "links", "and", "at", "of")
# ------------------------------------------------------------------------------------------------------


# the defaults below are fixed values too
@dataclass(frozen=True)
class Settings:
    # results and misses
    on_target_dist_pct: float = 0.05
    on_target_lat_deg: float = 1.5
    slight_yds: float = 8.0
    big_yds: float = 20.0
    low_acc_m: float = 12.0
    custom_line_min_yds: float = 15.0
    custom_line_pct: float = 0.10
    # learning
    takeover_n: int = 30
    shrink_k: float = 5.0
    recency_tiers: tuple = ((3, 1.0), (8, 0.5), (20, 0.2))
    recency_max_months: float = 12.0
    learn_max_ratio: float = 1.3
    learn_slack_yds: float = 20.0
    within_round_fraction: float = 0.5
    evidence_min: int = 2
    clear_after: int = 2
    dist_cap_clubs: float = 1.0
    default_gap_yds: float = 10.0
    heads_up: Mapping = field(default_factory=lambda: _fixed(
        {"today_of": 4, "today_hit": 3, "hist_min_n": 10, "hist_share": 0.3, "over_pct": 0.10}))
    # wind, temperature, altitude
    wind: Mapping = field(default_factory=lambda: _fixed({
        "head_pct": 0.010, "head_curve": 0.00005, "tail_pct": 0.007, "tail_curve": -0.00005,
        "cross_pct": 0.009, "cross_long_mult": 0.8, "head_cap": 0.5, "tail_cap": 0.2,
        "loft": _fixed({"long": 0.75, "mid": 1.0, "short": 1.2, "wedge": 1.35})}))
    forecast_wind_share: float = 0.67
    profile_temp_f: float = 85.0
    temp_pct_per_10f: float = 0.0085
    alt_pct_per_1000ft: float = 0.0116
    ref_elev_ft: float = 1000.0
    elev_factor: float = 1.0
    # lies, roll, curve
    lie_dist_adj: Mapping = field(default_factory=lambda: _fixed(
        {"tee": 0.0, "fairway": 0.0, "rough": -0.08, "sand": -0.12, "recovery": -0.30}))
    lie_dist_adj_family: Mapping = field(default_factory=lambda: _fixed(
        {"rough": _fixed({"wedge": 0.02, "short": 0.02, "mid": -0.04, "long": -0.08})}))
    lie_sd_mult: Mapping = field(default_factory=lambda: _fixed(
        {"tee": 1.0, "fairway": 1.0, "rough": 1.2, "sand": 1.3, "recovery": 1.8}))
    dist_sd_pct: Mapping = field(default_factory=lambda: _fixed(
        {"long": 0.07, "mid": 0.06, "short": 0.05, "wedge": 0.05}))
    roll_club: Mapping = field(default_factory=lambda: _fixed({
        "2Hy": 12.0, "4Hy": 12.0, "5i": 10.0, "6i": 9.0, "7i": 8.0, "8i": 6.0, "9i": 4.0,
        "PW": 1.0, "GW": 1.0, "SW": 0.0, "LW": 0.0}))
    roll_full: Mapping = field(default_factory=lambda: _fixed({"long": 12.0, "mid": 9.0, "short": 4.0, "wedge": 1.0}))
    roll_finesse: Mapping = field(default_factory=lambda: _fixed({"long": 3.0, "mid": 3.0, "short": 1.0, "wedge": 0.0}))
    roll_lie_mult: Mapping = field(default_factory=lambda: _fixed(
        {"tee": 1.0, "fairway": 1.0, "rough": 3.0, "sand": 1.0, "recovery": 3.0}))
    roll_cond_mult: Mapping = field(default_factory=lambda: _fixed({
        "wet": _fixed({"long": 0.35, "mid": 0.5, "short": 0.6, "wedge": 1.4}),
        "firm": _fixed({"long": 1.4, "mid": 1.3, "short": 1.2, "wedge": 1.1}),
        "normal": _fixed({"long": 1.0, "mid": 1.0, "short": 1.0, "wedge": 1.0})}))
    shot_shape: Mapping = field(default_factory=lambda: _fixed({
        "Dr": ("fade", 15.0), "2Hy": ("fade", 10.0), "4Hy": ("fade", 10.0), "5i": ("draw", 7.0),
        "6i": ("draw", 7.0), "7i": ("draw", 7.0), "8i": ("draw", 7.0), "9i": ("draw", 5.0),
        "PW": ("draw", 5.0), "GW": ("draw", 3.0), "SW": ("straight", 0.0), "LW": ("straight", 0.0)}))
    curve_default_yds: float = 5.0
    pattern_aim_min_yds: float = 2.0
    ring_draw_cap_yds: float = 70.0
    big_miss_lat_default: float = 45.0
    tee_only_full: tuple = ("Dr", "2i")
    drop_worst_pct: float = 0.20
    short_tail_over_pct: float = 0.10
    # expected strokes
    hcp_blend: float = 0.42
    hcp_line_tour: tuple = (2.38, 0.0041)
    hcp_line_ninety: tuple = (2.79, 0.0066)
    score_sd_left: tuple = (0.30, 0.03)
    score_sd_right: tuple = (0.60, 0.12)
    # picks
    par_tie: float = 0.01
    exp_tie: float = 0.03
    same_shot_birdie_gain: float = 0.005
    same_shot_target_yds: float = 10.0
    no_hero_max_trouble: float = 0.10
    pin_short_weight: float = 2.0
    pin_tie_yds: float = 2.0
    pin_max_extra_trouble: float = 0.05
    pin_max_cost: float = 0.5
    pin_free_strokes: float = 0.15
    pin_min_trouble_saved: float = 0.02
    fairway_bunker_min_yds: float = 40.0
    # trails
    stop_radius_m: float = 6.0
    stop_min_s: float = 15.0
    thin_m: float = 3.0
    thin_s: float = 10.0
    stop_match_yds: float = 8.0
    # maps
    assign_m: float = 40.0
    coarse_m: float = 8.0
    vote_radius_m: float = 15.0
    vote_min: int = 2
    tee_detect_m: float = 30.0
    tee_snap_yds: float = 15.0
    near_hole_yds: float = 100.0
    # weather
    dew_spread_f: float = 3.0
    dew_cloud_pct: float = 40.0
    dew_wind_mph: float = 5.0
    dew_hours_after_sunrise: float = 3.0
    rain_mm_12h: float = 5.0
    rain_mm_24h: float = 10.0
    firm_dry_days: int = 3
    firm_day_mm: float = 2.5
    firm_tmax_f: float = 85.0
    irrigation_months: tuple = (6, 7, 8, 9)
    irrigation_before_hour: int = 10
    weather_fresh_min: float = 15.0

    def yards(self, field: str) -> float:
        """A setting in metres, in the yards that hole frames are in."""
        return getattr(self, field) * YARDS_PER_METRE

    def merged(self, overrides: Mapping[str, Any] | None) -> "Settings":
        """A copy with the given fields replaced; mappings are merged key by key."""
        known = {f.name for f in fields(self)}
        out = {}
        for k, v in (overrides or {}).items():
            if k not in known:
                raise KeyError(f"unknown setting: {k}")
            out[k] = _deep(getattr(self, k), v)
        return replace(self, **out)


def _deep(base: Any, over: Any) -> Any:
    if isinstance(base, Mapping) and isinstance(over, Mapping):
        return _fixed({**base, **{k: _deep(base.get(k), v) for k, v in over.items()}})
    return over


DEFAULTS = Settings()


def lookup(col: Column, table: Mapping, default=None) -> Column:
    """A handful of fixed entries as one ``CASE`` expression: no join and no shuffle."""
    out = None
    for k, v in table.items():
        cond = col == F.lit(k)
        val = v if isinstance(v, Column) else F.lit(v)
        out = F.when(cond, val) if out is None else out.when(cond, val)
    dflt = default if isinstance(default, Column) else F.lit(default)
    return out.otherwise(dflt)


def table(spark: SparkSession, schema: str, rows) -> DataFrame:
    """A settings table as a DataFrame; how it is joined is left to Spark, which knows its size."""
    return spark.createDataFrame([tuple(r) for r in rows], schema)
