"""What a player's shots teach: recency weights, club overlays, tendencies, scorecards, short-game bands."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loftline.functions.numbers import half_up, r1
from loftline.operators import shots as S
from loftline.operators import stats as W
from loftline.operators.history import latest_n
from loftline.operators.skew import evaluated_once
from loftline.settings import DEFAULTS, LIE_CHAIN, MONTH_SECONDS, SHORT_BAND_LIE, Settings, lookup

ENTRY = ["player_id", "club", "swing", "lie"]


def recency_weights(shots: DataFrame, cfg: Settings = DEFAULTS, now_s: int | None = None) -> DataFrame:
    """A-01/W-08: weight per (player, round) by how many rounds ago it was; rounds past the last tier are absent.

    Rounds are reduced to one row each first, and only the newest few per player travel (a pushed-down group limit).
    """
    tiers = cfg.recency_tiers
    last = shots.groupBy("player_id", "round_id").agg(F.max("ts_s").alias("last_s"))
    top = latest_n(last, ["player_id"], [F.col("last_s").desc(), F.col("round_id")], int(tiers[-1][0]), "rounds_ago")
    w = None
    for upto, val in tiers:
        w = F.when(F.col("rounds_ago") <= upto, val) if w is None else w.when(F.col("rounds_ago") <= upto, val)
    w = w.otherwise(0.0)
    if now_s is not None:
        w = F.when((F.lit(now_s) - F.col("last_s")) / MONTH_SECONDS > cfg.recency_max_months, 0.0).otherwise(w)
    return top.select("player_id", "round_id", "rounds_ago", w.alias("w")).filter("w > 0")


def weighted_shots(shots: DataFrame, totals: DataFrame | None = None, cfg: Settings = DEFAULTS, now_s: int | None = None) -> DataFrame:
    """Eligible shots of recent rounds with their weight."""
    el = S.eligible(shots, totals, cfg)
    return el.join(recency_weights(el, cfg, now_s), ["player_id", "round_id"])


def priors(targets: DataFrame, entries: DataFrame, order: dict[str, int], fields: Sequence[str]) -> DataFrame:
    """J-04: per field the nearest known value: own entry, same club on an adjacent lie, then the nearest club.

    ``targets`` has a row for each entry; its other columns come along.  A player has a bounded bag, so matching targets
    to entries on (player, swing) fans out by the bag size only.
    """
    more = [k for k in targets.columns if k not in ENTRY]
    rank_lie = lookup(F.concat_ws(">", "lie", "_lie"), {f"{a}>{b}": i for a, ch in LIE_CHAIN.items() for i, b in enumerate(ch)}, 9)
    pos, pos2 = lookup(F.col("club"), order), lookup(F.col("_club"), order)
    gap = F.abs(pos2 - pos)
    same_club, same_lie = F.col("club") == F.col("_club"), F.col("lie") == F.col("_lie")
    rank = (F.when(same_club & same_lie, 0).when(same_club, 10 + rank_lie)
            .when(same_lie, 100 + 2 * gap + F.when(pos2 > pos, 1).otherwise(0)))
    e = entries.select("player_id", "swing", F.col("club").alias("_club"), F.col("lie").alias("_lie"), *[F.col(f).alias(f"_{f}") for f in fields])
    cand = targets.select(*ENTRY, *([F.struct(*more).alias("_row")] if more else [])).join(e, ["player_id", "swing"], "left").withColumn("_rank", rank)
    best = lambda f: F.min_by(F.struct(F.col(f"_{f}").alias("value"), F.col("_club").alias("club"), F.col("_lie").alias("lie"),
                                       F.col("_rank").alias("rank")),
                              F.when(F.col(f"_{f}").isNotNull(), F.col("_rank"))).alias(f"p_{f}")
    got = cand.groupBy(*ENTRY).agg(*([F.first("_row").alias("_row")] if more else []), *[best(f) for f in fields])
    return got.select(*ENTRY, *([F.col("_row")[k].alias(k) for k in more]), *[f"p_{f}" for f in fields])


def overlay(shots: DataFrame, entries: DataFrame, order: dict[str, int], cfg: Settings = DEFAULTS, now_s: int | None = None) -> DataFrame:
    """A-11: per player, club, swing and lie, personal figures shrunk to the prior, or taken over from 30 shots on."""
    ws = weighted_shots(shots, entries.select(*ENTRY, "total_yds"), cfg, now_s)
    ws = (ws.withColumn("lm", S.pattern_lat(cfg)).withColumn("act", S.actual_yds())
          .withColumn("ny", -F.col("dist_miss_yds")))
    ws = ws.withColumn("ang", F.when(F.col("act") > 0, F.degrees(F.atan2(F.col("lm"), F.col("act")))))
    ws = evaluated_once(ws.select(*ENTRY, "w", "lm", "ny", "act", "ang", "dist_miss_yds"))
    aw = F.when(F.col("ang").isNotNull(), F.col("w"))
    agg = ws.groupBy(*ENTRY).agg(
        F.count(F.lit(1)).alias("n"), *W.moments("lm", "ny", "w"),
        F.sum(aw).alias("_AW"), F.sum(aw * aw).alias("_AW2"), F.sum(aw * F.col("ang")).alias("_A"), F.sum(aw * F.col("ang") * F.col("ang")).alias("_AA"),
        F.collect_list(F.struct(F.col("act").alias("v"), F.col("w"))).alias("_acts"))   # shots of a player's newest rounds with one club
    g = agg.withColumn("own_total", W.weighted_median_of(F.col("_acts"))).drop("_acts").filter("own_total IS NOT NULL")
    g = evaluated_once(priors(g, entries, order, ["total_yds", "dist_sd", "lat_sd_deg"]))
    fam = S.club_family("club")
    far = lambda f: F.col(f"p_{f}.rank").between(10, 99)
    d_factor = (1 + S.lie_adj("lie", fam, cfg)) / (1 + S.lie_adj(F.col("p_total_yds.lie"), fam, cfg))
    sd_factor = lambda f: S.lie_sd("lie", cfg) / S.lie_sd(F.col(f"p_{f}.lie"), cfg)
    p_total = F.col("p_total_yds.value") * F.when(far("total_yds"), d_factor).otherwise(1.0)
    p_dist = F.col("p_dist_sd.value")
    p_lat = F.col("p_lat_sd_deg.value") * F.when(far("lat_sd_deg"), sd_factor("lat_sd_deg")).otherwise(1.0)
    take = F.col("n") >= cfg.takeover_n
    mix = lambda own, pr, n: F.when(take, F.coalesce(own, pr)).otherwise(W.shrink(own, pr, n, cfg.shrink_k))
    own_dist, own_lat = F.sqrt(W.w_var("_YY", "_Y")), F.sqrt(W.w_var("_AA", "_A", "_AW", "_AW2"))
    ell = W.ell80(W.w_var("_XX", "_X"), W.w_var("_YY", "_Y"), W.w_cov())
    out = (g.withColumn("n_eff", F.col("_W")).withColumn("takeover", take)
           .withColumn("total", mix(F.col("own_total"), p_total, F.col("_W")))
           .withColumn("dist_sd", mix(own_dist, p_dist * F.when(far("dist_sd"), sd_factor("dist_sd")).otherwise(1.0), F.col("_W")))
           .withColumn("lat_sd_deg", mix(own_lat, p_lat, F.col("_AW")))
           .withColumn("bias_dist", mix(-F.col("_Y") / F.col("_W"), F.lit(0.0), F.col("_W")))
           .withColumn("bias_lat", mix(F.col("_X") / F.col("_W"), F.lit(0.0), F.col("_W")))
           .withColumn("ell80", F.when(take, ell)))
    out = evaluated_once(out.select(*ENTRY, "n", "n_eff", "takeover", "total", "dist_sd", "lat_sd_deg", "bias_dist", "bias_lat", "ell80"))
    out = out.withColumn("carry", F.col("total") - S.roll_yds(F.lit(None).cast("string"), "swing", fam, "lie", cfg))
    return out.select(*ENTRY, "n", "n_eff", "takeover", "total", "carry", "dist_sd", "lat_sd_deg", "bias_dist", "bias_lat", "ell80")


def merge_overlay(entries: DataFrame, over: DataFrame) -> DataFrame:
    """A-13: overlay onto base entry field by field; a measured carry stays unless the player's own shots took over."""
    o = over.select(*ENTRY, F.lit(True).alias("_has"), F.col("n").alias("_n"), F.col("takeover").alias("_t"), F.col("total").alias("_total"), F.col("carry").alias("_carry"),
                    F.col("dist_sd").alias("_dsd"), F.col("lat_sd_deg").alias("_lsd"))
    j = entries.join(o, ENTRY, "full_outer")
    keep = F.coalesce(~F.col("_t") & (F.col("carry_source") == "measured"), F.lit(False))
    return j.select(*ENTRY, F.coalesce("_total", "total_yds").alias("total"),
                    F.when(keep, F.col("carry_yds")).otherwise(F.coalesce("_carry", "carry_yds")).alias("carry"),
                    F.when(~keep & F.col("_carry").isNotNull(), "derived").otherwise(F.col("carry_source")).alias("carry_source"),
                    F.coalesce("_dsd", "dist_sd").alias("dist_sd"), F.coalesce("_lsd", "lat_sd_deg").alias("lat_sd_deg"),
                    F.when(F.coalesce("_t", F.lit(False)), F.col("_n")).otherwise(F.col("n")).alias("n"),
                    F.when(F.col("_has"), F.when(F.col("_t"), "own").otherwise("blend")).alias("source"))


# ---- tendencies ---------------------------------------------------------------------------------------

def pct(k: Column, n: Column) -> Column:
    return F.when(n > 0, r1(100.0 * k / n))


def tendencies(shots: DataFrame, keys: Sequence[str], types=("full", "finesse", "putt"), cfg: Settings = DEFAULTS) -> DataFrame:
    """A-16: shares of left/right/short/long/big misses, each over the rows that know that axis.

    Putts count under "Putter" with signs from the graded axes; graded yards win over sign words.
    """
    putt = F.col("shot_type") == "putt"
    df = (shots.filter(S.teaches() & (F.col("logged") != "skipped") & ~F.coalesce(F.col("end_assumed"), F.lit(False)) & F.col("shot_type").isin(*types))
          .withColumn("club", F.when(putt, "Putter").otherwise(F.col("club"))).filter(F.col("club").isNotNull()))
    df = evaluated_once(df.select(*keys, "shot_type", "putt_line", "putt_speed", "lat_sign", "dist_sign", "dist_miss_yds", "miss_total_yds", S.pattern_lat(cfg).alias("_own")))
    own = F.col("_own")
    lat = F.when(putt, F.col("putt_line")).when(own.isNotNull(), F.signum(own)).otherwise(F.col("lat_sign"))
    dist = F.when(putt, F.col("putt_speed")).when(F.col("dist_miss_yds").isNotNull(), F.signum("dist_miss_yds")).otherwise(F.col("dist_sign"))
    big = F.when(putt, None).when(own.isNotNull(), F.abs(own) > cfg.big_yds).when(F.col("miss_total_yds") <= cfg.big_yds, False)
    df = df.select(*keys, F.signum(lat).alias("_lat"), F.signum(dist).alias("_dist"), big.alias("_big")).filter("_lat IS NOT NULL OR _dist IS NOT NULL OR _big IS NOT NULL")
    k = lambda cond: F.count(F.when(cond, 1))
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count("_lat").alias("n_lat"), F.count("_dist").alias("n_dist"), F.count("_big").alias("n_big"),
                              k(F.col("_lat") < 0).alias("_l"), k(F.col("_lat") > 0).alias("_r"), k(F.col("_dist") < 0).alias("_s"),
                              k(F.col("_dist") > 0).alias("_g"), k(F.col("_big")).alias("_b"))
    return g.select(*keys, "n", "n_lat", "n_dist", "n_big", pct(F.col("_l"), F.col("n_lat")).alias("left_pct"), pct(F.col("_r"), F.col("n_lat")).alias("right_pct"),
                    pct(F.col("_s"), F.col("n_dist")).alias("short_pct"), pct(F.col("_g"), F.col("n_dist")).alias("long_pct"), pct(F.col("_b"), F.col("n_big")).alias("big_pct"))


def miss_summary(shots: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """A-17: per player, club and swing, mean misses, median radial miss, line bias, and the A-16 shares."""
    keys = ["player_id", "club", "swing"]
    rows = shots.filter(F.col("shot_type").isin("full", "finesse")).withColumn("swing", F.col("shot_type"))
    tend = tendencies(rows, keys, ("full", "finesse"), cfg).withColumnRenamed("n", "_tn")
    yds = rows.filter(S.teaches() & (F.col("logged") != "skipped") & F.col("club").isNotNull() & S.has_misses()).select(
        *keys, "dist_miss_yds", "lat_miss_yds", S.pattern_lat(cfg).alias("line"), F.hypot("dist_miss_yds", "lat_miss_yds").alias("off"))
    yds = evaluated_once(yds)
    means = yds.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_yds"), r1(F.avg("dist_miss_yds")).alias("long_yds"),
                                   r1(F.avg("lat_miss_yds")).alias("right_yds"), r1(F.avg("line")).alias("line_yds"))
    med = W.weighted_median(yds, keys, "off", None, "off_yds", width=2.0)
    out = tend.join(means.join(med, keys), keys, "full_outer")
    return out.select(*keys, F.greatest(F.coalesce("_tn", F.lit(0)), F.coalesce("n_yds", F.lit(0))).alias("n"), F.coalesce("n_yds", F.lit(0)).alias("n_yds"),
                      "long_yds", "right_yds", r1("off_yds").alias("off_yds"), "line_yds", "left_pct", "right_pct", "short_pct", "long_pct")


def miss_words(df: DataFrame) -> DataFrame:
    """The summary row as words: target line, start line and shares."""
    def side(v, neg, pos):
        return F.when(F.abs(v) >= 0.5, F.concat(S._whole(F.abs(v)), F.lit(" "), F.when(v < 0, neg).otherwise(pos)))

    def share(a, b, wa, wb):
        top, word = F.when(a >= b, a).otherwise(b), F.when(a >= b, wa).otherwise(wb)
        return F.when(a.isNull() | b.isNull() | ((a == 0) & (b == 0)), None).otherwise(F.concat(word, F.lit(" "), S._whole(top / 10), F.lit(" in 10")))
    parts = F.concat_ws(S.DOT, side(F.col("long_yds"), "short", "long"), side(F.col("right_yds"), "L", "R"))
    shares = F.concat_ws(S.DOT, share(F.col("left_pct"), F.col("right_pct"), "L", "R"), share(F.col("short_pct"), F.col("long_pct"), "short", "long"))
    return df.select("player_id", "club", "swing",
                     F.when(F.col("n_yds") > 0, F.concat(F.when(parts == "", "on line").otherwise(parts), F.lit(" · off by "), S._whole("off_yds"))).alias("target_words"),
                     F.when(F.col("line_yds").isNotNull(), F.coalesce(side(F.col("line_yds"), "L", "R"), F.lit("straight"))).alias("line_words"),
                     F.when(shares != "", shares).alias("share_words"))


# ---- scorecards ---------------------------------------------------------------------------------------

def aggression(shots: DataFrame, scores: DataFrame) -> DataFrame:
    """A-18: strokes against the price of the chosen line, per player and per (player, round).

    Sums are combined per round first; the season row adds up the round rows.
    """
    df = (shots.filter(S.teaches() & F.col("line_played").isin("safe", "aggressive", "own", "custom") & ~F.col("shot_type").isin("putt", "shortGame"))
          .withColumn("line", S.norm_line("line_played")).join(scores, ["player_id", "round_id", "hole"], "left"))
    known = F.col("score").isNotNull() & F.col("exp_score").isNotNull() & F.col("shot_no").isNotNull()
    delta = F.when(known, F.col("score") - (F.col("shot_no") - 1) - F.col("exp_score"))
    per = df.groupBy("player_id", "round_id", "line").agg(F.count(F.lit(1)).alias("n"), F.count(delta).alias("scored"), F.sum(delta).alias("_d"))
    season = per.groupBy("player_id", "line").agg(F.sum("n").alias("n"), F.sum("scored").alias("scored"), F.sum("_d").alias("_d")).withColumn("round_id", F.lit(None).cast("bigint"))
    return per.unionByName(season).select("player_id", "round_id", "line", "n", "scored", half_up(F.coalesce("_d", F.lit(0.0)), 3).alias("delta"))


def tee_grades(shots: DataFrame) -> DataFrame:
    """A-19: first-shot counts by line."""
    df = shots.filter(S.teaches() & (F.col("shot_no") == 1) & (F.col("logged") != "skipped") & (F.col("shot_type") != "putt"))
    line = S.norm_line("line_played")
    k = lambda v: F.count(F.when(line == v, 1)).alias(v)
    return df.groupBy("player_id").agg(k("safe"), k("aggressive"), k("custom"), F.count(F.when(line.isin("safe", "aggressive", "custom"), 1)).alias("total"))


def usual_shape(shots: DataFrame) -> DataFrame:
    """A-21: the most common intended shape; straight wins ties, then draw."""
    g = shots.filter(S.teaches()).groupBy("player_id", "club").agg(*[F.count(F.when(F.col("shape") == s, 1)).alias(s) for s in ("straight", "draw", "fade")])
    top = F.greatest("straight", "draw", "fade")
    return g.select("player_id", "club", F.when(F.col("straight") == top, "straight").when(F.col("draw") == top, "draw").otherwise("fade").alias("shape"), top.alias("n"))


def club_gaps(entries: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """A-20: mean carry gap between neighbouring clubs of a family, else the gaps touching it, else the default."""
    fam = S.club_family("club")
    e = entries.filter((F.col("swing") == "full") & F.col("total_yds").isNotNull()).withColumn("fam", fam).filter("fam IS NOT NULL")
    e = e.withColumn("carry", F.col("total_yds") - S.roll_yds(F.lit(None).cast("string"), "swing", "fam", "lie", cfg))
    pick = lookup(F.col("lie"), {"fairway": 0, "tee": 1, "rough": 2}, 9)
    one = e.groupBy("player_id", "club", "fam").agg(F.min_by("carry", pick).alias("carry"))
    w = Window.partitionBy("player_id").orderBy(F.col("carry").desc(), "club")   # a bag holds a bounded number of clubs
    g = one.withColumn("gap", F.col("carry") - F.lead("carry").over(w)).withColumn("fam2", F.lead("fam").over(w)).filter("gap > 0")
    touch = g.select("player_id", F.col("fam"), "gap", (F.col("fam") == F.col("fam2")).alias("same")).unionByName(
        g.filter("fam <> fam2").select("player_id", F.col("fam2").alias("fam"), "gap", F.lit(False).alias("same")))
    got = touch.groupBy("player_id", "fam").agg(F.avg(F.when(F.col("same"), F.col("gap"))).alias("_s"), F.avg("gap").alias("_t"))
    fams = entries.select("player_id").distinct().select("player_id", F.explode(F.array(*[F.lit(f) for f in ("long", "mid", "short", "wedge")])).alias("fam"))
    return fams.join(got, ["player_id", "fam"], "left").select("player_id", "fam", F.coalesce("_s", "_t", F.lit(cfg.default_gap_yds)).alias("gap_yds"))


# ---- short game ---------------------------------------------------------------------------------------

def chip_outcomes(shots: DataFrame, scores: DataFrame) -> DataFrame:
    """A-14: up-and-down and leave of each chip, or unknown when the log does not add up.  One pass over the hole's facts."""
    live = shots.filter(S.teaches() & (F.col("logged") != "skipped"))
    putt = F.col("shot_type") == "putt"
    facts = live.groupBy("player_id", "round_id", "hole").agg(
        F.count(F.when(~putt, 1)).alias("_shots"), F.count(F.when(putt, 1)).alias("_putts"),
        F.array_sort(F.collect_set(F.when(~putt, F.col("shot_no")))).alias("_nos"),
        F.min_by(F.struct("shot_no", "made", "putt_ft"), F.when(putt, F.col("shot_no"))).alias("_p1"))
    ch = live.filter(F.col("shot_type") == "shortGame").join(facts, ["player_id", "round_id", "hole"]).join(scores, ["player_id", "round_id", "hole"], "left")
    nxt = F.array_contains("_nos", F.col("shot_no") + 1)
    later = F.exists("_nos", lambda v: v > F.col("shot_no"))
    holed = F.coalesce(F.col("holed"), F.lit(False))
    bad = F.col("score").isNotNull() & (F.col("score") != F.col("_shots") + F.col("_putts"))
    has_p1 = F.col("_p1.shot_no") == 1
    ud = (F.when(bad, None).when(holed, F.when(F.col("_putts") == 0, True)).when(nxt, False).when(later, None)
          .when(F.coalesce(has_p1, F.lit(False)), F.col("_p1.made")))
    leave = F.when(ud.isNull(), None).when(holed, 0.0).when(nxt, None).otherwise(F.col("_p1.putt_ft"))
    return ch.withColumn("up_down", ud).withColumn("leave_ft", leave)


def short_game(shots: DataFrame, scores: DataFrame, bands: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """A-15: weighted up-and-down rate and median leave per distance band, shrunk to the band's figures.

    ``bands`` (band_lie, from_yds, to_yds, up_down, prox_ft) is a settings table, joined by broadcast.
    """
    out = chip_outcomes(shots, scores).withColumn("band_lie", lookup(F.col("lie"), SHORT_BAND_LIE))
    out = out.join(bands, (out["band_lie"] == bands["band_lie"]) & (out["to_pin_yds"] >= bands["from_yds"]) & (out["to_pin_yds"] < bands["to_yds"])).drop(bands["band_lie"])
    chips = shots.filter(S.teaches() & (F.col("logged") != "skipped") & (F.col("shot_type") == "shortGame"))
    out = out.filter("up_down IS NOT NULL").join(recency_weights(chips, cfg), ["player_id", "round_id"])
    keys = ["player_id", "band_lie", "from_yds"]
    g = out.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("n_eff"), F.sum(F.col("w") * F.col("up_down").cast("int")).alias("_u"),
                               F.sum(F.when(F.col("leave_ft").isNotNull(), F.col("w"))).alias("_lw"), F.max("up_down_pct").alias("_pu"), F.max("prox_ft").alias("_pp"))
    med = W.weighted_median(out, keys, "leave_ft", F.col("w"), "_leave")
    g = g.join(med, keys, "left")
    return g.select(*keys, "n", r1("n_eff").alias("n_eff"),
                    half_up(W.shrink(F.col("_u") / F.col("n_eff"), F.col("_pu"), F.col("n_eff"), cfg.shrink_k), 3).alias("up_down_pct"),
                    r1(W.shrink(F.col("_leave"), F.col("_pp"), F.col("_lw"), cfg.shrink_k)).alias("prox_ft"))
