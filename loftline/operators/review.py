"""Order within a hole or a round: chained ends, renumbering, reviews, evidence and corrections.

Windows here are keyed by (player, round, ...): a round is one person's outing, and each row is seen once.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loftline.functions.numbers import r1, sign_int
from loftline.operators import shots as S
from loftline.settings import DEFAULTS, FAMILIES, Settings

HOLE = ["player_id", "round_id", "hole"]


def chain_close(shots: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """W-01: a shot ends where the next number starts; the last at the first putt; else at its own end.  Then O-20."""
    is_putt = F.col("shot_type") == "putt"
    putt = shots.filter(is_putt).groupBy(*HOLE).agg(F.min_by(F.struct("sx", "sy"), F.col("shot_no")).alias("_p"))
    w = Window.partitionBy(*HOLE).orderBy("shot_no", "ts_s", "shot_id")
    s = (shots.filter(~is_putt).withColumn("_n", F.lead(F.struct("shot_no", "sx", "sy")).over(w)).join(putt, HOLE, "left"))
    nxt = F.when(F.col("_n.shot_no") == F.col("shot_no") + 1, F.struct(F.col("_n.sx").alias("x"), F.col("_n.sy").alias("y")))
    last = F.when(F.col("_n").isNull() & F.col("_p").isNotNull(), F.struct(F.col("_p.sx").alias("x"), F.col("_p.sy").alias("y")))
    s = s.withColumn("_e", F.coalesce(nxt, last))
    s = s.withColumn("end_from", F.when(nxt.isNotNull(), "next").when(last.isNotNull(), "putt").otherwise("own"))
    s = s.withColumn("ex", F.coalesce("_e.x", "ex")).withColumn("ey", F.coalesce("_e.y", "ey")).drop("_n", "_p", "_e")
    return S.close_out(s, cfg)


def renumber(shots: DataFrame) -> DataFrame:
    """W-06: strokes 1..n per hole and kind in their current order."""
    w = Window.partitionBy(*HOLE, F.col("shot_type") == "putt").orderBy(F.coalesce("shot_no", F.lit(99)), "ts_s", "shot_id")
    return shots.withColumn("new_no", F.row_number().over(w))


def hole_lists(shots: DataFrame) -> DataFrame:
    """W-11: the distinct holes of a round in order, as "H1, H3" and as "1 and 3".  At most one entry per hole."""
    g = shots.groupBy("player_id", "round_id").agg(F.array_sort(F.collect_set("hole")).alias("h"))
    txt = F.transform("h", lambda v: v.cast("string"))
    words = F.when(F.size("h") == 1, txt[0]).otherwise(F.concat(
        F.array_join(F.slice(txt, F.lit(1), F.size("h") - 1), ", "), F.lit(" and "), F.element_at(txt, -1)))
    return g.select("player_id", "round_id", F.array_join(F.transform(txt, lambda v: F.concat(F.lit("H"), v)), ", ").alias("tags"), words.alias("words"))


def hole_review(shots: DataFrame, scores: DataFrame) -> DataFrame:
    """A-26: expected strokes against logged ones per hole: missing numbers, extra rows, unreviewed, count mismatch."""
    is_putt = F.col("shot_type") == "putt"
    g = shots.groupBy(*HOLE).agg(
        F.count(F.when(~is_putt, 1)).alias("n_shots"), F.count(F.when(is_putt, 1)).alias("n_putts"),
        F.array_sort(F.collect_set(F.when(~is_putt & (F.col("shot_no") >= 1), F.col("shot_no")))).alias("_nos"),
        F.count(F.when(~F.col("reviewed"), 1)).alias("unreviewed"))
    g = g.join(scores, HOLE, "left")
    done = F.coalesce(F.col("score") > 0, F.lit(False))
    need = done & (F.col("n_putts") == 0)
    g = g.withColumn("_putts", F.when(need, F.greatest(F.lit(0), F.col("score") - F.col("n_shots"))).otherwise(F.col("n_putts")))
    g = g.withColumn("expected", F.when(done, F.greatest(F.lit(0), F.col("score") - F.col("_putts"))).otherwise(0))
    g = g.withColumn("_top", F.greatest("expected", F.coalesce(F.array_max("_nos"), F.lit(0))))
    miss = F.array_except(F.when(F.col("_top") > 0, F.sequence(F.lit(1), F.col("_top").cast("int"))).otherwise(F.array().cast("array<int>")), F.col("_nos"))
    g = g.withColumn("_miss", miss).withColumn("extras", F.col("n_shots") - F.size("_nos"))
    g = g.withColumn("story", F.col("_top") + F.col("extras") + F.col("_putts"))
    bad = done & (F.col("story") != F.col("score"))
    return g.select(*HOLE, "n_shots", "n_putts", F.col("expected").cast("bigint").alias("expected"), F.array_join("_miss", ",").alias("missing"), "extras", "unreviewed",
                    F.col("story").cast("bigint").alias("story"), need.alias("putts_needed"), bad.alias("count_off"),
                    ((F.col("unreviewed") > 0) | (F.size("_miss") > 0) | need | bad).alias("needed"))


def reconcile(shots: DataFrame, scores: DataFrame) -> DataFrame:
    """A-25: holes whose records plus penalties do not add up to the printed score."""
    g = shots.groupBy(*HOLE).agg(F.count(F.lit(1)).alias("records"), F.count(F.when(F.col("penalty"), 1)).alias("penalties"))
    return g.join(scores, HOLE).filter(F.col("records") + F.col("penalties") != F.col("score"))


def inferred_putts(shots: DataFrame, scores: DataFrame) -> DataFrame:
    """A-40: the putts a score implies when none were logged; the last one holed, ungraded."""
    is_putt = F.col("shot_type") == "putt"
    g = shots.groupBy(*HOLE).agg(F.count(F.when(~is_putt, 1)).alias("n"), F.count(F.when(is_putt, 1)).alias("p")).join(scores, HOLE)
    k = F.col("score") - F.col("n")
    return (g.filter((F.col("p") == 0) & (k > 0)).select(*HOLE, k.alias("_k"), F.explode(F.sequence(F.lit(1), k.cast("int"))).alias("putt_no"))
            .select(*HOLE, "putt_no", (F.col("putt_no") == F.col("_k")).alias("made")))


def on_target(cfg: Settings = DEFAULTS) -> Column:
    """The ellipse test used where no stored flag exists."""
    d = F.col("intended_yds")
    return (F.pow(F.col("dist_miss_yds") / (cfg.on_target_dist_pct * d), 2)
            + F.pow(F.col("lat_miss_yds") / (d * math.tan(math.radians(cfg.on_target_lat_deg))), 2)) <= 1


_GROUP = ["player_id", "round_id", "kind", "key"]


def miss_rows(shots: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """What each teaching shot says of a miss: a row for its club family and its lie, and for each axis it has a result on.

    Columns: player_id, round_id, kind, key, hole, shot_id, ts_s, axis, ok, dir, miss, and ts where the shots have one.
    """
    ts = [c for c in ("ts",) if c in shots.columns]
    s = shots.filter(S.teaches() & (F.col("logged") != "skipped") & F.col("shot_type").isin("full", "finesse"))
    s = s.withColumn("has", S.has_misses()).withColumn("on", on_target(cfg) & S.has_misses())
    d = F.col("intended_yds")
    s = (s.withColumn("d_dist", F.when(F.col("has") & ~F.col("on") & (F.abs("dist_miss_yds") > cfg.on_target_dist_pct * d), sign_int("dist_miss_yds")))
          .withColumn("d_lat", F.when(F.col("has") & ~F.col("on") & (F.abs("lat_miss_yds") > d * math.tan(math.radians(cfg.on_target_lat_deg))), sign_int("lat_miss_yds")))
          .withColumn("d_con", F.when(F.abs("contact") >= 1, F.signum("contact").cast("int"))))
    g = s.select("player_id", "round_id", "hole", "shot_id", "ts_s", *ts, "has", "on", "contact", "d_dist", "d_lat", "d_con", "dist_miss_yds", "lat_miss_yds",
                 F.explode(F.array(F.struct(F.lit("family").alias("kind"), S.club_family("club").alias("key")),
                                   F.struct(F.lit("lie").alias("kind"), F.col("lie").alias("key")))).alias("g")).filter("g.key IS NOT NULL")
    g = g.select("*", "g.kind", "g.key").drop("g")
    axes = [("distance", F.col("has"), F.col("on"), "d_dist", F.col("dist_miss_yds")), ("direction", F.col("has"), F.col("on"), "d_lat", F.col("lat_miss_yds")),
            ("contact", F.col("contact").isNotNull(), F.abs("contact") < 1, "d_con", F.lit(None).cast("double"))]
    rows = g.select(*_GROUP, "hole", "shot_id", "ts_s", *ts, F.explode(F.array(*[F.struct(F.lit(n).alias("axis"), F.coalesce(live, F.lit(False)).alias("live"),
                    F.coalesce(ok, F.lit(False)).alias("ok"), F.col(dr).alias("dir"), val.alias("miss")) for n, live, ok, dr, val in axes])).alias("a"))
    return rows.filter("a.live").select(*_GROUP, "hole", "shot_id", "ts_s", *ts, "a.axis", "a.ok", "a.dir", "a.miss")


def evidence(shots: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """W-02: per round, group (club family or lie) and axis, the misses still standing.

    A miss stands if it comes after the last pair of on-target shots in a row; rows without a result leave the
    run alone.  Contact is its own axis, cleared by two clean strikes in a row.
    """
    keys, rows = _GROUP, miss_rows(shots, cfg)
    part = Window.partitionBy(*keys, "axis")
    w = part.orderBy("ts_s", "shot_id")
    prev = F.lag("ok", cfg.clear_after - 1).over(w)
    rows = rows.withColumn("pos", F.row_number().over(w)).withColumn("_clear", F.col("ok") & F.coalesce(prev, F.lit(False)))
    rows = rows.withColumn("_cut", F.coalesce(F.max(F.when(F.col("_clear"), F.col("pos"))).over(part), F.lit(0)))
    return rows.filter((F.col("pos") > F.col("_cut")) & F.col("dir").isNotNull() & (F.col("dir") != 0)).select(*keys, "axis", "hole", "shot_id", "dir", "miss")


def corrections(ev: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """W-04: two or more standing misses one way, and more than the other; mean miss and the half-way shift back.

    A lie group whose misses all lie inside a family group's of the same axis and side adds nothing and is dropped.
    """
    keys = ["player_id", "round_id", "kind", "key", "axis"]
    g = ev.groupBy(*keys).agg(*[a for d, n in ((-1, "neg"), (1, "pos")) for a in (
        F.count(F.when(F.col("dir") == d, 1)).alias(f"n_{n}"), F.avg(F.when(F.col("dir") == d, F.col("miss"))).alias(f"m_{n}"),
        F.collect_list(F.when(F.col("dir") == d, F.col("shot_id"))).alias(f"i_{n}"))])
    neg = (F.col("n_neg") >= cfg.evidence_min) & (F.col("n_neg") > F.col("n_pos"))
    pos = (F.col("n_pos") >= cfg.evidence_min) & (F.col("n_pos") > F.col("n_neg"))
    g = g.filter(neg | pos).select(*keys, F.when(neg, -1).otherwise(1).alias("dir"), F.when(neg, F.col("n_neg")).otherwise(F.col("n_pos")).alias("n"),
                                   F.when(neg, F.col("m_neg")).otherwise(F.col("m_pos")).alias("mean_miss"), F.when(neg, F.col("i_neg")).otherwise(F.col("i_pos")).alias("ids"))
    fam = g.filter("kind = 'family'").select("player_id", "round_id", "axis", "dir", F.col("ids").alias("_f"))
    same = ["player_id", "round_id", "axis", "dir"]
    covered = (g.filter("kind = 'lie'").join(fam, same).filter(F.size(F.array_except("ids", "_f")) == 0).select(*keys).distinct())
    return g.join(covered, keys, "left_anti").withColumn("raw_shift", -cfg.within_round_fraction * F.col("mean_miss"))


def adjustments(corr: DataFrame, gaps: DataFrame, lie: str, cfg: Settings = DEFAULTS) -> DataFrame:
    """Shift per round, family and axis: family groups on their own family, the given lie's group on all; the largest wins.

    Distance shifts are capped at one club gap; shifts are never added up.
    """
    fams = F.array(*[F.lit(f) for f in FAMILIES])
    use = corr.filter((F.col("axis") != "contact") & ((F.col("kind") == "family") | (F.col("key") == lie)))
    use = use.withColumn("fam", F.explode(F.when(F.col("kind") == "family", F.array("key")).otherwise(fams)))
    use = use.join(gaps, ["player_id", "fam"], "left")
    cap = cfg.dist_cap_clubs * F.coalesce("gap_yds", F.lit(cfg.default_gap_yds))
    shift = F.when(F.col("axis") == "distance", F.greatest(-cap, F.least(cap, F.col("raw_shift")))).otherwise(F.col("raw_shift"))
    use = use.withColumn("shift", shift)
    return use.groupBy("player_id", "round_id", "fam", "axis").agg(
        r1(F.max_by("shift", F.struct(F.abs("shift"), F.when(F.col("kind") == "family", 1).otherwise(0)))).alias("shift_yds"))


def heads_up(shots: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """W-05: the same miss on 3 of the last 4 today (or 2 of 2), else a long-run short or long share.

    "Today" is each player's latest round; the long-run part is counts only.
    """
    h = cfg.heads_up
    mine = shots.filter(S.teaches() & (F.col("logged") != "skipped") & ~F.coalesce(F.col("end_assumed"), F.lit(False)) & F.col("shot_type").isin("full", "finesse"))
    keys = ["player_id", "club", "swing"]
    mine = mine.withColumn("swing", F.col("shot_type"))
    latest = mine.groupBy("player_id").agg(F.max(F.struct("day_no", "round_id")).alias("_l"))
    latest = latest.select("player_id", F.col("_l.round_id").alias("round_id"))
    d = F.col("intended_yds")
    side = lambda v, tol: F.when(F.abs(v) > tol, F.signum(v).cast("int")).otherwise(0)
    today = mine.join(latest, ["player_id", "round_id"], "left_semi").select(*keys, "ts_s", "shot_id", F.explode(F.array(
        F.struct(F.lit(0).alias("ax"), side(F.col("lat_miss_yds"), d * math.tan(math.radians(cfg.on_target_lat_deg))).alias("v")),
        F.struct(F.lit(1).alias("ax"), side(F.col("dist_miss_yds"), d * cfg.on_target_dist_pct).alias("v")))).alias("a")).select(*keys, "ts_s", "shot_id", "a.*")
    w = Window.partitionBy(*keys, "ax").orderBy(F.col("ts_s").desc(), F.col("shot_id").desc())
    seen = today.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= h["today_of"])
    g = seen.groupBy(*keys, "ax").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("v") == -1, 1)).alias("neg"), F.count(F.when(F.col("v") == 1, 1)).alias("pos"))
    hit = lambda k: ((F.col("n") == 2) & (F.col(k) == 2)) | ((F.col("n") >= 3) & (F.col(k) >= h["today_hit"]))
    words = F.when(F.col("ax") == 0, F.when(hit("neg"), "left").otherwise("right")).otherwise(F.when(hit("neg"), "short").otherwise("long"))
    hot = g.filter(hit("neg") | hit("pos")).groupBy(*keys).agg(F.min_by(F.struct(words.alias("dir"), F.when(hit("neg"), F.col("neg")).otherwise(F.col("pos")).alias("k"), "n"), F.col("ax")).alias("t"))
    m = mine.filter(F.col("dist_miss_yds").isNotNull() & (d > 0)).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("hn"), F.count(F.when(F.col("dist_miss_yds") <= -h["over_pct"] * d, 1)).alias("hs"), F.count(F.when(F.col("dist_miss_yds") >= h["over_pct"] * d, 1)).alias("hl"))
    enough = lambda k: (F.col("hn") >= h["hist_min_n"]) & (F.col(k) / F.col("hn") >= h["hist_share"] - 1e-9)
    j = m.join(hot, keys, "left")
    kind = F.when(F.col("t").isNotNull(), "today").when(enough("hs") | enough("hl"), "history")
    return j.withColumn("kind", kind).filter("kind IS NOT NULL").select(
        *keys, "kind", F.when(F.col("kind") == "today", F.col("t.dir")).when(enough("hs"), "short").otherwise("long").alias("dir"),
        F.when(F.col("kind") == "today", F.col("t.k")).alias("k"), F.when(F.col("kind") == "today", F.col("t.n")).otherwise(F.col("hn")).alias("n"),
        F.when(F.col("kind") == "history", r1(r1(F.when(enough("hs"), F.col("hs")).otherwise(F.col("hl")) / F.col("hn") * 10) / 10)).alias("share"))
