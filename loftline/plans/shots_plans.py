"""Registered queries for single-shot operators (O-04, O-20 .. O-51)."""

from __future__ import annotations

from pyspark.sql import functions as F

from loftline.functions.numbers import half_up, r1
from loftline.operators import shots as S
from loftline.plans.registry import HU, query

# oracle fragments
LEN = "sqrt((tx-sx)*(tx-sx)+(ty-sy)*(ty-sy))"
BAND = lambda v: (f"CASE WHEN {v} IS NULL THEN NULL WHEN abs({v})<8 THEN 0 WHEN abs({v})<=20 THEN CAST(sign({v}) AS INT) "  # noqa: E731
                  f"ELSE CAST(2*sign({v}) AS INT) END")
N0 = lambda e: f"CAST(CAST(floor({e}+0.5) AS BIGINT) AS VARCHAR)"
ONE = lambda e: f"(CASE WHEN {HU(e, 1)}=floor({HU(e, 1)}) THEN CAST(CAST({HU(e, 1)} AS BIGINT) AS VARCHAR) ELSE printf('%.1f', {HU(e, 1)}) END)"

CLOSED = f"""closed AS (SELECT *, {HU('(ex-sx)*(tx-sx)/L+(ey-sy)*(ty-sy)/L - L', 1)} AS distance_miss_yds,
   {HU('(ex-sx)*(ty-sy)/L-(ey-sy)*(tx-sx)/L', 1)} AS lateral_miss_yds, {HU('L', 1)} AS intended,
   {HU('(ex-sx)*(tx-sx)/L+(ey-sy)*(ty-sy)/L', 1)} AS actual FROM (SELECT *, {LEN} AS L FROM shots_v))"""


@query("closeout", f"""WITH {CLOSED}
SELECT shot_id, distance_miss_yds, lateral_miss_yds, intended, actual,
  abs(distance_miss_yds)<=L*0.05 AND abs(lateral_miss_yds)<=L*tan(radians(1.5)) AS on_target,
  {BAND('lateral_miss_yds')} AS curve_auto, {BAND('distance_miss_yds')} AS dist_class,
  coalesce(start_acc_m>12,false) OR coalesce(end_acc_m>12,false) AS low_acc FROM closed""", ("shots_v",))
def closeout(d):
    return S.close_out(d.shots).select("shot_id", "distance_miss_yds", "lateral_miss_yds", "intended", "actual",
                                       "on_target", "curve_auto", "dist_class", "low_acc")


@query("miss_bands", f"""SELECT player_id, club, {BAND('dist_miss_yds')} AS dist_band, {BAND('lat_miss_yds')} AS lat_band,
  CAST(count(*) AS BIGINT) AS n FROM shots_v GROUP BY ALL""", ("shots_v",))
def miss_bands(d):
    return (d.shots.groupBy("player_id", "club", S.miss_band("dist_miss_yds").alias("dist_band"),
                            S.miss_band("lat_miss_yds").alias("lat_band")).agg(F.count(F.lit(1)).alias("n")))


@query("miss_text", f"""SELECT shot_id,
  CASE WHEN abs(dy)<8 AND abs(dx)<8 THEN 'on target'
   WHEN abs(dx)<8 THEN CAST(CAST(abs(dy) AS BIGINT) AS VARCHAR)||' yds '||CASE WHEN dy>0 THEN 'long' ELSE 'short' END
   WHEN abs(dy)<8 THEN CAST(CAST(abs(dx) AS BIGINT) AS VARCHAR)||' yds '||CASE WHEN dx>0 THEN 'right' ELSE 'left' END
   ELSE CAST(CAST(abs(dy) AS BIGINT) AS VARCHAR)||CASE WHEN dy>0 THEN ' long' ELSE ' short' END||' · '||
        CAST(CAST(abs(dx) AS BIGINT) AS VARCHAR)||CASE WHEN dx>0 THEN ' right' ELSE ' left' END END AS miss,
  CASE WHEN k=0 THEN 'on' WHEN k>0 THEN '+'||k||' long' ELSE '−'||(-k)||' short' END||' · '||
   CASE WHEN floor(abs(lat_miss_yds)+0.5)=0 THEN '0' ELSE {N0('abs(lat_miss_yds)')}||CASE WHEN lat_miss_yds>0 THEN ' R' ELSE ' L' END END AS result,
  CASE WHEN cv=0 THEN NULL
   WHEN shape='draw' THEN CASE cv WHEN -2 THEN 'way over-drew' WHEN -1 THEN 'over-drew' WHEN 2 THEN 'held it, big' ELSE 'held / under-drew' END
   WHEN shape='fade' THEN CASE cv WHEN 2 THEN 'way over-faded' WHEN 1 THEN 'over-faded' WHEN -2 THEN 'held it, big' ELSE 'held / under-faded' END
   ELSE CASE cv WHEN -2 THEN 'well left' WHEN -1 THEN 'left' WHEN 2 THEN 'well right' ELSE 'right' END END AS readback
FROM (SELECT *, floor(dist_miss_yds+0.5) AS dy, floor(lat_miss_yds+0.5) AS dx, {BAND('dist_miss_yds')} AS k, {BAND('lat_miss_yds')} AS cv FROM shots_v)""",
       ("shots_v",))
def miss_text(d):
    band = S.miss_band("dist_miss_yds")
    return d.shots.select("shot_id", S.miss_text("dist_miss_yds", "lat_miss_yds").alias("miss"),
                          S.result_text("dist_miss_yds", "lat_miss_yds", band).alias("result"),
                          S.curve_readback(S.miss_band("lat_miss_yds"), "shape").alias("readback"))


@query("route_shot", """SELECT shot_id, CASE WHEN end_lie='green' THEN 'putt' WHEN to_pin_yds>=75 THEN 'long' ELSE 'shortGame' END AS card,
  CASE WHEN to_pin_yds>100 OR coalesce(end_lie,'')='green' THEN NULL WHEN to_pin_yds>=30 THEN 'wedge' WHEN end_lie='sand' THEN 'bunker' ELSE 'chip' END AS kind,
  CASE WHEN club IN ('GW','SW','LW') AND to_pin_yds<=120 THEN 'finesse' ELSE 'full' END AS default_swing,
  CASE WHEN coalesce(end_lie,'')='green' THEN 'putt' WHEN to_pin_yds<=50 THEN 'short' WHEN to_pin_yds>intended_yds-40 THEN 'tee' ELSE 'approach' END AS phase
FROM shots_v""", ("shots_v",))
def route_shot(d):
    on_green = F.coalesce(F.col("end_lie"), F.lit("")) == "green"
    return d.shots.select("shot_id", S.route("to_pin_yds", "end_lie").alias("card"),
                          S.short_kind("to_pin_yds", F.coalesce(F.col("end_lie"), F.lit(""))).alias("kind"),
                          S.default_swing("club", "to_pin_yds").alias("default_swing"),
                          S.phase("to_pin_yds", "intended_yds", on_green).alias("phase"))


@query("line_played", f"""SELECT shot_id, CASE WHEN src<>'set' AND by_club<>'custom' AND by_club<>by_target THEN by_club ELSE by_target END AS line,
  CASE WHEN line_played IN ('own','custom') THEN 'custom' ELSE line_played END AS stored FROM (
 SELECT *, CASE WHEN club=c_safe THEN 'safe' WHEN club=c_aggr THEN 'aggressive' ELSE 'custom' END AS by_club,
  CASE WHEN (club<>c_safe AND club<>c_aggr) OR (ds>tol AND da>tol) THEN 'custom' WHEN da<ds THEN 'aggressive' ELSE 'safe' END AS by_target
 FROM (SELECT *, greatest(15.0, 0.1*{LEN}) AS tol, abs(lat_miss_yds) AS ds, abs(dist_miss_yds) AS da,
   CASE WHEN part_no%2=0 THEN club ELSE 'PW' END AS c_safe, CASE WHEN supp_no%2=0 THEN club ELSE 'Dr' END AS c_aggr,
   CASE WHEN part_no%5=0 THEN 'set' ELSE 'default' END AS src FROM shots_v))""", ("shots_v",))
def line_played(d):
    s = d.shots
    reach = F.hypot(F.col("tx") - F.col("sx"), F.col("ty") - F.col("sy"))
    return s.select("shot_id", S.line_played(
        reach, F.abs("lat_miss_yds"), F.abs("dist_miss_yds"), "club",
        F.when(F.col("part_no") % 2 == 0, F.col("club")).otherwise("PW"),
        F.when(F.col("supp_no") % 2 == 0, F.col("club")).otherwise("Dr"),
        F.when(F.col("part_no") % 5 == 0, "set").otherwise("default")).alias("line"),
        S.norm_line("line_played").alias("stored"))


PATTERN = ("(CASE WHEN aim_offset_yds IS NULL THEN lat_miss_yds ELSE "
           + HU(f"lat_miss_yds - (CASE WHEN start_line_deg IS NOT NULL AND abs(turn)<90 THEN {LEN}*tan(radians(turn))+coalesce(curve_yds,0) "
                "ELSE aim_offset_yds END) - wind_yds", 1) + " END)")
TURNED = ("(SELECT *, u-360*floor(u/360)-180 AS turn FROM (SELECT *, start_line_deg-degrees(atan2(tx-sx,ty-sy))+540 AS u FROM shots_v))")


@query("pattern_lateral", f"SELECT shot_id, {PATTERN} AS pattern_yds FROM {TURNED}", ("shots_v",))
def pattern_lateral(d):
    return d.shots.select("shot_id", S.pattern_lat().alias("pattern_yds"))


ELIG = ("coalesce(teach,true) AND logged<>'skipped' AND shot_type IN ('full','finesse') AND NOT coalesce(end_assumed,false)")


@query("eligible_shots", f"""WITH base AS (SELECT * FROM shots_v WHERE {ELIG}),
 t AS (SELECT player_id, club, swing, lie, avg(intended_yds)*0.85 AS total_yds FROM shots_v GROUP BY ALL)
SELECT player_id, club, CAST(count(*) AS BIGINT) AS n, CAST(sum(shot_id%1000) AS BIGINT) AS id_mix
FROM base JOIN t USING (player_id, club, swing, lie)
WHERE intended_yds+dist_miss_yds <= total_yds*1.3+20 AND intended_yds+dist_miss_yds >= total_yds/3 GROUP BY player_id, club""", ("shots_v",))
def eligible_shots(d):
    totals = d.shots.groupBy("player_id", "club", "swing", "lie").agg((F.avg("intended_yds") * 0.85).alias("total_yds"))
    return S.eligible(d.shots, totals).groupBy("player_id", "club").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("shot_id") % 1000).alias("id_mix"))


@query("miss_cause_sample", "SELECT club, CAST(count(*) AS BIGINT) AS n FROM shots_v WHERE logged<>'skipped' GROUP BY club", ("shots_v",))
def miss_cause_sample(d):
    return S.miss_cause_sample(d.shots).groupBy("club").agg(F.count(F.lit(1)).alias("n"))


NAMES = ("CASE p_partkey%10 WHEN 0 THEN 'Dr' WHEN 1 THEN (p_size%9+1)||'i' WHEN 2 THEN (p_size%5+2)||'hy' WHEN 3 THEN 'pw' "
         "WHEN 4 THEN (p_size+44)||'°' WHEN 5 THEN 'AW' WHEN 6 THEN (p_size%4+3)||'-wood' WHEN 7 THEN 'GW' WHEN 8 THEN 'Driver' ELSE p_name END")


@query("club_family", f"""SELECT p_partkey, club, coalesce(CASE WHEN club IN ('Dr','2Hy','4Hy','2i') THEN 'long' WHEN club IN ('5i','6i','7i') THEN 'mid'
  WHEN club IN ('8i','9i','PW') THEN 'short' WHEN club IN ('GW','SW','LW') THEN 'wedge' END,
  CASE WHEN regexp_matches(club,'^(?i)(dr|d|driver|[0-9]+w|[0-9]+hy?|[0-9]+-?wood|[0-9]+-?hybrid)$') THEN 'long'
   WHEN regexp_matches(club,'^(?i)[0-9]+i$') THEN CASE WHEN CAST(regexp_extract(club,'[0-9]+') AS INT)<=4 THEN 'long' WHEN CAST(regexp_extract(club,'[0-9]+') AS INT)<=7 THEN 'mid' ELSE 'short' END
   WHEN lower(club)='pw' THEN 'short' WHEN lower(club) IN ('gw','aw','sw','lw','uw') OR regexp_matches(club,'^(4[89]|5[0-9]|6[0-9])°?$') THEN 'wedge' END) AS family
FROM (SELECT p_partkey, {NAMES} AS club FROM part)""")
def club_family(d):
    t = d.part.selectExpr("p_partkey", f"{NAMES} AS club")
    return t.select("p_partkey", "club", S.club_family("club").alias("family"))


def _wind_in(shots):
    brg = F.degrees(F.atan2(F.col("tx") - F.col("sx"), F.col("ty") - F.col("sy")))
    return shots.withColumn("brg", brg).withColumn("speed", (F.col("supp_no") % 25).cast("double")).withColumn(
        "from_deg", (F.col("part_no") * 7 % 360).cast("double")).withColumn("fam", S.club_family("club"))


FAM = "CASE club WHEN 'Dr' THEN 'long' WHEN '4Hy' THEN 'long' WHEN '6i' THEN 'mid' WHEN '8i' THEN 'short' WHEN 'PW' THEN 'short' ELSE 'wedge' END"


@query("plays_like", f"""WITH w AS (SELECT *, degrees(atan2(tx-sx,ty-sy)) AS brg, CAST(supp_no%25 AS DOUBLE) AS speed, CAST(part_no*7%360 AS DOUBLE) AS from_deg, {FAM} AS fam FROM shots_v),
 v AS (SELECT *, speed*cos(radians(from_deg-brg)) AS head, speed*sin(radians(from_deg-brg)) AS rt,
   CASE fam WHEN 'long' THEN 0.75 WHEN 'mid' THEN 1.0 WHEN 'short' THEN 1.2 ELSE 1.35 END AS loft FROM w),
 a AS (SELECT *, intended_yds*(CASE WHEN head>0 THEN least(0.5, greatest(0,(0.010+0.00005*head)*head*loft)) ELSE -least(0.2, greatest(0,(0.007-0.00005*(-head))*(-head)*loft)) END) AS along,
   -rt*0.009*intended_yds*(CASE WHEN fam='long' THEN 0.8 ELSE 1 END) AS crossy,
   CASE WHEN rt>speed*0.05 THEN 'right' WHEN rt<-speed*0.05 THEN 'left' ELSE '' END AS side FROM v)
SELECT shot_id, {HU('along', 4)} AS along_yds, {HU('crossy', 4)} AS cross_yds,
  {HU("intended_yds + CAST(part_no%11-5 AS DOUBLE) + along + intended_yds*0.0085*(85-CAST(40+supp_no%60 AS DOUBLE))/10 - intended_yds*0.0116*(CAST(part_no%50*40 AS DOUBLE)-1000)/1000 + CASE WHEN part_no%3=0 AND intended_yds>100 THEN intended_yds*(100.0::DOUBLE/94.0-1) ELSE 0 END", 4)} AS plays_yds,
  CASE WHEN abs(head)<speed*0.38 THEN 'cross-from-'||CASE WHEN side='' THEN 'right' ELSE side END WHEN head>0 THEN CASE WHEN side='' THEN 'into' ELSE 'into-'||side END ELSE CASE WHEN side='' THEN 'down' ELSE 'down-'||side END END AS words
FROM a""", ("shots_v",))
def plays_like(d):
    w = _wind_in(d.shots)
    along, cross = S.wind_effect("speed", "from_deg", "brg", "intended_yds", "fam")
    w = w.withColumn("along", along)
    return w.select("shot_id", half_up("along", 4).alias("along_yds"), half_up(cross, 4).alias("cross_yds"),
                    half_up(S.plays_like("intended_yds", "along", (F.col("part_no") % 11 - 5).cast("double"),
                                         (40 + F.col("supp_no") % 60).cast("double"), (F.col("part_no") % 50 * 40).cast("double"),
                                         F.when(F.col("part_no") % 3 == 0, F.lit(-6.0))), 4).alias("plays_yds"),
                    S.wind_words("speed", "from_deg", "brg").alias("words"))


@query("wind_frame", """SELECT event_id, CAST(((event_id*13%360 - event_id*29%360)+360)%360 AS DOUBLE) AS hole_deg,
  CAST((event_id*29%360 + CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 180 WHEN 'error' THEN 270 ELSE 90 END)%360 AS DOUBLE) AS chip_deg FROM events""")
def wind_frame(d):
    brg = (F.col("event_id") * 29 % 360).cast("double")
    chip = F.when(F.col("event_type") == "click", "Into").when(F.col("event_type") == "view", "helping").when(
        F.col("event_type") == "error", "from left").otherwise("Right")
    return d.events.select("event_id", S.hole_wind((F.col("event_id") * 13 % 360).cast("double"), brg).alias("hole_deg"),
                           S.chip_wind(chip, brg).alias("chip_deg"))


@query("roll_and_curve", f"""SELECT shot_id,
  CASE WHEN lie='tee' AND fam='long' THEN 0.0::DOUBLE WHEN swing='full' THEN CASE club WHEN '4Hy' THEN 12 WHEN '6i' THEN 9 WHEN '8i' THEN 6 WHEN 'PW' THEN 1 WHEN 'SW' THEN 0 ELSE 12 END
   ELSE CASE fam WHEN 'long' THEN 3 WHEN 'mid' THEN 3 WHEN 'short' THEN 1 ELSE 0 END END::DOUBLE AS roll,
  CASE WHEN lie='rough' THEN CASE fam WHEN 'wedge' THEN 0.02 WHEN 'short' THEN 0.02 WHEN 'mid' THEN -0.04 ELSE -0.08 END ELSE 0 END::DOUBLE AS adj,
  CASE WHEN part_no%3=0 THEN CASE fam WHEN 'long' THEN 0.35 WHEN 'mid' THEN 0.5 WHEN 'short' THEN 0.6 ELSE 1.4 END WHEN part_no%3=1 THEN CASE fam WHEN 'long' THEN 1.4 WHEN 'mid' THEN 1.3 WHEN 'short' THEN 1.2 ELSE 1.1 END ELSE 1 END::DOUBLE AS cond,
  (CASE shape WHEN 'fade' THEN 1 WHEN 'draw' THEN -1 ELSE 0 END * CASE club WHEN 'Dr' THEN 15 WHEN '4Hy' THEN 10 WHEN '6i' THEN 7 WHEN '8i' THEN 7 WHEN 'PW' THEN 5 ELSE 5 END)::DOUBLE AS curve
FROM (SELECT *, {FAM} AS fam FROM shots_v)""", ("shots_v",))
def roll_and_curve(d):
    s = d.shots.withColumn("fam", S.club_family("club"))
    cond = F.when(F.col("part_no") % 3 == 0, "wet").when(F.col("part_no") % 3 == 1, "firm").otherwise("normal")
    return s.select("shot_id", S.roll_yds("club", "swing", "fam", "lie").alias("roll"), S.lie_adj("lie", "fam").alias("adj"),
                    S.roll_cond(cond, "fam").alias("cond"), S.curve_for("club", "shape").alias("curve"))


@query("normalise_shots", """SELECT shot_id, coalesce(shape,'straight') AS shape_n, CASE shape WHEN 'draw' THEN -1 WHEN 'fade' THEN 1 ELSE 0 END AS curve_n,
  coalesce(contact,0) AS contact_n, CASE WHEN line_played IN ('own','custom') THEN 'custom' ELSE line_played END AS line_n,
  CASE WHEN to_pin_yds<30 THEN 'chip' END AS short_kind,
  CASE WHEN to_pin_yds<30 THEN 'shortGame' WHEN club='SW' AND to_pin_yds<=120 THEN 'finesse' ELSE 'full' END AS shot_type_n, reviewed AS reviewed_n,
  CASE WHEN NOT made THEN CAST(greatest(-2,least(2,floor(dist_miss_yds/8+0.5))) AS INT) END AS speed_axis, CAST(putt_ft AS DOUBLE) AS putt_ft_n FROM shots_v""", ("shots_v",))
def normalise_shots(d):
    return S.normalise(d.shots).select(
        "shot_id", "shape_n", "curve_n", "contact_n", "line_n", "short_kind", "shot_type_n", "reviewed_n", "speed_axis", "putt_ft_n")


@query("situation_flags", """SELECT shot_id, shot_no=1 AND intended_yds%4<>0 AND lie='tee' AS tee_shot,
  (lie='rough' AND part_no%4 IN (0,1)) OR (coalesce(end_lie,'')='sand' AND to_pin_yds>40) AS recovery, coalesce(end_lie,'')='sand' AND to_pin_yds>40 AS fairway_bunker,
  CASE WHEN putt_ft < to_pin_yds/10 + 5 THEN 'front' WHEN putt_ft > to_pin_yds/10+15-5 THEN 'back' ELSE 'middle' END AS pin_third FROM shots_v""", ("shots_v",))
def situation_flags(d):
    lie = F.when(F.coalesce(F.col("end_lie"), F.lit("")) == "sand", "sand").otherwise(F.col("lie"))
    par = F.when(F.col("intended_yds") % 4 == 0, 3).otherwise(4)
    q = F.when((F.col("part_no") % 4 == 0), "bad").when(F.col("part_no") % 4 == 1, "buried").otherwise("standard")
    tee = S.situation("shot_no", par, "lie", q, "to_pin_yds")
    sand = S.situation("shot_no", par, lie, q, "to_pin_yds")
    front = F.col("to_pin_yds") / 10
    return d.shots.select("shot_id", tee["tee_shot"].alias("tee_shot"), (tee["recovery"] | sand["fairway_bunker"]).alias("recovery"),
                          sand["fairway_bunker"].alias("fairway_bunker"), S.pin_third(front, front + 15, "putt_ft").alias("pin_third"))


@query("aim_point", f"""SELECT shot_id, off AS aim_offset, {HU(f'tx+(ty-sy)/{LEN}*(off-coalesce(curve_yds,0))', 4)} AS aim_x,
  {HU(f'ty-(tx-sx)/{LEN}*(off-coalesce(curve_yds,0))', 4)} AS aim_y
FROM (SELECT *, CASE WHEN abs(lat_miss_yds/4+wind_yds)>=2 THEN -(lat_miss_yds/4+wind_yds) ELSE 0 END AS off FROM shots_v)""", ("shots_v",))
def aim_point(d):
    s = d.shots.withColumn("off", S.aim_offset(F.col("lat_miss_yds") / 4, "wind_yds"))
    x, y = S.aim_point("sx", "sy", "tx", "ty", "off", "curve_yds")
    return s.select("shot_id", F.col("off").alias("aim_offset"), half_up(x, 4).alias("aim_x"), half_up(y, 4).alias("aim_y"))


@query("ellipse_share", f"""SELECT player_id, club, {HU('avg(CASE WHEN u*u+v*v<=1+1e-12 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)', 6)} AS inside_share,
  {HU('avg(CASE WHEN u*u+v*v<=0.5*0.5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)', 6)} AS inner_share, CAST(count(*) AS BIGINT) AS n,
  {HU('max(sqrt(pow(w/2*cos(a),2)+pow(h/2*sin(a),2)))', 6)} AS half_w, {HU('max(sqrt(pow(w/2*sin(a),2)+pow(h/2*cos(a),2)))', 6)} AS half_h
FROM (SELECT *, (lat_miss_yds*cos(a)-dist_miss_yds*sin(a))/(w/2) AS u, (-lat_miss_yds*sin(a)-dist_miss_yds*cos(a))/(h/2) AS v
 FROM (SELECT *, 40.0::DOUBLE AS w, 30.0::DOUBLE AS h, radians(CAST(player_id%180 AS DOUBLE)) AS a FROM shots_v)) GROUP BY player_id, club""", ("shots_v",))
def ellipse_share(d):
    tilt = (F.col("player_id") % 180).cast("double")
    args = ("lat_miss_yds", -F.col("dist_miss_yds"), F.lit(0.0), F.lit(0.0))
    inside, inner = S.in_ellipse(*args, F.lit(40.0), F.lit(30.0), tilt), S.in_ellipse(*args, F.lit(20.0), F.lit(15.0), tilt)
    hw, hh = S.ellipse_box(F.lit(40.0), F.lit(30.0), tilt)
    share = lambda cond: half_up(F.avg(F.when(cond, 1.0).otherwise(0.0)), 6)
    return d.shots.groupBy("player_id", "club").agg(share(inside).alias("inside_share"), share(inner).alias("inner_share"),
                                                    F.count(F.lit(1)).alias("n"), half_up(F.max(hw), 6).alias("half_w"), half_up(F.max(hh), 6).alias("half_h"))


@query("reason_lines", f"""WITH e AS (SELECT player_id, club, {FAM} AS fam, {HU('stddev_samp(lat_miss_yds)', 4)} AS sd, CAST(sum(CASE WHEN end_lie IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS pen, CAST(count(*) AS BIGINT) AS n,
   CASE WHEN player_id%3=0 THEN avg(CASE WHEN end_lie='green' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) END AS gir, median(putt_ft) AS prox,
   CASE WHEN player_id%3<2 THEN avg(CASE WHEN dist_miss_yds<0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) END AS sh, median(intended_yds) AS tot FROM shots_v GROUP BY player_id, club)
SELECT player_id, club, coalesce(
  CASE WHEN fam='long' THEN club||': '||{ONE('sd')}||'° spread, '||pen||' penalties in last '||n END,
  club||': '||{N0('gir*100')}||'% GIR, '||{ONE('prox')}||' ft median from fairway (n '||n||')',
  club||': '||{ONE('sd')}||'° spread, '||{N0('sh*100')}||'% short (n '||n||')',
  club||': '||{ONE('sd')}||'° spread, '||{ONE('tot')}||' median', club||': '||{ONE('tot')}||' median', club) AS reason FROM e""", ("shots_v",))
def reason_lines(d):
    e = d.shots.groupBy("player_id", "club").agg(
        half_up(F.stddev_samp("lat_miss_yds"), 4).alias("sd"), F.count(F.when(F.col("end_lie").isNull(), 1)).alias("pen"),
        F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("end_lie") == "green", 1.0).otherwise(0.0)).alias("gir"),
        F.percentile("putt_ft", 0.5).alias("prox"), F.avg(F.when(F.col("dist_miss_yds") < 0, 1.0).otherwise(0.0)).alias("sh"),
        F.percentile("intended_yds", 0.5).alias("tot"))
    e = (e.withColumn("gir", F.when(F.col("player_id") % 3 == 0, F.col("gir")))
         .withColumn("sh", F.when(F.col("player_id") % 3 < 2, F.col("sh"))))
    return e.select("player_id", "club", S.reason_line("club", "sd", "pen", "n", "gir", "prox", F.lit("fairway"), "sh", "tot",
                                                       S.club_family("club")).alias("reason"))


@query("odds_and_words", f"""SELECT shot_id, CASE WHEN p<=0 THEN NULL WHEN p<=0.5 THEN '1 in '||{N0('1.0::DOUBLE/p')} ELSE {N0('p*10')}||' in 10' END AS odds,
  CASE WHEN abs(dist_miss_yds)<1 THEN 'level' ELSE {N0('abs(dist_miss_yds)')}||' yds '||CASE WHEN dist_miss_yds>0 THEN 'up' ELSE 'down' END END AS rise,
  CASE lie WHEN 'tee' THEN 'From here' WHEN 'fairway' THEN 'Fairway' ELSE 'Rough' END||', '||{N0('to_pin_yds')}||' yds: '||'up and down '||{N0('p*100')}||'%'||CASE WHEN seq<10 THEN ' ('||seq||' shots)' ELSE '' END||' · you leave it '||{N0('putt_ft')}||' ft' AS line,
  CASE WHEN exp_score-3>=0 THEN 'Aggression paid +'||printf('%.1f',{HU('exp_score-3', 1)}) ELSE 'Aggression cost −'||printf('%.1f',{HU('3-exp_score', 1)}) END AS paid
FROM (SELECT *, CAST(part_no%21 AS DOUBLE)/20 AS p FROM shots_v)""", ("shots_v",))
def odds_and_words(d):
    s = d.shots.withColumn("p", (F.col("part_no") % 21).cast("double") / 20)
    return s.select("shot_id", S.one_in("p").alias("odds"), S.rise_text("dist_miss_yds").alias("rise"),
                    S.short_game_line("lie", "p", "seq", "putt_ft", "to_pin_yds").alias("line"),
                    S.paid_text(F.lit(3.0) - F.col("exp_score")).alias("paid"))


@query("miss_words", r"""SELECT doc_id, CASE WHEN regexp_matches(lower(text),'\blong\b') THEN 1 WHEN regexp_matches(lower(text),'\bshort\b') THEN -1 END AS dist,
  CASE WHEN regexp_matches(lower(text),'\bright\b') THEN 1 WHEN regexp_matches(lower(text),'\bleft\b') THEN -1 END AS lat FROM documents""")
def miss_words(d):
    dist, lat = S.miss_signs("text")
    return d.documents.select("doc_id", dist.alias("dist"), lat.alias("lat"))
