"""Registered queries for learning operators (A-01 .. A-21, J-04, J-05, J-17, J-18)."""

from __future__ import annotations

from pyspark.sql import functions as F

from loftline.functions.numbers import half_up
from loftline.operators import learning as L
from loftline.operators import resolve as R
from loftline.operators import shots as S
from loftline.operators import stats as W
from loftline.plans.data import add_view
from loftline.plans.registry import HU, query
from loftline.plans.shots_plans import ELIG, FAM, PATTERN
from loftline.settings import table

ORDER = {"Dr": 0, "4Hy": 1, "6i": 2, "8i": 3, "PW": 4, "SW": 5}
POS = "CASE {c} WHEN 'Dr' THEN 0 WHEN '4Hy' THEN 1 WHEN '6i' THEN 2 WHEN '8i' THEN 3 WHEN 'PW' THEN 4 ELSE 5 END"
NOW_S = 4240 * 86400

# base entries with deliberate gaps, so the fallback chains are used
add_view("entries_v", """SELECT player_id, club, swing, lie, CAST(count(*) AS BIGINT) AS n, floor(avg(intended_yds)*1000+0.5)/1000 AS total_yds,
  CASE WHEN (player_id+length(lie))%3=0 THEN NULL ELSE floor(stddev_samp(dist_miss_yds)*10000+0.5)/10000 END AS dist_sd,
  CASE WHEN (player_id+length(club))%3=1 THEN NULL ELSE floor(stddev_samp(lat_miss_yds)*1000+0.5)/10000 END AS lat_sd_deg,
  CASE WHEN player_id%4=0 THEN floor(avg(intended_yds)*900+0.5)/1000 END AS carry_yds, CASE WHEN player_id%4=0 THEN 'measured' END AS carry_source
 FROM shots_v WHERE (player_id + length(club)*3 + length(lie)*5 + length(swing)) % 4 <> 0 GROUP BY player_id, club, swing, lie""", ("shots_v",))

ELP = (f"elig AS (SELECT t.*, total_yds FROM {{src}} t LEFT JOIN entries_v e USING (player_id, club, swing, lie) WHERE {ELIG} AND "
       "(total_yds IS NULL OR (intended_yds+dist_miss_yds <= total_yds*1.3+20 AND intended_yds+dist_miss_yds >= total_yds/3)))")
SRC = "(SELECT *, u-360*floor(u/360)-180 AS turn FROM (SELECT *, start_line_deg-degrees(atan2(tx-sx,ty-sy))+540 AS u FROM shots_v))"
RW = f"""rw AS (SELECT player_id, round_id, rounds_ago, CASE WHEN ({NOW_S}-last_s)/(30.436875*86400) > 12 THEN 0 WHEN rounds_ago<=3 THEN 1.0 WHEN rounds_ago<=8 THEN 0.5 WHEN rounds_ago<=20 THEN 0.2 ELSE 0 END::DOUBLE AS w
  FROM (SELECT player_id, round_id, max(ts_s) AS last_s, row_number() OVER (PARTITION BY player_id ORDER BY max(ts_s) DESC, round_id) AS rounds_ago FROM elig GROUP BY player_id, round_id))"""
WS = f"{ELP.format(src=SRC)}, {RW}, ws AS (SELECT elig.*, w, {PATTERN} AS lm, intended_yds+dist_miss_yds AS act FROM elig JOIN rw USING (player_id, round_id) WHERE w>0)"


def med_cte(name, src, keys, v, w):
    return (f"{name}_a AS (SELECT {keys}, {v} AS v, sum({w}) AS w FROM {src} WHERE {v} IS NOT NULL GROUP BY ALL), "
            f"{name}_c AS (SELECT *, sum(w) OVER (PARTITION BY {keys} ORDER BY v) AS cum, sum(w) OVER (PARTITION BY {keys}) AS tot FROM {name}_a), "
            f"{name} AS (SELECT {keys}, coalesce((max(CASE WHEN abs(cum-tot/2)<1e-9 THEN v END)+min(CASE WHEN cum>tot/2+1e-9 THEN v END))/2, min(CASE WHEN cum>tot/2+1e-9 THEN v END), max(v)) AS med FROM {name}_c GROUP BY {keys})")


def ws(d):
    return L.weighted_shots(d.shots, d.view("entries_v").select(*L.ENTRY, "total_yds"), now_s=NOW_S)


@query("recency_weights", f"WITH {ELP.format(src=SRC)}, {RW} SELECT player_id, round_id, CAST(rounds_ago AS INT) AS rounds_ago, w FROM rw WHERE w>0", ("entries_v", "shots_v"))
def recency_weights(d):
    el = S.eligible(d.shots, d.view("entries_v").select(*L.ENTRY, "total_yds"))
    return L.recency_weights(el, now_s=NOW_S)


K3 = "player_id, club, swing"


@query("weighted_median", f"WITH {WS}, {med_cte('m', 'ws', K3, 'act', 'w')} SELECT {K3}, med AS median_yds FROM m", ("entries_v", "shots_v"))
def weighted_median(d):
    return W.weighted_median(ws(d).withColumn("act", S.actual_yds()), ["player_id", "club", "swing"], "act", F.col("w"), "median_yds")


@query("weighted_quantile", f"""WITH {WS}, {med_cte('m', 'ws', K3, 'lat_miss_yds', 'w')} SELECT {K3}, min(CASE WHEN cum>=0.25*tot-1e-9 THEN v END) AS q25, min(CASE WHEN cum>=0.75*tot-1e-9 THEN v END) AS q75 FROM m_c GROUP BY ALL""", ("entries_v", "shots_v"))
def weighted_quantile(d):
    return W.weighted_quantiles(ws(d), ["player_id", "club", "swing"], "lat_miss_yds", {"q25": 0.25, "q75": 0.75}, F.col("w"))


VAR = lambda x, w="w": f"(greatest(0, sum({w}*{x}*{x})-sum({w}*{x})*sum({w}*{x})/sum({w}))/CASE WHEN sum({w})-sum({w}*{w})/sum({w})>1e-12 THEN sum({w})-sum({w}*{w})/sum({w}) END)"
COV = "((sum(w*lm*-dist_miss_yds)-sum(w*lm)*sum(w*-dist_miss_yds)/sum(w))/CASE WHEN sum(w)-sum(w*w)/sum(w)>1e-12 THEN sum(w)-sum(w*w)/sum(w) END)"


@query("weighted_var", f"WITH {WS} SELECT {K3}, {HU('sum(w*lm)/sum(w)+1e-9', 6)} AS mean_lat, {HU(VAR('lm')+'+1e-9', 6)} AS var_lat, {HU(VAR('dist_miss_yds')+'+1e-9', 6)} AS var_dist, {HU(COV+'+1e-9', 6)} AS cov FROM ws GROUP BY {K3}", ("entries_v", "shots_v"))
def weighted_var(d):
    x = ws(d).withColumn("lm", S.pattern_lat()).withColumn("ny", -F.col("dist_miss_yds"))
    g = x.groupBy("player_id", "club", "swing").agg(*W.moments("lm", "ny", "w"))
    return g.select("player_id", "club", "swing", half_up(W.w_mean() + 1e-9, 6).alias("mean_lat"), half_up(W.w_var() + 1e-9, 6).alias("var_lat"),
                    half_up(W.w_var("_YY", "_Y") + 1e-9, 6).alias("var_dist"), half_up(W.w_cov() + 1e-9, 6).alias("cov"))


ELLK = "2*sqrt(-2*ln(0.2))"


@query("ell80", f"""WITH {WS}, c AS (SELECT player_id, club, {VAR('lm')} AS sxx, {VAR('dist_miss_yds')} AS syy, {COV} AS sxy FROM ws GROUP BY player_id, club),
 e AS (SELECT *, (sxx+syy)/2 AS half, sqrt(pow((sxx-syy)/2,2)+sxy*sxy) AS disc, degrees(atan2(2*sxy, sxx-syy))/2 AS th FROM c)
SELECT player_id, club, {HU(f'{ELLK}*sqrt(half+disc)', 4)} AS w_yds, {HU(f'{ELLK}*sqrt(greatest(0,half-disc))', 4)} AS h_yds, {HU('th-180*floor(th/180)', 4)} AS tilt_deg FROM e""", ("entries_v", "shots_v"))
def ell80(d):
    x = ws(d).withColumn("lm", S.pattern_lat()).withColumn("ny", -F.col("dist_miss_yds"))
    g = x.groupBy("player_id", "club").agg(F.count(F.lit(1)).alias("n"), *W.moments("lm", "ny", "w"))
    g = g.withColumn("e", W.ell80(W.w_var(), W.w_var("_YY", "_Y"), W.w_cov()))
    return g.select("player_id", "club", *[half_up(F.col(f"e.{f}"), 4).alias(f) for f in ("w_yds", "h_yds", "tilt_deg")])


CHAIN = "CASE WHEN t.lie='tee' THEN CASE e.lie WHEN 'tee' THEN 0 WHEN 'fairway' THEN 1 ELSE 2 END WHEN t.lie='fairway' THEN CASE e.lie WHEN 'fairway' THEN 0 WHEN 'tee' THEN 1 ELSE 2 END ELSE CASE e.lie WHEN 'rough' THEN 0 WHEN 'fairway' THEN 1 ELSE 2 END END"
CAND = f"""cand AS (SELECT t.player_id, t.club, t.swing, t.lie, e.club AS c2, e.lie AS l2, e.total_yds, e.dist_sd, e.lat_sd_deg,
  CASE WHEN e.club=t.club AND e.lie=t.lie THEN 0 WHEN e.club=t.club THEN 10+{CHAIN} WHEN e.lie=t.lie THEN 100+2*abs({POS.format(c='e.club')}-{POS.format(c='t.club')})+CASE WHEN {POS.format(c='e.club')}>{POS.format(c='t.club')} THEN 1 ELSE 0 END END AS rk
 FROM tg t JOIN entries_v e ON e.player_id=t.player_id AND e.swing=t.swing)"""
BEST = lambda f, a: f"arg_min({a}, rk) FILTER ({f} IS NOT NULL AND rk IS NOT NULL)"


@query("prior_fallback", f"""WITH tg AS (SELECT DISTINCT player_id, club, swing, lie FROM shots_v), {CAND}
SELECT player_id, club, swing, lie, {BEST('total_yds', 'total_yds')} AS total_prior, {BEST('total_yds', 'c2')} AS total_club, {BEST('total_yds', 'l2')} AS total_lie,
 {BEST('dist_sd', 'dist_sd')} AS sd_prior, {BEST('dist_sd', 'c2')} AS sd_club, {BEST('dist_sd', 'l2')} AS sd_lie, {BEST('lat_sd_deg', 'lat_sd_deg')} AS lat_prior FROM cand GROUP BY ALL""", ("entries_v", "shots_v"))
def prior_fallback(d):
    tg = d.shots.select(*L.ENTRY).distinct()
    p = L.priors(tg, d.view("entries_v"), ORDER, ["total_yds", "dist_sd", "lat_sd_deg"])
    return p.select(*L.ENTRY, F.col("p_total_yds.value").alias("total_prior"), F.col("p_total_yds.club").alias("total_club"), F.col("p_total_yds.lie").alias("total_lie"),
                    F.col("p_dist_sd.value").alias("sd_prior"), F.col("p_dist_sd.club").alias("sd_club"), F.col("p_dist_sd.lie").alias("sd_lie"),
                    F.col("p_lat_sd_deg.value").alias("lat_prior"))


ADJ = lambda l: f"CASE WHEN {l}='rough' THEN CASE {FAM} WHEN 'wedge' THEN 0.02 WHEN 'short' THEN 0.02 WHEN 'mid' THEN -0.04 ELSE -0.08 END ELSE 0 END::DOUBLE"
SDM = lambda l: f"CASE WHEN {l}='rough' THEN 1.2 ELSE 1.0 END::DOUBLE"
SHR = lambda own, pr, n: f"CASE WHEN n>=30 THEN coalesce({own},{pr}) WHEN {own} IS NULL THEN {pr} WHEN {pr} IS NULL THEN {own} ELSE ({n}*{own}+5*{pr})/({n}+5) END"
FAMROLL = f"CASE WHEN {FAM}='long' AND lie='tee' THEN 0 WHEN swing='full' THEN CASE {FAM} WHEN 'long' THEN 12 WHEN 'mid' THEN 9 WHEN 'short' THEN 4 ELSE 1 END ELSE CASE {FAM} WHEN 'long' THEN 3 WHEN 'mid' THEN 3 WHEN 'short' THEN 1 ELSE 0 END END"
OVER = f"""{WS}, {med_cte('m', 'ws', 'player_id, club, swing, lie', 'act', 'w')},
 g AS (SELECT player_id, club, swing, lie, count(*) AS n, sum(w) AS W, sum(w*dist_miss_yds)/sum(w) AS bd, sum(w*lm)/sum(w) AS bl, sqrt({VAR('dist_miss_yds')}) AS osd, sqrt({VAR('degrees(atan2(lm,act))')}) AS osl,
   {VAR('lm')} AS sxx, {VAR('dist_miss_yds')} AS syy, {COV} AS sxy FROM ws GROUP BY player_id, club, swing, lie),
 tg AS (SELECT player_id, club, swing, lie FROM g), {CAND},
 pr AS (SELECT player_id, club, swing, lie, {BEST('total_yds', 'total_yds')} AS pt, {BEST('total_yds', 'l2')} AS ptl, min(rk) FILTER (total_yds IS NOT NULL) AS ptr,
   {BEST('dist_sd', 'dist_sd')} AS pd, {BEST('dist_sd', 'l2')} AS pdl, min(rk) FILTER (dist_sd IS NOT NULL) AS pdr, {BEST('lat_sd_deg', 'lat_sd_deg')} AS pl, {BEST('lat_sd_deg', 'l2')} AS pll, min(rk) FILTER (lat_sd_deg IS NOT NULL) AS plr FROM cand GROUP BY ALL),
 x AS (SELECT g.*, m.med, pt*CASE WHEN ptr BETWEEN 10 AND 99 THEN (1+{ADJ('lie')})/(1+{ADJ('ptl')}) ELSE 1 END AS pt2, pd*CASE WHEN pdr BETWEEN 10 AND 99 THEN {SDM('lie')}/{SDM('pdl')} ELSE 1 END AS pd2, pl*CASE WHEN plr BETWEEN 10 AND 99 THEN {SDM('lie')}/{SDM('pll')} ELSE 1 END AS pl2
   FROM g JOIN m USING (player_id, club, swing, lie) LEFT JOIN pr USING (player_id, club, swing, lie)),
 ov AS (SELECT player_id, club, swing, lie, CAST(n AS BIGINT) AS n, W AS n_eff, n>=30 AS takeover, {SHR('med', 'pt2', 'W')} AS total, {SHR('med', 'pt2', 'W')} - {FAMROLL} AS carry, {SHR('osd', 'pd2', 'W')} AS dist_sd, {SHR('osl', 'pl2', 'W')} AS lat_sd_deg,
   {SHR('bd', '0.0', 'W')} AS bias_dist, {SHR('bl', '0.0', 'W')} AS bias_lat, CASE WHEN n>=30 THEN {ELLK}*sqrt((sxx+syy)/2+sqrt(pow((sxx-syy)/2,2)+sxy*sxy)) END AS ell_w FROM x)"""


def over(d):
    return L.overlay(d.shots, d.view("entries_v"), ORDER, now_s=NOW_S)


@query("overlay", f"""WITH {OVER} SELECT player_id, club, swing, lie, n, {HU('n_eff+1e-9', 4)} AS n_eff, takeover, {HU('total+1e-9', 4)} AS total, {HU('carry+1e-9', 4)} AS carry, {HU('dist_sd+1e-9', 4)} AS dist_sd, {HU('lat_sd_deg+1e-9', 4)} AS lat_sd_deg,
  {HU('bias_dist+1e-9', 4)} AS bias_dist, {HU('bias_lat+1e-9', 4)} AS bias_lat, {HU('ell_w+1e-9', 4)} AS ell_w FROM ov""", ("entries_v", "shots_v"))
def overlay(d):
    o = over(d)
    return o.select(*L.ENTRY, "n", half_up(F.col("n_eff") + 1e-9, 4).alias("n_eff"), "takeover", *[half_up(F.col(f) + 1e-9, 4).alias(f) for f in ("total", "carry", "dist_sd", "lat_sd_deg", "bias_dist", "bias_lat")],
                    half_up(F.col("ell80.w_yds") + 1e-9, 4).alias("ell_w"))


@query("overlay_merge", f"""WITH {OVER} SELECT player_id, club, swing, lie, {HU('coalesce(ov.total, total_yds)+1e-9', 4)} AS total,
  {HU("CASE WHEN NOT coalesce(takeover,false) AND carry_source='measured' AND ov.n IS NOT NULL THEN carry_yds ELSE coalesce(ov.carry, carry_yds) END+1e-9", 4)} AS carry,
  CASE WHEN ov.carry IS NOT NULL AND NOT (NOT takeover AND coalesce(carry_source,'')='measured') THEN 'derived' ELSE carry_source END AS carry_source,
  {HU('coalesce(ov.dist_sd, e.dist_sd)+1e-9', 4)} AS dist_sd, {HU('coalesce(ov.lat_sd_deg, e.lat_sd_deg)+1e-9', 4)} AS lat_sd_deg, CASE WHEN takeover THEN ov.n ELSE e.n END AS n, CASE WHEN takeover THEN 'own' WHEN ov.n IS NOT NULL THEN 'blend' END AS source
FROM entries_v e FULL JOIN ov USING (player_id, club, swing, lie)""", ("entries_v", "shots_v"))
def overlay_merge(d):
    m = L.merge_overlay(d.view("entries_v"), over(d))
    return m.select(*L.ENTRY, *[half_up(F.col(f) + 1e-9, 4).alias(f) for f in ("total", "carry", "dist_sd", "lat_sd_deg")], "carry_source", "n", "source")


@query("shrinkage", f"""SELECT player_id, lie, band, {HU('CASE WHEN n>0 THEN (n*sg+5*prior)/(n+5) ELSE prior END', 6)} AS sg FROM (
 SELECT *, sum(n*sg) OVER (PARTITION BY player_id, lie)/sum(n) OVER (PARTITION BY player_id, lie) AS prior FROM (
  SELECT player_id, lie, CAST(floor(to_pin_yds/25) AS INT) AS band, CAST(count(*) AS BIGINT) AS n, avg(exp_score-3) AS sg FROM shots_v GROUP BY ALL))""", ("shots_v",))
def shrinkage(d):
    from loftline.operators.strokes import shrink_rows
    b = d.shots.groupBy("player_id", "lie", F.floor(F.col("to_pin_yds") / 25).cast("int").alias("band")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("exp_score") - 3).alias("sg"))
    return shrink_rows(b, ["player_id", "lie"], "sg").select("player_id", "lie", "band", half_up("sg", 6).alias("sg"))


TEND = """k AS (SELECT player_id, CASE WHEN shot_type='putt' THEN 'Putter' ELSE club END AS club, shot_type, CASE WHEN shot_type='putt' THEN CASE WHEN made THEN 0 ELSE contact END ELSE sign({pat}) END AS la,
  CASE WHEN shot_type='putt' THEN CASE WHEN made THEN 0 ELSE sign(dist_miss_yds) END ELSE sign(dist_miss_yds) END AS di, CASE WHEN shot_type<>'putt' THEN abs({pat})>20 END AS bg
 FROM {src} WHERE coalesce(teach,true) AND logged<>'skipped' AND NOT coalesce(end_assumed,false) AND shot_type IN ('full','finesse','putt'))"""
P100 = lambda c, ax: f"CASE WHEN count({ax})>0 THEN {HU(f'100.0::DOUBLE*count(CASE WHEN {c} THEN 1 END)/count({ax})', 1)} END"
SHARES = f"{P100('la<0', 'la')} AS left_pct, {P100('la>0', 'la')} AS right_pct, {P100('di<0', 'di')} AS short_pct, {P100('di>0', 'di')} AS long_pct"


def tend_in(d):
    return (d.shots.withColumn("putt_line", F.when(F.col("made"), 0).otherwise(F.col("contact"))).withColumn("putt_speed", F.when(F.col("made"), 0.0).otherwise(F.signum("dist_miss_yds")))
            .withColumn("lat_sign", F.lit(None).cast("int")).withColumn("dist_sign", F.lit(None).cast("int")).withColumn("miss_total_yds", F.lit(None).cast("double")))


@query("tendencies", f"""WITH {TEND.format(pat=PATTERN, src=SRC)} SELECT player_id, club, CAST(count(*) AS BIGINT) AS n, CAST(count(la) AS BIGINT) AS n_lat, CAST(count(di) AS BIGINT) AS n_dist, CAST(count(bg) AS BIGINT) AS n_big, {SHARES}, {P100('bg', 'bg')} AS big_pct
FROM k WHERE la IS NOT NULL OR di IS NOT NULL OR bg IS NOT NULL GROUP BY player_id, club""", ("shots_v",))
def tendencies(d):
    return L.tendencies(tend_in(d), ["player_id", "club"])


SUMM = f"""{TEND.format(pat=PATTERN, src=SRC)}, t AS (SELECT player_id, club, shot_type AS swing, count(*) AS tn, {SHARES} FROM k WHERE shot_type<>'putt' GROUP BY ALL),
 y AS (SELECT player_id, club, shot_type AS swing, count(*) AS ny, {HU('avg(dist_miss_yds)', 1)} AS long_yds, {HU('avg(lat_miss_yds)', 1)} AS right_yds, {HU(f'avg({PATTERN})', 1)} AS line_yds,
   {HU('median(sqrt(dist_miss_yds*dist_miss_yds+lat_miss_yds*lat_miss_yds))', 1)} AS off_yds FROM {SRC} WHERE {ELIG} GROUP BY ALL),
 s AS (SELECT player_id, club, swing, CAST(greatest(coalesce(tn,0),coalesce(ny,0)) AS BIGINT) AS n, CAST(coalesce(ny,0) AS BIGINT) AS n_yds, long_yds, right_yds, off_yds, line_yds, left_pct, right_pct, short_pct, long_pct FROM t FULL JOIN y USING (player_id, club, swing))"""


@query("miss_summary", f"WITH {SUMM} SELECT * FROM s", ("shots_v",))
def miss_summary(d):
    return L.miss_summary(tend_in(d))


_N = lambda e: f"CAST(CAST(floor({e}+0.5) AS BIGINT) AS VARCHAR)"
_SIDE = lambda v, a, b: f"CASE WHEN abs({v})>=0.5 THEN {_N(f'abs({v})')}||' '||CASE WHEN {v}<0 THEN '{a}' ELSE '{b}' END END"
_SH = lambda a, b, x, y: f"CASE WHEN {a} IS NULL OR {b} IS NULL OR ({a}=0 AND {b}=0) THEN NULL WHEN {a}>={b} THEN '{x} '||{_N(f'{a}/10')}||' in 10' ELSE '{y} '||{_N(f'{b}/10')}||' in 10' END"


@query("miss_word_rows", f"""WITH {SUMM} SELECT player_id, club, swing, CASE WHEN n_yds>0 THEN coalesce(nullif(concat_ws(' · ', {_SIDE('long_yds', 'short', 'long')}, {_SIDE('right_yds', 'L', 'R')}),''),'on line')||' · off by '||{_N('off_yds')} END AS target_words,
  CASE WHEN line_yds IS NOT NULL THEN coalesce({_SIDE('line_yds', 'L', 'R')},'straight') END AS line_words, nullif(concat_ws(' · ', {_SH('left_pct', 'right_pct', 'L', 'R')}, {_SH('short_pct', 'long_pct', 'short', 'long')}),'') AS share_words FROM s""", ("shots_v",))
def miss_word_rows(d):
    return L.miss_words(L.miss_summary(tend_in(d)))


AGG = """a AS (SELECT s.player_id, s.round_id, CASE WHEN line_played IN ('own','custom') THEN 'custom' ELSE line_played END AS line, h.score-(shot_no-1)-exp_score AS d
 FROM shots_v s LEFT JOIN hole_scores_v h ON h.round_id=s.round_id AND h.hole=s.hole AND h.player_id=s.player_id WHERE coalesce(teach,true) AND shot_type IN ('full','finesse'))"""


@query("aggression_scorecard", f"""WITH {AGG} SELECT player_id, round_id, line, CAST(count(*) AS BIGINT) AS n, CAST(count(d) AS BIGINT) AS scored, {HU('coalesce(sum(d),0)', 3)} AS delta FROM a GROUP BY GROUPING SETS ((player_id, round_id, line),(player_id, line))""", ("shots_v", "hole_scores_v"))
def aggression_scorecard(d):
    return L.aggression(d.shots, d.holes.select("player_id", "round_id", F.col("hole"), "score"))


@query("tee_shot_grade", """SELECT player_id, CAST(count(*) FILTER (line_played='safe') AS BIGINT) AS safe, CAST(count(*) FILTER (line_played='aggressive') AS BIGINT) AS aggressive, CAST(count(*) FILTER (line_played IN ('own','custom')) AS BIGINT) AS custom, CAST(count(*) AS BIGINT) AS total
FROM shots_v WHERE coalesce(teach,true) AND shot_no=1 AND logged<>'skipped' AND shot_type<>'putt' GROUP BY player_id""", ("shots_v",))
def tee_shot_grade(d):
    return L.tee_grades(d.shots)


@query("usual_shape", """SELECT player_id, club, CASE WHEN s>=d AND s>=f THEN 'straight' WHEN d>=f THEN 'draw' ELSE 'fade' END AS shape, CAST(greatest(s,d,f) AS BIGINT) AS n
FROM (SELECT player_id, club, count(*) FILTER (shape='straight') AS s, count(*) FILTER (shape='draw') AS d, count(*) FILTER (shape='fade') AS f FROM shots_v WHERE coalesce(teach,true) GROUP BY ALL)""", ("shots_v",))
def usual_shape(d):
    return L.usual_shape(d.shots)


@query("club_gaps", f"""WITH e AS (SELECT player_id, club, {FAM} AS fam, arg_min(total_yds-{FAMROLL}, CASE lie WHEN 'fairway' THEN 0 WHEN 'tee' THEN 1 ELSE 2 END) AS carry FROM entries_v WHERE swing='full' GROUP BY player_id, club),
 g AS (SELECT *, carry-lead(carry) OVER w AS gap, lead(fam) OVER w AS fam2 FROM e WINDOW w AS (PARTITION BY player_id ORDER BY carry DESC, club)),
 t AS (SELECT player_id, fam, gap, fam=fam2 AS same FROM g WHERE gap>0 UNION ALL SELECT player_id, fam2, gap, false FROM g WHERE gap>0 AND fam<>fam2)
SELECT p.player_id, f.fam, {HU("coalesce(avg(CASE WHEN same THEN gap END), avg(gap), 10)", 6)} AS gap_yds FROM (SELECT DISTINCT player_id FROM entries_v) p CROSS JOIN (VALUES ('long'),('mid'),('short'),('wedge')) f(fam) LEFT JOIN t ON t.player_id=p.player_id AND t.fam=f.fam GROUP BY p.player_id, f.fam""", ("entries_v", "shots_v"))
def club_gaps(d):
    return L.club_gaps(d.view("entries_v")).withColumn("gap_yds", half_up("gap_yds", 6))


CHIP = """live AS (SELECT * FROM shots_v WHERE coalesce(teach,true) AND logged<>'skipped'), f AS (SELECT player_id, round_id, hole, count(*) FILTER (shot_type<>'putt') AS ns, count(*) FILTER (shot_type='putt') AS np, arg_min(made, shot_no) FILTER (shot_type='putt') AS m1, arg_min(putt_ft, shot_no) FILTER (shot_type='putt') AS ft1, min(shot_no) FILTER (shot_type='putt') AS p1,
   list(shot_no) FILTER (shot_type<>'putt') AS nos FROM live GROUP BY ALL),
 ch AS (SELECT c.*, CASE WHEN h.score<>ns+np AND c.round_id%3<>0 THEN NULL WHEN c.part_no%7=0 THEN CASE WHEN np=0 THEN true END WHEN list_contains(nos, shot_no+1) THEN false WHEN list_max(nos)>shot_no THEN NULL WHEN p1=1 THEN m1 END AS up_down, ft1, nos FROM live c JOIN f USING (player_id, round_id, hole) LEFT JOIN hole_scores_v h USING (player_id, round_id, hole) WHERE shot_type='shortGame'),
 co AS (SELECT *, CASE WHEN up_down IS NULL THEN NULL WHEN part_no%7=0 THEN 0.0 WHEN list_contains(nos, shot_no+1) THEN NULL ELSE ft1 END::DOUBLE AS leave_ft FROM ch)"""


def chip_in(d):
    sc = d.holes.filter("round_id % 3 <> 0").select("player_id", "round_id", "hole", "score")
    return d.shots.withColumn("holed", F.col("part_no") % 7 == 0), sc


@query("chip_outcome", f"WITH {CHIP} SELECT shot_id, up_down, leave_ft FROM co", ("shots_v", "hole_scores_v"))
def chip_outcome(d):
    return L.chip_outcomes(*chip_in(d)).select("shot_id", "up_down", "leave_ft")


BANDS = [(l, a, b, 0.2 + 0.05 * i + 0.02 * len(l), 6.0 + 3 * i) for l in ("fairway", "rough", "bunker") for i, (a, b) in enumerate(((0.0, 30.0), (30.0, 60.0), (60.0, 100.0), (100.0, 150.0), (150.0, 210.0)))]
BANDS_SQL = "bands(band_lie, from_yds, to_yds, up_down_pct, prox_ft) AS (VALUES " + ",".join(f"('{l}',{a}::DOUBLE,{b}::DOUBLE,{u}::DOUBLE,{p}::DOUBLE)" for l, a, b, u, p in BANDS) + ")"


def bands(d):
    return table(d.spark, "band_lie string, from_yds double, to_yds double, up_down_pct double, prox_ft double", BANDS)


@query("short_game_bands", f"""WITH {BANDS_SQL}, {CHIP}, elig AS (SELECT * FROM live WHERE shot_type='shortGame'), {RW.replace(f'({NOW_S}-last_s)/(30.436875*86400) > 12', 'false')},
 z AS (SELECT co.*, w, b.* FROM co JOIN rw USING (player_id, round_id) JOIN bands b ON b.band_lie=CASE lie WHEN 'rough' THEN 'rough' ELSE 'fairway' END AND to_pin_yds>=from_yds AND to_pin_yds<to_yds WHERE up_down IS NOT NULL AND w>0),
 {med_cte('m', 'z', 'player_id, band_lie, from_yds', 'leave_ft', 'w')},
 g AS (SELECT player_id, band_lie, from_yds, count(*) AS n, sum(w) AS ne, sum(CASE WHEN up_down THEN w ELSE 0 END) AS u, sum(CASE WHEN leave_ft IS NOT NULL THEN w END) AS lw, max(up_down_pct) AS pu, max(prox_ft) AS pp FROM z GROUP BY ALL)
SELECT player_id, band_lie, from_yds, CAST(n AS BIGINT) AS n, {HU('ne', 1)} AS n_eff, {HU('(u+5*pu)/(ne+5)', 3)} AS up_down_pct, {HU('CASE WHEN med IS NULL THEN pp ELSE (lw*med+5*pp)/(lw+5) END', 1)} AS prox_ft FROM g LEFT JOIN m USING (player_id, band_lie, from_yds)""", ("shots_v", "hole_scores_v"))
def short_game_bands(d):
    return L.short_game(*chip_in(d), bands(d))


LIVE = "SELECT round_id FROM rounds_v WHERE round_id%13<>0"


@query("known_rounds_only", f"SELECT player_id, CAST(count(*) AS BIGINT) AS n FROM shots_v WHERE round_id IN ({LIVE}) GROUP BY player_id", ("shots_v", "rounds_v"))
def known_rounds_only(d):
    """J-17: shots count only while their round is still in the history."""
    alive = d.rounds.filter("round_id % 13 <> 0").select("round_id")
    return d.shots.join(alive, "round_id", "left_semi").groupBy("player_id").agg(F.count(F.lit(1)).alias("n"))


# ---- J-05 / J-18: entry resolution -------------------------------------------------------------------
@query("entry_resolve")
def entry_resolve(d):
    r = R.resolve(R.every_lie(d.view("entries_v")), d.view("entries_v"), ORDER)
    return r.select("player_id", "club", "swing", "lie", "source_lie", *[half_up(f, 4).alias(f) for f in ("total", "carry", "roll", "dist_sd", "lateral_sd", "lat_sd_deg")], "lat_sd_club", "lat_sd_lie")


RK = lambda t, e: f"CASE WHEN {t}='tee' THEN CASE {e} WHEN 'tee' THEN 0 WHEN 'fairway' THEN 1 ELSE 2 END WHEN {t}='fairway' THEN CASE {e} WHEN 'fairway' THEN 0 WHEN 'tee' THEN 1 ELSE 2 END ELSE CASE {e} WHEN 'rough' THEN 0 WHEN 'fairway' THEN 1 ELSE 2 END END"
CANDS = f"""WITH tg AS (SELECT p.player_id, p.club, p.swing, l.lie FROM (SELECT DISTINCT player_id, club, swing FROM entries_v) p CROSS JOIN (VALUES ('tee'),('fairway'),('rough'),('sand'),('recovery')) l(lie)),
 a AS (SELECT t.*, e.club AS c2, e.lie AS l2, e.total_yds, e.lat_sd_deg, CASE WHEN e.club=t.club THEN {RK('t.lie', 'e.lie')} ELSE 100+(2*abs({POS.format(c='e.club')}-{POS.format(c='t.club')})+CASE WHEN {POS.format(c='e.club')}>{POS.format(c='t.club')} THEN 1 ELSE 0 END)*10+{RK('t.lie', 'e.lie')} END AS rk FROM tg t JOIN entries_v e ON e.player_id=t.player_id AND e.swing=t.swing)
SELECT player_id, club, swing, lie, arg_min(l2, rk) FILTER (c2=club) AS source_lie, arg_min(total_yds, rk) FILTER (c2=club) AS total, arg_min(lat_sd_deg, rk) FILTER (lat_sd_deg IS NOT NULL) AS lat_sd_deg,
 arg_min(c2, rk) FILTER (lat_sd_deg IS NOT NULL) AS lat_sd_club, arg_min(l2, rk) FILTER (lat_sd_deg IS NOT NULL) AS lat_sd_lie FROM a WHERE NOT (swing='full' AND lie<>'tee' AND club IN ('Dr','2i')) GROUP BY ALL HAVING arg_min(lat_sd_deg, rk) FILTER (lat_sd_deg IS NOT NULL) IS NOT NULL"""


@query("candidate_entries", CANDS, ("entries_v", "shots_v"))
def candidate_entries(d):
    """J-18: what can be hit from each lie, with tee-only full swings left out elsewhere."""
    r = R.candidates(d.view("entries_v"), ORDER)
    return r.select("player_id", "club", "swing", "lie", "source_lie", "total", "lat_sd_deg", "lat_sd_club", "lat_sd_lie")
