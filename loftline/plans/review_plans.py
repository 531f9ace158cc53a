"""Registered queries for order-dependent operators (W-01, W-02, W-04 .. W-06, W-11, A-25, A-26, A-40, A-44)."""

from __future__ import annotations

from pyspark.sql import functions as F

from loftline.functions.numbers import half_up
from loftline.operators import review as V
from loftline.plans.registry import HU, query
from loftline.plans.shots_plans import FAM
from loftline.settings import DEFAULTS
from loftline.streaming import running


def scores(d):
    return d.holes.select("player_id", "round_id", "hole", "score")


@query("chain_close", f"""WITH p AS (SELECT player_id, round_id, hole, arg_min(sx, shot_no) AS px, arg_min(sy, shot_no) AS py FROM shots_v WHERE shot_type='putt' GROUP BY ALL),
 n AS (SELECT *, lead(shot_no) OVER w AS nn, lead(sx) OVER w AS nx, lead(sy) OVER w AS ny FROM shots_v WHERE shot_type<>'putt' WINDOW w AS (PARTITION BY player_id, round_id, hole ORDER BY shot_no, ts_s, shot_id)),
 e AS (SELECT n.*, CASE WHEN nn=shot_no+1 THEN 'next' WHEN nn IS NULL AND px IS NOT NULL THEN 'putt' ELSE 'own' END AS end_from, px, py, sqrt((tx-sx)*(tx-sx)+(ty-sy)*(ty-sy)) AS L FROM n LEFT JOIN p USING (player_id, round_id, hole)),
 f AS (SELECT *, CASE end_from WHEN 'next' THEN nx WHEN 'putt' THEN px ELSE ex END AS fx, CASE end_from WHEN 'next' THEN ny WHEN 'putt' THEN py ELSE ey END AS fy FROM e)
SELECT shot_id, end_from, {HU('(fx-sx)*(tx-sx)/L+(fy-sy)*(ty-sy)/L-L', 1)} AS distance_miss_yds, {HU('(fx-sx)*(ty-sy)/L-(fy-sy)*(tx-sx)/L', 1)} AS lateral_miss_yds FROM f""", ("shots_v",))
def chain_close(d):
    return V.chain_close(d.shots).select("shot_id", "end_from", "distance_miss_yds", "lateral_miss_yds")


@query("renumber", """SELECT shot_id, CAST(row_number() OVER (PARTITION BY player_id, round_id, hole, shot_type='putt' ORDER BY shot_no, ts_s, shot_id) AS INT) AS new_no FROM shots_v""", ("shots_v",))
def renumber(d):
    return V.renumber(d.shots).select("shot_id", "new_no")


@query("hole_lists", """WITH h AS (SELECT DISTINCT player_id, round_id, hole FROM shots_v WHERE abs(lat_miss_yds)>15), g AS (SELECT player_id, round_id, list(hole ORDER BY hole) AS l FROM h GROUP BY ALL)
SELECT player_id, round_id, array_to_string(list_transform(l, lambda x: 'H'||x), ', ') AS tags, CASE WHEN len(l)=1 THEN CAST(l[1] AS VARCHAR) ELSE array_to_string(list_transform(l[1:len(l)-1], lambda x: CAST(x AS VARCHAR)), ', ')||' and '||l[len(l)] END AS words FROM g""", ("shots_v",))
def hole_lists(d):
    return V.hole_lists(d.shots.filter(F.abs("lat_miss_yds") > 15))


@query("hole_review", """WITH g AS (SELECT player_id, round_id, hole, count(*) FILTER (shot_type<>'putt') AS ns, count(*) FILTER (shot_type='putt') AS np, count(*) FILTER (NOT reviewed) AS un, list(DISTINCT shot_no) FILTER (shot_type<>'putt') AS nos FROM shots_v GROUP BY ALL),
 a AS (SELECT g.*, score, np=0 AS need, CASE WHEN np=0 THEN greatest(0, score-ns) ELSE np END AS pu FROM g JOIN hole_scores_v USING (player_id, round_id, hole)),
 b AS (SELECT *, greatest(0, score-pu) AS ex, greatest(greatest(0, score-pu), coalesce(list_max(nos),0)) AS top FROM a),
 c AS (SELECT *, list_filter(range(1, top+1), lambda x: NOT coalesce(list_contains(nos, CAST(x AS INT)), false)) AS ms, ns-coalesce(len(nos),0) AS extr, top+ns-coalesce(len(nos),0)+pu AS story FROM b)
SELECT player_id, round_id, hole, CAST(ns AS BIGINT) AS n_shots, CAST(np AS BIGINT) AS n_putts, CAST(ex AS BIGINT) AS expected, array_to_string(ms, ',') AS missing, CAST(extr AS BIGINT) AS extras, CAST(un AS BIGINT) AS unreviewed, CAST(story AS BIGINT) AS story, need AS putts_needed, story<>score AS count_off, un>0 OR len(ms)>0 OR need OR story<>score AS needed FROM c""", ("shots_v", "hole_scores_v"))
def hole_review(d):
    return V.hole_review(d.shots, scores(d))


@query("reconcile", """SELECT player_id, round_id, CAST(hole AS INT) AS hole, CAST(count(*) AS BIGINT) AS records, CAST(count(*) FILTER (part_no%19=0) AS BIGINT) AS penalties, any_value(score) AS score FROM shots_v JOIN hole_scores_v USING (player_id, round_id, hole) GROUP BY player_id, round_id, hole HAVING count(*)+count(*) FILTER (part_no%19=0)<>any_value(score)""", ("shots_v", "hole_scores_v"))
def reconcile(d):
    return V.reconcile(d.shots.withColumn("penalty", F.col("part_no") % 19 == 0), scores(d))


@query("inferred_putts", """WITH g AS (SELECT player_id, round_id, hole, score-count(*) AS k FROM shots_v JOIN hole_scores_v USING (player_id, round_id, hole) GROUP BY player_id, round_id, hole, score HAVING count(*) FILTER (shot_type='putt')=0 AND score-count(*)>0)
SELECT player_id, round_id, CAST(hole AS INT) AS hole, CAST(i AS INT) AS putt_no, i=k AS made FROM (SELECT *, unnest(range(1,k+1)) AS i FROM g)""", ("shots_v", "hole_scores_v"))
def inferred_putts(d):
    return V.inferred_putts(d.shots, scores(d))


@query("suggested_score", """SELECT player_id, round_id, CAST(hole AS INT) AS hole, CAST(count(*) AS BIGINT) AS suggested, CAST(count(*) FILTER (shot_type='putt') AS BIGINT) AS putts FROM shots_v GROUP BY ALL""", ("shots_v",))
def suggested_score(d):
    """A-44 and the per-round counts of A-19."""
    return d.shots.groupBy(*V.HOLE).agg(F.count(F.lit(1)).alias("suggested"), F.count(F.when(F.col("shot_type") == "putt", 1)).alias("putts"))


EV = f"""base AS (SELECT *, NOT coalesce(end_assumed,false) AS has, pow(dist_miss_yds/(0.05*intended_yds),2)+pow(lat_miss_yds/(intended_yds*tan(radians(1.5))),2)<=1 AND NOT coalesce(end_assumed,false) AS onx FROM shots_v WHERE coalesce(teach,true) AND logged<>'skipped' AND shot_type IN ('full','finesse')),
 gr AS (SELECT *, 'family' AS kind, {FAM} AS key FROM base UNION ALL SELECT *, 'lie', lie FROM base),
 ax AS (SELECT *, 'distance' AS axis, onx AS ok, CASE WHEN NOT onx AND abs(dist_miss_yds)>0.05*intended_yds THEN sign(dist_miss_yds) END AS dir, dist_miss_yds AS miss FROM gr WHERE has
  UNION ALL SELECT *, 'direction', onx, CASE WHEN NOT onx AND abs(lat_miss_yds)>intended_yds*tan(radians(1.5)) THEN sign(lat_miss_yds) END, lat_miss_yds FROM gr WHERE has
  UNION ALL SELECT *, 'contact', abs(contact)<1, CASE WHEN abs(contact)>=1 THEN sign(contact) END, NULL FROM gr WHERE contact IS NOT NULL),
 ps AS (SELECT *, row_number() OVER w AS pos, ok AND coalesce(lag(ok) OVER w, false) AS clr FROM ax WINDOW w AS (PARTITION BY player_id, round_id, kind, key, axis ORDER BY ts_s, shot_id)),
 ev AS (SELECT player_id, round_id, kind, key, axis, hole, shot_id, CAST(dir AS INT) AS dir, miss FROM (SELECT *, coalesce(max(CASE WHEN clr THEN pos END) OVER (PARTITION BY player_id, round_id, kind, key, axis),0) AS cut FROM ps) WHERE pos>cut AND dir<>0)"""


@query("evidence", f"WITH {EV} SELECT * FROM ev", ("shots_v",))
def evidence(d):
    return V.evidence(d.shots)


CORR = f"""{EV}, g AS (SELECT player_id, round_id, kind, key, axis, count(*) FILTER (dir<0) AS nn, count(*) FILTER (dir>0) AS np, avg(miss) FILTER (dir<0) AS mn, avg(miss) FILTER (dir>0) AS mp, list(shot_id) FILTER (dir<0) AS ln, list(shot_id) FILTER (dir>0) AS lp FROM ev GROUP BY ALL),
 dm AS (SELECT player_id, round_id, kind, key, axis, CASE WHEN nn>np THEN -1 ELSE 1 END AS dir, CAST(greatest(nn,np) AS BIGINT) AS n, CASE WHEN nn>np THEN mn ELSE mp END AS mean_miss, CASE WHEN nn>np THEN ln ELSE lp END AS ids FROM g WHERE greatest(nn,np)>=2 AND nn<>np),
 kept AS (SELECT * FROM dm a WHERE NOT (kind='lie' AND EXISTS (SELECT 1 FROM dm b WHERE b.kind='family' AND b.player_id=a.player_id AND b.round_id=a.round_id AND b.axis=a.axis AND b.dir=a.dir AND list_has_all(b.ids, a.ids))))"""


@query("corrections", f"WITH {CORR} SELECT player_id, round_id, kind, key, axis, dir, n, {HU('mean_miss', 4)} AS mean_miss, {HU('-0.5*mean_miss', 4)} AS raw_shift FROM kept", ("shots_v",))
def corrections(d):
    c = V.corrections(V.evidence(d.shots))
    return c.select("player_id", "round_id", "kind", "key", "axis", "dir", "n", half_up("mean_miss", 4).alias("mean_miss"), half_up("raw_shift", 4).alias("raw_shift"))


@query("running_corrections", f"WITH {CORR} SELECT player_id, round_id, kind, key, axis, dir, n, {HU('mean_miss', 4)} AS mean_miss, {HU('-0.5*mean_miss', 4)} AS raw_shift FROM kept", ("shots_v",))
def running_corrections(d):
    """S-05 run to the end of every round: the state that a stream would hold then."""
    c = running.running_corrections(d.shots).select("player_id", "round_id", F.inline("corrections"))
    return c.select("player_id", "round_id", "kind", "key", "axis", "dir", "n", half_up("mean_miss", 4).alias("mean_miss"), half_up("raw_shift", 4).alias("raw_shift"))


@query("round_adjustments", f"""WITH {CORR}, u AS (SELECT k.*, f.fam, CASE WHEN axis='distance' THEN greatest(-8, least(8, -0.5*mean_miss)) ELSE -0.5*mean_miss END AS sh FROM kept k JOIN (VALUES ('long'),('mid'),('short'),('wedge')) f(fam) ON (kind='family' AND key=fam) OR (kind='lie' AND key='rough') WHERE axis<>'contact')
SELECT player_id, round_id, fam, axis, {HU("arg_max(sh, abs(sh)*10+CASE WHEN kind='family' THEN 0.000001 ELSE 0 END)", 1)} AS shift_yds FROM u GROUP BY ALL""", ("shots_v",))
def round_adjustments(d):
    gaps = d.shots.select("player_id").distinct().select("player_id", F.explode(F.array(*[F.lit(f) for f in ("long", "mid", "short", "wedge")])).alias("fam"), F.lit(8.0).alias("gap_yds"))
    return V.adjustments(V.corrections(V.evidence(d.shots)), gaps, "rough")


@query("heads_up", """WITH m AS (SELECT * FROM shots_v WHERE coalesce(teach,true) AND logged<>'skipped' AND NOT coalesce(end_assumed,false) AND shot_type IN ('full','finesse')),
 l AS (SELECT player_id, max(day_no*10000000000+round_id) AS k FROM m GROUP BY player_id),
 t AS (SELECT m.player_id, club, shot_type AS swing, ts_s, shot_id, CASE WHEN abs(lat_miss_yds)>intended_yds*tan(radians(1.5)) THEN sign(lat_miss_yds) ELSE 0 END AS la, CASE WHEN abs(dist_miss_yds)>intended_yds*0.05 THEN sign(dist_miss_yds) ELSE 0 END AS di FROM m JOIN l ON l.player_id=m.player_id AND m.day_no*10000000000+m.round_id=l.k),
 r AS (SELECT *, row_number() OVER (PARTITION BY player_id, club, swing ORDER BY ts_s DESC, shot_id DESC) AS rn FROM t),
 g AS (SELECT player_id, club, swing, count(*) AS n, count(*) FILTER (la=-1) AS l1, count(*) FILTER (la=1) AS r1, count(*) FILTER (di=-1) AS s1, count(*) FILTER (di=1) AS g1 FROM r WHERE rn<=4 GROUP BY ALL),
 h AS (SELECT *, CASE WHEN (n=2 AND l1=2) OR (n>=3 AND l1>=3) THEN 'left' WHEN (n=2 AND r1=2) OR (n>=3 AND r1>=3) THEN 'right' WHEN (n=2 AND s1=2) OR (n>=3 AND s1>=3) THEN 'short' WHEN (n=2 AND g1=2) OR (n>=3 AND g1>=3) THEN 'long' END AS td FROM g),
 q AS (SELECT player_id, club, shot_type AS swing, count(*) AS hn, count(*) FILTER (dist_miss_yds<=-0.10::DOUBLE*intended_yds) AS hs, count(*) FILTER (dist_miss_yds>=0.10::DOUBLE*intended_yds) AS hl FROM m GROUP BY ALL),
 z AS (SELECT q.*, td, n, CASE td WHEN 'left' THEN l1 WHEN 'right' THEN r1 WHEN 'short' THEN s1 ELSE g1 END AS k, hn>=10 AND hs/hn>=0.2-1e-9 AS sh, hn>=10 AND hl/hn>=0.2-1e-9 AS lo FROM q LEFT JOIN h USING (player_id, club, swing))
SELECT player_id, club, swing, CASE WHEN td IS NOT NULL THEN 'today' ELSE 'history' END AS kind, coalesce(td, CASE WHEN sh THEN 'short' ELSE 'long' END) AS dir, CAST(CASE WHEN td IS NOT NULL THEN k END AS BIGINT) AS k, CAST(CASE WHEN td IS NOT NULL THEN n ELSE hn END AS BIGINT) AS n,
 CASE WHEN td IS NULL THEN floor(floor(CASE WHEN sh THEN hs ELSE hl END/hn*100+0.5)/10/10*10+0.5)/10 END AS share FROM z WHERE td IS NOT NULL OR sh OR lo""", ("shots_v",))
def heads_up(d):
    return V.heads_up(d.shots, DEFAULTS.merged({"heads_up": {"hist_share": 0.2}}))
