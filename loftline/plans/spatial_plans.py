"""Registered queries for spatial and terrain operators (O-12, O-13, O-30 .. O-32, O-42, O-45, P-01 .. P-28, A-28 .. A-32)."""

from __future__ import annotations

from pyspark.sql import functions as F

from loftline.functions import geo, registered
from loftline.functions import rings as G
from loftline.functions.numbers import half_up
from loftline.operators import greens as R
from loftline.operators import shots as S
from loftline.operators import spatial as P
from loftline.operators import teeboxes as B
from loftline.operators import terrain as T
from loftline.operators.skew import evaluated_once
from loftline.plans.data import add_view
from loftline.plans.registry import HU, ORACLES, query
from loftline.settings import DEFAULTS

OCT = [(1.0, 0.4), (0.4, 1.0), (-0.4, 1.0), (-1.0, 0.4), (-1.0, -0.4), (-0.4, -1.0), (0.4, -1.0), (1.0, -0.4)]
BOX = [(1.0, 1.0), (-1.0, 1.0), (-1.0, -1.0), (1.0, -1.0)]

# one polygon per part on twenty courses, and an outline round every even course
add_view("feat_v", """SELECT CAST(p_partkey%20 AS BIGINT) AS course_id, p_partkey AS feature_id, CASE p_partkey%7 WHEN 0 THEN 'green' WHEN 1 THEN 'sand' WHEN 2 THEN 'water' WHEN 3 THEN 'tee' WHEN 5 THEN 'trees' ELSE 'fairway' END AS kind,
  CAST(p_partkey%18+1 AS INT) AS f_hole, CAST((p_partkey*37)%240-120 AS DOUBLE) AS cx, CAST((p_partkey*61)%400 AS DOUBLE) AS cy,
  CAST((6+p_size%14)*CASE WHEN p_partkey%7 IN (4,6) THEN 2 ELSE 1 END AS DOUBLE) AS rx, CAST((6+p_partkey%11)*CASE WHEN p_partkey%7 IN (4,6) THEN 4 ELSE 1 END AS DOUBLE) AS ry,
  CASE WHEN p_partkey%7=5 AND p_size%2=0 THEN 1 ELSE 0 END AS holed FROM part
 UNION ALL SELECT DISTINCT CAST(p_partkey%20 AS BIGINT), -(p_partkey%20)-1, 'boundary', CAST(0 AS INT), CAST(0 AS DOUBLE), CAST(190 AS DOUBLE), CAST(110 AS DOUBLE), CAST(200 AS DOUBLE), 0 FROM part WHERE p_partkey%2=0""")
add_view("lines_v", """SELECT DISTINCT CAST(p_partkey%20 AS BIGINT) AS course_id, CAST(p_partkey%18+1 AS INT) AS hole, CAST((p_partkey%20*7+(p_partkey%18)*13)%200-100 AS DOUBLE) AS x0, CAST((p_partkey%18)*19%150 AS DOUBLE) AS y0,
  CAST((p_partkey%20*7+(p_partkey%18)*13)%200-100+(p_partkey%5-2)*20 AS DOUBLE) AS x1, CAST((p_partkey%18)*19%150+150+(p_partkey%18)*5 AS DOUBLE) AS y1 FROM part WHERE p_partkey%5=(p_partkey%18)%5""")
_ring = lambda m: "(VALUES " + ",".join(f"({i},{a}::DOUBLE,{b}::DOUBLE)" for i, (a, b) in enumerate(m)) + ")"
EDGES = f"""ver AS (SELECT feature_id, 0 AS ring, k, 8 AS n, cx+mx*rx AS x, cy+my*ry AS y FROM feat_v, {_ring(OCT)} v(k,mx,my) WHERE kind<>'boundary' UNION ALL SELECT feature_id, 0, k, 4, cx+mx*rx, cy+my*ry FROM feat_v, {_ring(BOX)} v(k,mx,my) WHERE kind='boundary'
  UNION ALL SELECT feature_id, 1, k, 8, cx+mx*0.5::DOUBLE*rx, cy+my*0.5::DOUBLE*ry FROM feat_v, {_ring(OCT)} v(k,mx,my) WHERE holed=1),
 ed AS (SELECT a.feature_id, a.ring, a.k, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS bw FROM ver a JOIN ver b ON a.feature_id=b.feature_id AND a.ring=b.ring AND b.k=(a.k+1)%a.n), bal AS (SELECT shot_id, course_id, hole, ex AS x, ey AS y FROM shots_v)"""
CROSS = "CASE WHEN (ay>y)<>(bw>y) AND x < (bx-ax)*(y-ay)/(bw-ay)+ax THEN 1 ELSE 0 END"
SEGD = lambda px, py: (f"sqrt(pow({px}-(ax+tt*(bx-ax)),2)+pow({py}-(ay+tt*(bw-ay)),2))")


def hits(name, pts, cols, where="true"):
    bare = cols.replace("p.", "")
    return (f"{name}_p AS (SELECT {cols}, f.feature_id, f.kind, f.f_hole FROM {pts} p JOIN feat_v f ON f.course_id=p.course_id AND x>=cx-rx AND x<=cx+rx AND y>=cy-ry AND y<=cy+ry AND {where}), "
            f"{name} AS (SELECT {bare}, feature_id, kind, f_hole FROM {name}_p p JOIN ed USING (feature_id) GROUP BY ALL HAVING sum(CASE WHEN ring=0 THEN {CROSS} ELSE 0 END)%2=1 AND sum(CASE WHEN ring=1 THEN {CROSS} ELSE 0 END)%2=0)")


NEEDS = ("feat_v", "shots_v")


def features(d):
    f = d.view("feat_v")
    ring = lambda m, k=1.0: F.array(*[G.pt(F.col("cx") + a * k * F.col("rx"), F.col("cy") + b * k * F.col("ry")) for a, b in m])
    none = F.array().cast("array<array<struct<x:double,y:double>>>")
    return evaluated_once(f.select("course_id", "feature_id", "kind", "f_hole", F.when(F.col("kind") == "boundary", ring(BOX)).otherwise(ring(OCT)).alias("ring"),
                    F.when(F.col("holed") == 1, F.array(ring(OCT, 0.5))).otherwise(none).alias("inner")))


def balls(d):
    return d.shots.select("shot_id", "course_id", "hole", F.col("ex").alias("x"), F.col("ey").alias("y"), "start_acc_m")


def bounded(d):
    return features(d).filter("kind = 'boundary'").select("course_id")


@query("point_in_polygon", f"WITH {EDGES}, {hits('h', 'bal', 'shot_id, x, y')} SELECT shot_id, feature_id, kind FROM h", NEEDS)
def point_in_polygon(d):
    return P.containing(balls(d), features(d)).select("shot_id", "feature_id", "kind")


RANK = "CASE WHEN kind='green' AND f_hole<>hole THEN 5 WHEN kind='green' THEN 1 WHEN kind='sand' THEN 2 WHEN kind='water' THEN 3 WHEN kind='tee' THEN 4 WHEN kind='fairway' THEN 5 WHEN kind='trees' THEN 6 END"
NAMED = "CASE {p} WHEN 1 THEN 'green' WHEN 2 THEN 'sand' WHEN 3 THEN 'water' WHEN 4 THEN 'tee' WHEN 5 THEN 'fairway' WHEN 6 THEN 'trees' WHEN 7 THEN 'ob' ELSE 'rough' END"
SURF = f"""{EDGES}, {hits('h', 'bal', 'shot_id, hole, x, y')}, s AS (SELECT shot_id, min({RANK}) AS p, max(CASE WHEN kind='boundary' THEN 1 ELSE 0 END) AS b FROM h GROUP BY shot_id),
 sf AS (SELECT bal.*, CASE WHEN coalesce(p,8)=8 AND course_id%2=0 AND coalesce(b,0)=0 THEN 7 ELSE coalesce(p,8) END AS p FROM bal LEFT JOIN s USING (shot_id))"""


@query("surface_classify", f"WITH {SURF} SELECT shot_id, {NAMED.format(p='p')} AS surface FROM sf", NEEDS)
def surface_classify(d):
    return P.surface(balls(d), features(d), "shot_id", bounded(d)).select("shot_id", "surface")


@query("landing_tones", f"WITH {SURF} SELECT course_id, CAST(hole AS INT) AS hole, CASE WHEN p IN (1,4,5) THEN 'fairway' WHEN p=8 THEN 'rough' ELSE 'trouble' END AS tone, CAST(count(*) AS BIGINT) AS n FROM sf GROUP BY ALL", NEEDS)
def landing_tones(d):
    s = P.surface(balls(d), features(d), "shot_id", bounded(d))
    return s.groupBy("course_id", "hole", P.tone("surface").alias("tone")).agg(F.count(F.lit(1)).alias("n"))


PROBES = "(SELECT 0 AS n, 0.0::DOUBLE AS f, 0.0::DOUBLE AS a UNION ALL SELECT 1+i+16*h, CASE WHEN h=0 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END, i*pi()/8 FROM (SELECT unnest(range(0,16)) AS i) CROSS JOIN (SELECT unnest(range(0,2)) AS h))"


@query("lie_confidence", f"""WITH {EDGES}, fx AS (SELECT shot_id, course_id, hole, ex AS bx0, ey AS by0, start_acc_m AS acc, greatest(start_acc_m,5)*1.0936133::DOUBLE AS r FROM shots_v),
 pts AS (SELECT shot_id, course_id, hole, n, CASE WHEN n=0 THEN bx0 ELSE bx0+r*f*cos(a) END AS x, CASE WHEN n=0 THEN by0 ELSE by0+r*f*sin(a) END AS y FROM fx CROSS JOIN {PROBES}),
 {hits('h', 'pts', 'shot_id, hole, n, x, y')}, s AS (SELECT shot_id, n, min({RANK}) AS p, max(CASE WHEN kind='boundary' THEN 1 ELSE 0 END) AS b FROM h GROUP BY shot_id, n),
 sf AS (SELECT pts.shot_id, n, CASE WHEN coalesce(p,8)=8 AND course_id%2=0 AND coalesce(b,0)=0 THEN 7 ELSE coalesce(p,8) END AS p FROM pts LEFT JOIN s USING (shot_id, n)),
 g AS (SELECT shot_id, max(CASE WHEN n=0 THEN p END) AS p0, min(p) AS lo, max(p) AS hi FROM sf GROUP BY shot_id)
SELECT shot_id, {NAMED.format(p='p0')} AS lie, CASE WHEN lo<>hi OR p0 IN (3,7) OR acc>8 THEN 'low' ELSE 'high' END AS confidence FROM g JOIN fx USING (shot_id)""", NEEDS)
def lie_confidence(d):
    return P.lie_confidence(balls(d), features(d), "shot_id", F.col("start_acc_m"), bounded(d))


DIST = lambda name, pts, key, reach: f"""{name}_c AS (SELECT p.*, f.feature_id, f.kind FROM {pts} p JOIN feat_v f ON f.course_id=p.course_id AND x>=cx-rx-{reach} AND x<=cx+rx+{reach} AND y>=cy-ry-{reach} AND y<=cy+ry+{reach}),
 {name}_t AS (SELECT c.*, ring, ax, ay, bx, bw, greatest(0, least(1, ((x-ax)*(bx-ax)+(y-ay)*(bw-ay))/((bx-ax)*(bx-ax)+(bw-ay)*(bw-ay)))) AS tt FROM {name}_c c JOIN ed USING (feature_id)),
 {name} AS (SELECT {key}, feature_id, kind, CASE WHEN sum(CASE WHEN ring=0 THEN {CROSS} ELSE 0 END)%2=1 AND sum(CASE WHEN ring=1 THEN {CROSS} ELSE 0 END)%2=0 THEN 0 ELSE min(CASE WHEN ring=0 THEN {SEGD('x', 'y')} END) END AS dd FROM {name}_t GROUP BY ALL)"""  # noqa: E731


@query("ring_distance", f"WITH {EDGES}, {DIST('q', 'bal', 'shot_id', 20)} SELECT shot_id, kind, {HU('min(dd)', 6)} AS dist FROM q WHERE dd<=20 AND kind<>'boundary' GROUP BY shot_id, kind", NEEDS)
def ring_distance(d):
    return P.nearest(balls(d), features(d).filter("kind <> 'boundary'"), "shot_id", 20.0).select("shot_id", "kind", half_up("dist", 6).alias("dist"))


@query("tee_snap", f"WITH {EDGES}, st AS (SELECT shot_id, course_id, sx AS x, sy AS y FROM shots_v), {DIST('q', 'st', 'shot_id', 15)} SELECT shot_id, bool_or(coalesce(dd<=15 AND kind='tee', false)) AS on_tee FROM st LEFT JOIN q USING (shot_id) GROUP BY shot_id", NEEDS)
def tee_snap(d):
    """P-24: a start within 15 yards of any tee box."""
    st = d.shots.select("shot_id", "course_id", F.col("sx").alias("x"), F.col("sy").alias("y"))
    n = P.nearest(st, features(d).filter("kind = 'tee'"), "shot_id", DEFAULTS.tee_snap_yds).select("shot_id", F.lit(True).alias("t"))
    return st.join(n, "shot_id", "left").select("shot_id", F.coalesce("t", F.lit(False)).alias("on_tee"))


@query("tee_near", f"""WITH {EDGES}, st AS (SELECT shot_id, course_id, hole%18+1 AS hole, sx AS x, sy AS y FROM shots_v), {DIST('q', 'st', 'shot_id', 15)}, bx AS (SELECT DISTINCT course_id, f_hole AS hole FROM feat_v WHERE kind='tee'),
 hb AS (SELECT DISTINCT shot_id FROM q JOIN feat_v f USING (feature_id) JOIN st USING (shot_id) WHERE q.kind='tee' AND dd<=15 AND f.f_hole=st.hole)
SELECT st.shot_id, CASE WHEN bx.hole IS NOT NULL THEN hb.shot_id IS NOT NULL ELSE coalesce(sqrt((x-x0)*(x-x0)+(y-y0)*(y-y0))<=15, false) END AS on_tee FROM st LEFT JOIN bx ON bx.course_id=st.course_id AND bx.hole=st.hole LEFT JOIN hb ON hb.shot_id=st.shot_id LEFT JOIN lines_v l ON l.course_id=st.course_id AND l.hole=st.hole""", ("feat_v", "shots_v", "lines_v"))
def tee_near(d):
    """P-24 by hole, with the tee point for holes without a box."""
    st = d.shots.select("shot_id", "course_id", (F.col("hole") % 18 + 1).alias("hole"), F.col("sx").alias("x"), F.col("sy").alias("y"))
    ln = d.view("lines_v").select("course_id", "hole", F.col("x0").alias("tee_x"), F.col("y0").alias("tee_y"))
    return P.near_tee(st, features(d).filter("kind = 'tee'"), ln, "shot_id", DEFAULTS.tee_snap_yds)


@query("ring_area", f"WITH {EDGES} SELECT feature_id, {HU('abs(sum(ax*bw-bx*ay))/2+1e-9', 4)} AS area, {HU('any_value(cx)+1e-9', 4)} AS x, {HU('any_value(cy)+1e-9', 4)} AS y FROM ed JOIN feat_v USING (feature_id) WHERE ring=0 GROUP BY feature_id", NEEDS)
def ring_area(d):
    f = evaluated_once(features(d).select("feature_id", G.area("ring").alias("area"), G.centroid("ring").alias("c")))
    return f.select("feature_id", half_up(F.col("area") + 1e-9, 4).alias("area"), half_up(F.col("c.x") + 1e-9, 4).alias("x"), half_up(F.col("c.y") + 1e-9, 4).alias("y"))


LNS = "smp AS (SELECT course_id, hole, k, n, x0+(x1-x0)*k/n AS x, y0+(y1-y0)*k/n AS y FROM (SELECT *, greatest(1,ceil(sqrt((x1-x0)*(x1-x0)+(y1-y0)*(y1-y0))/10)) AS n, unnest(range(0, CAST(greatest(1,ceil(sqrt((x1-x0)*(x1-x0)+(y1-y0)*(y1-y0))/10)) AS BIGINT)+1)) AS k FROM lines_v))"


@query("line_samples", f"WITH {LNS} SELECT course_id, hole, CAST(k AS INT) AS k, {HU('x', 6)} AS x, {HU('y', 6)} AS y FROM smp", ("lines_v",))
def line_samples(d):
    return P.sample_line(d.view("lines_v"), 10.0).select("course_id", "hole", "k", half_up("x", 6).alias("x"), half_up("y", 6).alias("y"))


LN = ("feat_v", "lines_v", "shots_v")
REACH = f"({DEFAULTS.assign_m}*1.0936133::DOUBLE)"
OUTLINE = DIST("q", "smp", "course_id, hole, k", REACH).replace(f" AND sum(CASE WHEN ring=1 THEN {CROSS} ELSE 0 END)%2=0", "")


@query("feature_assign", f"""WITH {EDGES}, {LNS}, {OUTLINE}, m AS (SELECT course_id, hole, feature_id, kind, min(dd) AS d FROM q WHERE kind NOT IN ('boundary','green') GROUP BY ALL HAVING min(dd)<={REACH}),
 st AS (SELECT course_id, hole, x0 AS x, y0 AS y FROM lines_v), {hits('h', 'st', 'p.course_id, hole, x, y', "kind='tee'")},
 w AS (SELECT m.*, CASE WHEN m.kind='tee' THEN h.feature_id IS NOT NULL ELSE d=0 END AS hit FROM m LEFT JOIN h ON h.course_id=m.course_id AND h.hole=m.hole AND h.feature_id=m.feature_id),
 z AS (SELECT *, bool_or(hit) OVER (PARTITION BY course_id, feature_id) AS anyhit, row_number() OVER (PARTITION BY course_id, feature_id ORDER BY d, hole) AS rn FROM w)
SELECT course_id, feature_id, kind, hole, {HU('d', 6)} AS d FROM z WHERE CASE WHEN kind IN ('trees','sand','water') THEN true WHEN anyhit THEN hit ELSE rn=1 END""", LN)
def feature_assign(d):
    return P.assign_features(d.view("lines_v"), features(d).filter("kind <> 'boundary' AND kind <> 'green'"), DEFAULTS.yards("assign_m")).select("course_id", "feature_id", "kind", "hole", half_up("d", 6).alias("d"))


@query("near_hole_features", f"WITH {EDGES}, {LNS}, {DIST('q', 'smp', 'course_id, hole, k', 100)} SELECT course_id, hole, kind, CAST(count(DISTINCT feature_id) AS BIGINT) AS n FROM q WHERE kind<>'boundary' AND dd<=100 GROUP BY ALL", LN)
def near_hole_features(d):
    """P-10 / P-20: features within 100 yards of a hole's line."""
    x = P.line_distance(d.view("lines_v"), features(d).filter("kind <> 'boundary'"), DEFAULTS.near_hole_yds)
    return x.groupBy("course_id", "hole", "kind").agg(F.count(F.lit(1)).alias("n"))


GREENS = f"""WITH {EDGES}, e AS (SELECT course_id, hole, x1 AS x, y1 AS y FROM lines_v),
 g AS (SELECT e.course_id, e.hole, f.feature_id, any_value(sqrt((x-cx)*(x-cx)+(y-cy)*(y-cy))) AS d, sum({CROSS})%2=1 AS ins FROM e JOIN feat_v f ON f.course_id=e.course_id AND f.kind='green' JOIN ed ON ed.feature_id=f.feature_id AND ring=0 GROUP BY ALL),
 b AS (SELECT * FROM g WHERE ins OR d<={REACH} QUALIFY row_number() OVER (PARTITION BY course_id, hole ORDER BY ins DESC, CASE WHEN ins THEN 0 ELSE d END, feature_id)=1)"""
GREEN_OF = "SELECT l.course_id, l.hole, b.feature_id AS green_id FROM lines_v l LEFT JOIN b ON b.course_id=l.course_id AND b.hole=l.hole"


@query("green_assign", f"{GREENS} {GREEN_OF}", LN)
def green_assign(d):
    return P.assign_greens(d.view("lines_v"), features(d).filter("kind = 'green'"), DEFAULTS.yards("assign_m"))


@query("orphan_greens", f"{GREENS}, asg AS ({GREEN_OF}) SELECT course_id, feature_id FROM feat_v WHERE kind='green' AND feature_id NOT IN (SELECT green_id FROM asg WHERE green_id IS NOT NULL)", LN)
def orphan_greens(d):
    """J-15: greens of the map that belong to no hole."""
    return P.orphan_greens(features(d).filter("kind = 'green'"), green_assign(d))


@query("course_boundary", f"WITH {EDGES}, en AS (SELECT course_id, x0 AS x, y0 AS y, hole AS o, 0 AS e FROM lines_v UNION ALL SELECT course_id, x1, y1, hole, 1 FROM lines_v), {hits('h', 'en', 'o, e, x, y')} SELECT CAST(-feature_id-1 AS BIGINT) AS course_id, feature_id, CAST(count(*) AS BIGINT) AS ends FROM h WHERE kind='boundary' GROUP BY feature_id", LN)
def course_boundary(d):
    return P.best_boundary(d.view("lines_v"), features(d).filter("kind = 'boundary'"))


@query("hole_by_tee", f"""WITH {EDGES}, st AS (SELECT shot_id, course_id, sx AS x, sy AS y FROM shots_v), {DIST('q', 'st', 'shot_id', '30*1.0936133::DOUBLE')},
 bare AS (SELECT course_id, hole, x0 AS ax, y0 AS ay, x1-x0 AS ux, y1-y0 AS uy, sqrt((x1-x0)*(x1-x0)+(y1-y0)*(y1-y0)) AS l FROM lines_v WHERE NOT EXISTS (SELECT 1 FROM feat_v f WHERE f.course_id=lines_v.course_id AND f.f_hole=lines_v.hole AND f.kind='tee')),
 sg AS (SELECT course_id, hole, ax, ay, ux*p AS vx, uy*p AS vy FROM (SELECT *, greatest(0, least(0.6, (l-100*1.0936133::DOUBLE)/l)) AS p FROM bare)),
 bl AS (SELECT shot_id, hole AS f_hole, sqrt(pow(x-(ax+t*vx),2)+pow(y-(ay+t*vy),2)) AS dd FROM (SELECT *, CASE WHEN vx=0 AND vy=0 THEN 0 ELSE greatest(0, least(1, ((x-ax)*vx+(y-ay)*vy)/(vx*vx+vy*vy))) END AS t FROM st JOIN sg USING (course_id))),
 al AS (SELECT shot_id, f_hole, dd FROM q JOIN feat_v USING (feature_id) WHERE q.kind='tee' UNION ALL SELECT * FROM bl)
SELECT shot_id, f_hole AS hole, {HU('dd', 1)} AS dist FROM al WHERE dd<=30*1.0936133::DOUBLE QUALIFY row_number() OVER (PARTITION BY shot_id ORDER BY dd, f_hole)=1""", (*NEEDS, "lines_v"))
def hole_by_tee(d):
    """P-18: from an unknown hole, the nearest tee within 30 metres of the fix, the start of the line where no tee is mapped."""
    st = d.shots.select("shot_id", "course_id", F.col("sx").alias("x"), F.col("sy").alias("y"))
    h = P.hole_by_tee(st, d.view("lines_v"), features(d).filter("kind = 'tee'"), "shot_id", DEFAULTS.yards("tee_detect_m"))
    return h.select("shot_id", "hole", half_up("dist", 1).alias("dist"))


# ---- greens and fairways seen from shots ----------------------------------------------------------------
def at_green(d):
    g = features(d).filter("kind = 'green'").select("course_id", F.col("f_hole").alias("hole"), "feature_id", "ring", G.centroid("ring").alias("ctr"))
    g = evaluated_once(g)
    return d.shots.select("shot_id", "course_id", "hole", F.col("sx").alias("x"), F.col("sy").alias("y"), "ex", "ey").join(g, ["course_id", "hole"])


AT_GREEN = "z AS (SELECT s.shot_id, f.feature_id, sx AS px, sy AS py, ex, ey, cx, cy, sqrt((cx-sx)*(cx-sx)+(cy-sy)*(cy-sy)) AS c FROM shots_v s JOIN feat_v f ON f.course_id=s.course_id AND f.f_hole=s.hole AND f.kind='green')"


@query("green_distances", f"""WITH {EDGES}, {AT_GREEN}, r AS (SELECT shot_id, z.feature_id, c, (cx-px)/CASE WHEN c>1e-9 THEN c END AS dx, (cy-py)/CASE WHEN c>1e-9 THEN c END AS dy, ax-px AS rx, ay-py AS ry, bx-ax AS ux, bw-ay AS uy FROM z JOIN ed ON ed.feature_id=z.feature_id AND ring=0),
 tu AS (SELECT *, CASE WHEN abs(dx*uy-dy*ux)>=1e-12 THEN (rx*uy-ry*ux)/(dx*uy-dy*ux) END AS tt, CASE WHEN abs(dx*uy-dy*ux)>=1e-12 THEN (rx*dy-ry*dx)/(dx*uy-dy*ux) END AS uu FROM r),
 m AS (SELECT shot_id, feature_id, any_value(c) AS c, min(tt) FILTER (tt>=0 AND uu>=-1e-9 AND uu<=1+1e-9) AS f, max(tt) FILTER (tt>=0 AND uu>=-1e-9 AND uu<=1+1e-9) AS b FROM tu GROUP BY ALL)
SELECT shot_id, feature_id, {HU('coalesce(f, greatest(0, c-12))+1e-7', 1)} AS front, {HU('c+1e-7', 1)} AS center, {HU('coalesce(b, c+12)+1e-7', 1)} AS back FROM m""", NEEDS)
def green_distances(d):
    g = P.green_distances(at_green(d))
    return g.select("shot_id", "feature_id", *[half_up(F.col(f) + 1e-7, 1).alias(f) for f in ("front", "center", "back")])


@query("green_position", f"""WITH {EDGES}, z AS (SELECT s.shot_id, f.feature_id, ex, ey, sx, sy, cx, cy, CASE WHEN cx=sx AND cy=sy THEN 1 ELSE sqrt((cx-sx)*(cx-sx)+(cy-sy)*(cy-sy)) END AS L FROM shots_v s JOIN feat_v f ON f.course_id=s.course_id AND f.f_hole=s.hole AND f.kind='green'),
 w AS (SELECT shot_id, feature_id, max((x-cx)*(cx-sx)/L+(y-cy)*(cy-sy)/L)-min((x-cx)*(cx-sx)/L+(y-cy)*(cy-sy)/L) AS dep, max((x-cx)*(cy-sy)/L-(y-cy)*(cx-sx)/L)-min((x-cx)*(cy-sy)/L-(y-cy)*(cx-sx)/L) AS wid FROM z JOIN ver USING (feature_id) GROUP BY ALL),
 q AS (SELECT z.*, (ex-cx)*(cx-sx)/L+(ey-cy)*(cy-sy)/L AS a, (ex-cx)*(cy-sy)/L-(ey-cy)*(cx-sx)/L AS lt, greatest(1.5,dep/6) AS ta, greatest(1.5,wid/6) AS tl FROM z JOIN w USING (shot_id, feature_id))
SELECT shot_id, feature_id, CASE WHEN a< -ta THEN 'front' WHEN a>ta THEN 'back' ELSE 'middle' END AS v, CASE WHEN lt< -tl THEN 'left' WHEN lt>tl THEN 'right' ELSE '' END AS h FROM q""", NEEDS)
def green_position(d):
    return P.green_position(at_green(d), "ex", "ey", "x", "y").select("shot_id", "feature_id", "v", "h")


@query("pin_clamp", f"""WITH {EDGES}, {AT_GREEN}, t AS (SELECT shot_id, z.feature_id, ex AS x, ey AS y, cx, cy, k, ax, ay, bx, bw, greatest(0, least(1, ((ex-ax)*(bx-ax)+(ey-ay)*(bw-ay))/((bx-ax)*(bx-ax)+(bw-ay)*(bw-ay)))) AS tt FROM z JOIN ed ON ed.feature_id=z.feature_id AND ring=0),
 n AS (SELECT *, ax+tt*(bx-ax) AS qx, ay+tt*(bw-ay) AS qy, {SEGD('x', 'y')} AS d FROM t),
 q AS (SELECT shot_id, feature_id, any_value(x) AS px, any_value(y) AS py, any_value(cx) AS cx, any_value(cy) AS cy, sum({CROSS})%2=1 AS ins, min(d) AS d, arg_min(qx, (d, qx, qy)) AS qx, arg_min(qy, (d, qx, qy)) AS qy FROM n GROUP BY ALL),
 w AS (SELECT *, sqrt((qx-cx)*(qx-cx)+(qy-cy)*(qy-cy)) AS s FROM q WHERE ins OR d<=3),
 st AS (SELECT *, qx+(cx-qx)*i*0.25/nullif(s,0) AS x, qy+(cy-qy)*i*0.25/nullif(s,0) AS y FROM (SELECT *, unnest(range(1, greatest(1, CAST(ceil(s/0.25) AS BIGINT)-1)+1)) AS i FROM w WHERE NOT ins)),
 ok AS (SELECT shot_id, st.feature_id, i, any_value(x) AS x, any_value(y) AS y FROM st JOIN ed ON ed.feature_id=st.feature_id AND ring=0 GROUP BY ALL HAVING sum({CROSS})%2=1),
 b AS (SELECT * FROM ok QUALIFY row_number() OVER (PARTITION BY shot_id, feature_id ORDER BY i)=1)
SELECT shot_id, w.feature_id, {HU('CASE WHEN ins THEN px ELSE coalesce(b.x, cx) END', 4)} AS x, {HU('CASE WHEN ins THEN py ELSE coalesce(b.y, cy) END', 4)} AS y FROM w LEFT JOIN b USING (shot_id, feature_id)""", NEEDS)
def pin_clamp(d):
    """P-27: taps within 3 yards of the green pulled inside it."""
    g = evaluated_once(features(d).filter("kind = 'green'").select("course_id", F.col("f_hole").alias("hole"), "feature_id", "ring", G.centroid("ring").alias("ctr")))
    t = P.near_rings(balls(d), g, 3.0, ["hole"], ["feature_id", "ring", "ctr"])
    c = P.clamp_inside(t.select("shot_id", "feature_id", "ring", "ctr", "x", "y"))
    return c.select("shot_id", "feature_id", half_up("x", 4).alias("x"), half_up("y", 4).alias("y"))


@query("fairway_span", f"""WITH {EDGES}, z AS (SELECT shot_id, f.feature_id, ex AS x, ey AS y FROM shots_v s JOIN feat_v f ON f.course_id=s.course_id AND f.f_hole=s.hole AND f.kind='fairway' AND ey>=cy-ry AND ey<=cy+ry),
 q AS (SELECT shot_id, feature_id, x, ax+(y-ay)*(bx-ax)/(bw-ay) AS cxx FROM z JOIN ed USING (feature_id) WHERE ring=0 AND (ay>y)<>(bw>y)), g AS (SELECT shot_id, feature_id, any_value(x) AS x, min(cxx) AS l, max(cxx) AS r FROM q GROUP BY ALL)
SELECT shot_id, feature_id, {HU('l', 6)} AS left_x, {HU('r', 6)} AS right_x, {HU('CASE WHEN CASE WHEN l<=x AND r>=x THEN 0 ELSE least(abs(l-x),abs(r-x)) END<=40 THEN x+greatest(-40,least(40,(l-x+r-x)/2)) ELSE x END', 6)} AS center_x FROM g""", NEEDS)
def fairway_span(d):
    f = features(d).filter("kind = 'fairway'").select("course_id", F.col("f_hole").alias("hole"), "feature_id", "ring")
    f = evaluated_once(f.withColumns({f"_{k}": v for k, v in G.bbox("ring").items() if k[0] == "y"}))
    j = balls(d).join(f, ["course_id", "hole"]).filter("y BETWEEN _y0 AND _y1")   # other rings do not cross the line
    j = P.fairway_center(evaluated_once(P.corridor(j)).filter("left_x IS NOT NULL"))
    return j.select("shot_id", "feature_id", *[half_up(f, 6).alias(f) for f in ("left_x", "right_x", "center_x")])


@query("safest_spot", f"""WITH {EDGES}, g AS (SELECT course_id, f_hole AS hole, feature_id AS green_id, cx, cy, cx-rx AS x0, cy-ry AS y0, rx, ry FROM feat_v WHERE kind='green'),
 p0 AS (SELECT g.*, x0+i*2.0::DOUBLE AS x, y0+j*2.0::DOUBLE AS y FROM (SELECT *, unnest(range(0, CAST(floor(((cx+rx)-x0)/2) AS BIGINT)+1)) AS i FROM g) g, (SELECT unnest(range(0, 40)) AS j) WHERE y0+j*2.0::DOUBLE<=cy+ry),
 p AS (SELECT course_id, hole, green_id, x, y, any_value(sqrt((x-cx)*(x-cx)+(y-cy)*(y-cy))) AS dc FROM p0 JOIN ed ON ed.feature_id=green_id AND ring=0 GROUP BY ALL HAVING sum({CROSS})%2=1),
 hz AS (SELECT course_id, f_hole AS hole, feature_id AS hid, false AS bd FROM feat_v WHERE kind IN ('sand','water','trees') UNION ALL SELECT DISTINCT g.course_id, g.hole, feature_id, true FROM g JOIN feat_v b ON b.course_id=g.course_id AND b.kind='boundary'),
 t AS (SELECT p.*, hid, bd, ax, ay, bx, bw, greatest(0, least(1, ((x-ax)*(bx-ax)+(y-ay)*(bw-ay))/((bx-ax)*(bx-ax)+(bw-ay)*(bw-ay)))) AS tt FROM p JOIN hz USING (course_id, hole) JOIN ed ON ed.feature_id=hid AND ring=0),
 dd AS (SELECT course_id, hole, green_id, x, y, dc, hid, CASE WHEN NOT bd AND sum({CROSS})%2=1 THEN 0 ELSE min({SEGD('x', 'y')}) END AS d FROM t GROUP BY course_id, hole, green_id, x, y, dc, hid, bd),
 m AS (SELECT course_id, hole, green_id, x, y, dc, min(d) AS d FROM dd GROUP BY ALL),
 b AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY green_id ORDER BY round(d,6) DESC, round(dc,6), y, x)=1)
SELECT g.course_id, g.hole, g.green_id, {HU('coalesce(b.x, cx)', 4)} AS x, {HU('coalesce(b.y, cy)', 4)} AS y, {HU('b.d', 4)} AS d FROM g LEFT JOIN b USING (green_id)""", ("feat_v", "shots_v"))
def safest_spot(d):
    f = features(d)
    s = P.safest_spot(f.filter("kind = 'green'"), f.filter("kind IN ('sand','water','trees')"), f.filter("kind = 'boundary'"))
    return s.select("course_id", "hole", "green_id", half_up("x", 4).alias("x"), half_up("y", 4).alias("y"), half_up("d", 4).alias("d"))


WET = "HAVING bool_or(kind='water') AND NOT bool_or(kind='sand' OR (kind='green' AND f_hole=hole))"


@query("water_entry", f"""WITH {EDGES}, {hits('h', 'bal', 'shot_id, hole, x, y', "kind IN ('water','sand','green')")}, lw AS (SELECT shot_id FROM h GROUP BY shot_id, hole {WET}),
 w AS (SELECT shot_id, course_id, hole, ex, ey, sx, sy, sqrt((ex-sx)*(ex-sx)+(ey-sy)*(ey-sy)) AS l FROM shots_v JOIN lw USING (shot_id)),
 wk AS (SELECT shot_id, course_id, hole, st, ex+(sx-ex)/l*st*2 AS x, ey+(sy-ey)/l*st*2 AS y FROM (SELECT *, unnest(range(1, CAST(floor(l/2) AS BIGINT)+1)) AS st FROM w WHERE l>0)),
 {hits('h2', 'wk', 'shot_id, hole, st, x, y', "kind IN ('water','sand','green')")}, ww AS (SELECT shot_id, st FROM h2 GROUP BY shot_id, st, hole {WET}),
 f AS (SELECT shot_id, min(st) AS k0 FROM wk WHERE NOT EXISTS (SELECT 1 FROM ww WHERE ww.shot_id=wk.shot_id AND ww.st=wk.st) GROUP BY shot_id)
SELECT shot_id, {HU('coalesce(ex+(sx-ex)/nullif(l,0)*k0*2, sx)', 4)} AS x, {HU('coalesce(ey+(sy-ey)/nullif(l,0)*k0*2, sy)', 4)} AS y, CAST(k0 AS INT) AS k0 FROM w LEFT JOIN f USING (shot_id)""", NEEDS)
def water_entry(d):
    w = P.water_entry(d.shots, features(d), "shot_id")
    return w.select("shot_id", half_up("x", 4).alias("x"), half_up("y", 4).alias("y"), "k0")


@query("ellipse_trouble", f"""WITH {EDGES}, e AS (SELECT course_id, CAST(hole AS INT) AS hole, avg(ex) AS cx0, avg(ey) AS cy0 FROM shots_v GROUP BY ALL),
 pts AS (SELECT course_id, hole, k AS kk, cx0+cos(2*pi()*k/48)*25*cos(radians(30))-sin(2*pi()*k/48)*15*sin(radians(30)) AS x, cy0+cos(2*pi()*k/48)*25*sin(radians(30))+sin(2*pi()*k/48)*15*cos(radians(30)) AS y FROM e CROSS JOIN (SELECT unnest(range(0,48)) AS k)),
 {hits('h', 'pts', 'p.course_id, hole, kk, x, y', "kind IN ('sand','water','trees')")} SELECT pts.course_id, pts.hole, {HU('count(DISTINCT h.kk)/48.0::DOUBLE', 6)} AS trouble_share FROM pts LEFT JOIN h ON h.course_id=pts.course_id AND h.hole=pts.hole AND h.kk=pts.kk GROUP BY ALL""", NEEDS)
def ellipse_trouble(d):
    e = d.shots.groupBy("course_id", "hole").agg(F.avg("ex").alias("cx"), F.avg("ey").alias("cy")).withColumn("w", F.lit(50.0)).withColumn("h", F.lit(30.0)).withColumn("tilt", F.lit(30.0))
    r = P.rim(e, 48)
    hit = P.containing(r, features(d).filter("kind IN ('sand','water','trees')")).select("course_id", "hole", "k").distinct().groupBy("course_id", "hole").agg(F.count(F.lit(1)).alias("n"))
    return e.join(hit, ["course_id", "hole"], "left").select("course_id", "hole", half_up(F.coalesce("n", F.lit(0)) / 48.0, 6).alias("trouble_share"))


# ---- votes, elevation, rasters --------------------------------------------------------------------------
VOTES = "v AS (SELECT event_id%5 AS course_id, CAST(CAST(floor(value) AS INT)%200 AS DOUBLE) AS xm, CAST(event_id%211 AS DOUBLE) AS ym, CASE event_type WHEN 'click' THEN 'rough' WHEN 'view' THEN 'fairway' WHEN 'error' THEN 'sand' ELSE 'tee' END AS corrected, event_id AS t_s FROM events)"


def votes(d):
    return d.events.select((F.col("event_id") % 5).alias("course_id"), (F.floor("value").cast("int") % 200).cast("double").alias("xm"), (F.col("event_id") % 211).cast("double").alias("ym"),
                           F.when(F.col("event_type") == "click", "rough").when(F.col("event_type") == "view", "fairway").when(F.col("event_type") == "error", "sand").otherwise("tee").alias("corrected"), F.col("event_id").alias("t_s"))


VOTE_SQL = f"""WITH {VOTES}, q AS (SELECT DISTINCT course_id, xm AS qx, ym AS qy FROM v), j AS (SELECT q.*, v.* EXCLUDE (course_id) FROM q JOIN v ON v.course_id=q.course_id AND abs(xm-qx)<=15 AND abs(ym-qy)<=15 AND (xm-qx)*(xm-qx)+(ym-qy)*(ym-qy)<=225),
 m AS (SELECT course_id, qx, qy, corrected, t_s, EXISTS (SELECT 1 FROM j b WHERE b.course_id=a.course_id AND b.qx=a.qx AND b.qy=a.qy AND b.corrected=a.corrected AND b.t_s<>a.t_s AND (b.xm-a.xm)*(b.xm-a.xm)+(b.ym-a.ym)*(b.ym-a.ym)<=225) AS mate FROM j a)"""


@query("lie_override_vote", VOTE_SQL + """, g AS (SELECT course_id, qx, qy, corrected, count(*) AS n, max(t_s) AS t FROM m GROUP BY ALL HAVING count(*)>=2 AND bool_or(mate))
SELECT course_id, qx, qy, corrected AS lie, CAST(n AS BIGINT) AS votes FROM g QUALIFY row_number() OVER (PARTITION BY course_id, qx, qy ORDER BY n DESC, t DESC)=1""")
def lie_override_vote(d):
    return P.override_vote(votes(d), votes(d))


@query("lie_override_strict", VOTE_SQL + """, g AS (SELECT course_id, qx, qy, corrected, count(*) AS n, max(t_s) AS t FROM m WHERE mate GROUP BY ALL HAVING count(*)>=2)
SELECT course_id, qx, qy, corrected AS lie, CAST(n AS BIGINT) AS votes FROM g QUALIFY row_number() OVER (PARTITION BY course_id, qx, qy ORDER BY n DESC, t DESC)=1""")
def lie_override_strict(d):
    return P.override_vote(votes(d), votes(d), strict=True)


@query("idw_elevation", f"""WITH q AS (SELECT point_id, x+3 AS qx, y-2 AS qy FROM points_v), r AS (SELECT q.point_id, z, sqrt((qx-x)*(qx-x)+(qy-y)*(qy-y)) AS d, row_number() OVER (PARTITION BY q.point_id ORDER BY sqrt((qx-x)*(qx-x)+(qy-y)*(qy-y)), s.point_id) AS rn FROM q CROSS JOIN points_v s)
SELECT point_id, {HU('CASE WHEN min(d)<1 THEN arg_min(z, d) ELSE sum(z/(d*d))/sum(1/(d*d)) END', 5)} AS z FROM r WHERE rn<=4 GROUP BY point_id""", ("points_v",))
def idw_elevation(d):
    q = d.points.select("point_id", (F.col("x") + 3).alias("x"), (F.col("y") - 2).alias("y"))
    s = d.points.select("x", "y", "z", F.col("point_id").alias("ord"))
    return P.idw(q, s, "point_id").select("point_id", half_up("z", 5).alias("z"))


@query("sample_crop", """WITH h AS (SELECT course_id, hole, least(x0,x1)-120 AS xa, greatest(x0,x1)+120 AS xb, least(y0,y1)-80 AS ya, greatest(y0,y1)+80 AS yb FROM lines_v) SELECT course_id, hole, CAST(count(*) AS BIGINT) AS n FROM h JOIN points_v ON label%20=course_id AND x BETWEEN xa AND xb AND y BETWEEN ya AND yb GROUP BY ALL""", ("lines_v", "points_v"))
def sample_crop(d):
    """P-23: elevation samples of a course inside the box round a hole."""
    h = d.view("lines_v").select("course_id", "hole", (F.least("x0", "x1") - 120).alias("xa"), (F.greatest("x0", "x1") + 120).alias("xb"), (F.least("y0", "y1") - 80).alias("ya"), (F.greatest("y0", "y1") + 80).alias("yb"))
    p = d.points.withColumn("course_id", (F.col("label") % 20).cast("bigint"))
    return p.join(h, "course_id").filter("x BETWEEN xa AND xb AND y BETWEEN ya AND yb").groupBy("course_id", "hole").agg(F.count(F.lit(1)).alias("n"))


RB = "rb AS (SELECT CAST(floor(x/10) AS BIGINT) AS i, CAST(floor(y/10) AS BIGINT) AS j, max(z) AS max_z, min(z) AS min_z, count(*) AS n, count(*) FILTER (label%3=0) AS veg, count(*) FILTER (label%3=1) AS bld FROM points_v WHERE label%11<>7 GROUP BY ALL)"


def raster(d):
    return T.bin_points(d.points, 10.0, {"veg": F.col("label") % 3 == 0, "bld": F.col("label") % 3 == 1}, F.col("label") % 11 == 7)


@query("raster_bin", f"WITH {RB} SELECT i, j, {HU('max_z', 6)} AS max_z, CAST(n AS BIGINT) AS n, CAST(veg AS BIGINT) AS veg, CAST(bld AS BIGINT) AS bld FROM rb", ("points_v",))
def raster_bin(d):
    return raster(d).select("i", "j", half_up("max_z", 6).alias("max_z"), "n", "veg", "bld")


@query("canopy_mask", f"WITH {RB}, gr AS (SELECT CAST(floor(x/10) AS BIGINT) AS i, CAST(floor(y/10) AS BIGINT) AS j, min(z) AS ground FROM points_v GROUP BY ALL) SELECT i, j, CAST(veg AS BIGINT) AS veg FROM rb JOIN gr USING (i, j) WHERE max_z-ground>1 AND veg>=bld AND veg>0", ("points_v",))
def canopy_mask(d):
    g = d.points.groupBy(F.floor(F.col("x") / 10).alias("i"), F.floor(F.col("y") / 10).alias("j")).agg(F.min("z").alias("ground"))
    return T.canopy(raster(d), g, 1.0).select("i", "j", "veg")


@query("zonal_shift", f"""WITH {EDGES}, {RB}, pc0 AS (SELECT f.course_id, i, j, f.feature_id AS fid, (i+0.5::DOUBLE)*10 AS x, (j+0.5::DOUBLE)*10 AS y FROM feat_v f, (SELECT unnest(range(-30,45)) AS i) CROSS JOIN (SELECT unnest(range(-30,45)) AS j) WHERE f.kind='sand' AND (i+0.5::DOUBLE)*10 BETWEEN cx-rx AND cx+rx AND (j+0.5::DOUBLE)*10 BETWEEN cy-ry AND cy+ry),
 pc AS (SELECT pc0.course_id, fid, i, j FROM pc0 JOIN ed ON ed.feature_id=fid AND ring=0 GROUP BY ALL HAVING sum({CROSS})%2=1),
 g AS (SELECT course_id, fid, di, dj, avg(max_z) AS m FROM pc CROSS JOIN (SELECT unnest(range(-2,3)) AS di) CROSS JOIN (SELECT unnest(range(-2,3)) AS dj) JOIN rb ON rb.i=pc.i+di AND rb.j=pc.j+dj GROUP BY ALL)
SELECT course_id, fid AS feature_id, {HU('max(CASE WHEN di=0 AND dj=0 THEN m END)', 5)} AS as_traced, {HU('min(m)', 5)} AS best FROM g GROUP BY ALL""", ("feat_v", "points_v", "shots_v"))
def zonal_shift(d):
    z = T.zonal_shift(features(d).filter("kind = 'sand'"), raster(d).withColumn("relief", F.col("max_z")), 10.0, 2)
    return z.select("course_id", "feature_id", half_up("as_traced", 5).alias("as_traced"), half_up("best", 5).alias("best"))


CELLS = "ce AS (SELECT CAST(floor(x/20) AS BIGINT) AS i, CAST(floor(y/20) AS BIGINT) AS j, avg(z) AS z FROM points_v GROUP BY ALL), cc AS (SELECT i, j, (i+0.5::DOUBLE)*20 AS x, (j+0.5::DOUBLE)*20 AS y, floor(z*1000+0.5)/1000 AS z FROM ce)"
PLANE = f"""{CELLS}, nb AS (SELECT c.i, c.j, n.x-c.x AS x, n.y-c.y AS y, n.z FROM cc c JOIN cc n ON abs(n.i-c.i)<=2 AND abs(n.j-c.j)<=2), mo AS (SELECT i, j, count(*) AS n, sum(x*x)-sum(x)*sum(x)/count(*) AS sxx, sum(y*y)-sum(y)*sum(y)/count(*) AS syy, sum(x*y)-sum(x)*sum(y)/count(*) AS sxy, sum(x*z)-sum(x)*sum(z)/count(*) AS sxz, sum(y*z)-sum(y)*sum(z)/count(*) AS syz FROM nb GROUP BY ALL HAVING count(*)>=9),
 pl AS (SELECT i, j, n, (sxz*syy-syz*sxy)/(sxx*syy-sxy*sxy) AS b, (syz*sxx-sxz*sxy)/(sxx*syy-sxy*sxy) AS c FROM mo WHERE abs(sxx*syy-sxy*sxy)>=1e-9)"""


def cells(d):
    g = d.points.groupBy(F.floor(F.col("x") / 20).alias("i"), F.floor(F.col("y") / 20).alias("j")).agg(F.avg("z").alias("z"))
    return g.select("i", "j", ((F.col("i") + 0.5) * 20).alias("x"), ((F.col("j") + 0.5) * 20).alias("y"), half_up("z", 3).alias("z"))


@query("plane_fit", f"WITH {PLANE} SELECT i, j, CAST(n AS BIGINT) AS n, {HU('sqrt(b*b+c*c)/0.9144*100+1e-9', 5)} AS slope_pct, {HU('degrees(atan2(-b,-c))+360-360*floor((degrees(atan2(-b,-c))+360)/360)+1e-9', 3)} AS downhill FROM pl", ("points_v",))
def plane_fit(d):
    p = T.planes(cells(d))
    pct, deg = T.slope(F.col("b"), F.col("c"))
    return p.select("i", "j", "n", half_up(pct + 1e-9, 5).alias("slope_pct"), half_up(deg + 1e-9, 3).alias("downhill"))


# every course has two grids: the raster at 2 yards a cell, moved to a place of its own
GRIDS = f"""{CELLS}, gr AS (SELECT course_id, k AS grid_id, CAST((course_id*37+k*90)%200-100 AS DOUBLE) AS gx, CAST((course_id*53+k*130)%380 AS DOUBLE) AS gy FROM (SELECT DISTINCT course_id FROM feat_v), (SELECT unnest([0,1]) AS k)),
 gn AS (SELECT course_id, feature_id AS green_id, f_hole, cx, cy FROM feat_v WHERE kind='green'),
 gg AS (SELECT course_id, green_id, grid_id, sqrt((gx-cx)*(gx-cx)+(gy-cy)*(gy-cy)) AS d, row_number() OVER (PARTITION BY green_id ORDER BY sqrt((gx-cx)*(gx-cx)+(gy-cy)*(gy-cy)), grid_id) AS rn FROM gn JOIN gr USING (course_id) WHERE sqrt((gx-cx)*(gx-cx)+(gy-cy)*(gy-cy))<=25)"""


def greens(d):
    f = features(d).filter("kind = 'green'")
    at = d.view("feat_v").select("feature_id", "cx", "cy")
    return f.join(at, "feature_id").select("course_id", F.col("feature_id").alias("green_id"), "f_hole", F.col("cx").alias("x"), F.col("cy").alias("y"), "ring")


def grids(d):
    g = d.view("feat_v").select("course_id").distinct().withColumn("grid_id", F.explode(F.array(F.lit(0), F.lit(1))))
    c, k = F.col("course_id"), F.col("grid_id")
    return g.select("course_id", "grid_id", ((c * 37 + k * 90) % 200 - 100).cast("double").alias("gx"), ((c * 53 + k * 130) % 380).cast("double").alias("gy"))


@query("grid_for_green", f"WITH {GRIDS} SELECT course_id, green_id, CAST(grid_id AS INT) AS grid_id, {HU('d', 6)} AS dist FROM gg WHERE rn=1", ("feat_v", "points_v"))
def grid_for_green(d):
    """P-28: the grid under each green."""
    return R.grid_for_green(greens(d), grids(d)).select("course_id", "green_id", "grid_id", half_up("dist", 6).alias("dist"))


@query("putt_read", f"""WITH {EDGES}, {GRIDS}, gc AS (SELECT green_id, i, j, gx+(i+0.5::DOUBLE)*2 AS x, gy+(j+0.5::DOUBLE)*2 AS y, z FROM gg JOIN gr USING (course_id, grid_id) CROSS JOIN cc WHERE rn=1),
 gd AS (SELECT gc.*, ax, ay, bx, bw, greatest(0, least(1, ((x-ax)*(bx-ax)+(y-ay)*(bw-ay))/((bx-ax)*(bx-ax)+(bw-ay)*(bw-ay)))) AS tt FROM gc JOIN ed ON ed.feature_id=green_id AND ring=0),
 og AS (SELECT green_id, i, j, x, y, z FROM gd GROUP BY ALL HAVING sum({CROSS})%2=1 OR min({SEGD('x', 'y')})<=1),
 nb AS (SELECT c.green_id, c.i, c.j, n.x-c.x AS x, n.y-c.y AS y, n.z FROM gc c JOIN og n ON n.green_id=c.green_id AND abs(n.i-c.i)<=2 AND abs(n.j-c.j)<=2),
 mo AS (SELECT green_id, i, j, count(*) AS n, sum(x*x)-sum(x)*sum(x)/count(*) AS sxx, sum(y*y)-sum(y)*sum(y)/count(*) AS syy, sum(x*y)-sum(x)*sum(y)/count(*) AS sxy, sum(x*z)-sum(x)*sum(z)/count(*) AS sxz, sum(y*z)-sum(y)*sum(z)/count(*) AS syz FROM nb GROUP BY ALL HAVING count(*)>=9),
 pl AS (SELECT green_id, i, j, (sxz*syy-syz*sxy)/(sxx*syy-sxy*sxy) AS b, (syz*sxx-sxz*sxy)/(sxx*syy-sxy*sxy) AS c FROM mo WHERE abs(sxx*syy-sxy*sxy)>=1e-9),
 pu AS (SELECT shot_id, green_id, cx+shot_id%9-4 AS bx0, cy+shot_id%7-3 AS by0, cx+shot_id%5-2 AS px, cy+shot_id%11-5 AS py FROM shots_v s JOIN gn ON gn.course_id=s.course_id AND gn.f_hole%3+1=s.hole WHERE shot_type='putt'),
 pn AS (SELECT *, sqrt((px-bx0)*(px-bx0)+(py-by0)*(py-by0)) AS l FROM pu), ps AS (SELECT *, greatest(2, CAST(ceil(l) AS BIGINT)) AS n FROM pn WHERE l>=0.5),
 sm AS (SELECT shot_id, green_id, bx0, by0, px, py, l, t, bx0+(px-bx0)*t/n AS x, by0+(py-by0)*t/n AS y FROM (SELECT *, unnest(range(0, n+1)) AS t FROM ps)),
 nr AS (SELECT sm.shot_id, sm.green_id, bx0, by0, px, py, l, t, gc.i, gc.j, row_number() OVER (PARTITION BY sm.shot_id, sm.green_id, t ORDER BY round(sqrt(pow(gc.x-sm.x,2)+pow(gc.y-sm.y,2)),9), gc.i, gc.j) AS rn FROM sm JOIN gc ON gc.green_id=sm.green_id AND round(sqrt(pow(gc.x-sm.x,2)+pow(gc.y-sm.y,2)),9)<=4),
 rd AS (SELECT nr.shot_id, nr.green_id, bx0, by0, px, py, l, avg(b) AS b, avg(c) AS c FROM nr JOIN pl ON pl.green_id=nr.green_id AND pl.i=nr.i AND pl.j=nr.j WHERE nr.rn=1 GROUP BY ALL HAVING count(*)>=2),
 pc AS (SELECT *, floor((b*(px-bx0)/l+c*(py-by0)/l)/0.9144*1000+0.5+1e-9)/10 AS al, floor((b*(py-by0)/l-c*(px-bx0)/l)/0.9144*1000+0.5+1e-9)/10 AS ac FROM rd)
SELECT shot_id, green_id, al AS along_pct, ac AS across_pct, CASE WHEN abs(al)<0.3 THEN 'Level' ELSE CASE WHEN al>0 THEN 'Uphill ' ELSE 'Downhill ' END || printf('%.1f', abs(al)) || '%' END || ' · ' ||
 CASE WHEN abs(ac)<0.3 THEN 'straight' ELSE 'breaks ' || CASE WHEN ac>0 THEN 'right to left ' ELSE 'left to right ' END || printf('%.1f', abs(ac)) || '%' END AS words FROM pc""", ("feat_v", "points_v", "shots_v"))
def putt_read(d):
    """A-32 on the grids of P-28: every putt on each green of its hole that has a grid."""
    g = greens(d)
    found = R.grid_for_green(g, grids(d)).join(grids(d), ["course_id", "grid_id"])
    # a few bytes of a green become hundreds of cells, which tasks merged by bytes would keep in one
    dealt = found.select("green_id", "gx", "gy").repartition(int(d.spark.conf.get("spark.sql.shuffle.partitions")), "green_id")
    c = dealt.crossJoin(cells(d).select("i", "j", "z"))   # input: each grid is the raster, moved
    c = c.select("green_id", "i", "j", (F.col("gx") + (F.col("i") + 0.5) * 2).alias("x"), (F.col("gy") + (F.col("j") + 0.5) * 2).alias("y"), "z")
    near = g.join(found.select("green_id"), "green_id", "left_semi")   # a putt reads nothing on a green without a grid
    p = d.shots.filter("shot_type = 'putt'").join(near.select("course_id", (F.col("f_hole") % 3 + 1).alias("hole"), "green_id", "x", "y"), ["course_id", "hole"])
    k = F.col("shot_id")
    p = p.select("shot_id", "green_id", (F.col("x") + k % 9 - 4).alias("bx"), (F.col("y") + k % 7 - 3).alias("by"), (F.col("x") + k % 5 - 2).alias("px"), (F.col("y") + k % 11 - 5).alias("py"))
    return R.putt_read(p, c, g, "shot_id", 2.0)


# the card of every hole: six names, one of them twice, two combinations, one without a yardage
add_view("cards_v", """SELECT course_id, hole, c.ord, c.name, CAST(floor(sqrt((x1-x0)*(x1-x0)+(y1-y0)*(y1-y0))) AS INT) + c.more AS yards FROM lines_v
 CROSS JOIN (VALUES (1, 'Gold ', 31), (2, 'Blue', 12), (3, 'Blue/White', 2), (4, ' blue', 40), (5, 'White', -14), (6, 'Combo', -20), (7, 'Red', -44), (8, 'Green', CAST(NULL AS INT))) AS c(ord, name, more)""", ("lines_v",))


@query("tee_boxes", """WITH h AS (SELECT course_id, hole, x0, y0, (x0+x1)/2+15 AS mx, (y0+y1)/2 AS my, x1, y1, x1+3 AS gx, y1+5 AS gy FROM lines_v), b AS (SELECT f.course_id, f.feature_id, f.f_hole AS hole, cx, cy, h.* EXCLUDE (course_id, hole) FROM feat_v f LEFT JOIN h ON h.course_id=f.course_id AND h.hole=f.f_hole WHERE f.kind='tee'),
 t AS (SELECT *, sqrt((mx-x0)*(mx-x0)+(my-y0)*(my-y0)) AS l1, sqrt((x1-mx)*(x1-mx)+(y1-my)*(y1-my)) AS l2, greatest(0,least(1,((cx-x0)*(mx-x0)+(cy-y0)*(my-y0))/((mx-x0)*(mx-x0)+(my-y0)*(my-y0)))) AS t1, greatest(0,least(1,((cx-mx)*(x1-mx)+(cy-my)*(y1-my))/((x1-mx)*(x1-mx)+(y1-my)*(y1-my)))) AS t2 FROM b),
 o AS (SELECT *, sqrt(pow(cx-x0-t1*(mx-x0),2)+pow(cy-y0-t1*(my-y0),2)) AS o1, sqrt(pow(cx-mx-t2*(x1-mx),2)+pow(cy-my-t2*(y1-my),2)) AS o2 FROM t),
 y AS (SELECT course_id, feature_id, hole, CASE WHEN gx IS NOT NULL THEN l1+l2-CASE WHEN o2<o1-1e-12 THEN l1+t2*l2 ELSE t1*l1 END+CASE WHEN o2>=o1-1e-12 AND t1=0 THEN o1 ELSE 0 END+sqrt((gx-x1)*(gx-x1)+(gy-y1)*(gy-y1)) END AS yards FROM o),
 ct AS (SELECT course_id, hole, trim(name) AS name, yards AS ty FROM cards_v WHERE yards>0 AND NOT regexp_matches(lower(name), '/|combo|hybrid|mixed') QUALIFY row_number() OVER (PARTITION BY course_id, hole, lower(trim(name)) ORDER BY ord)=1),
 r AS (SELECT y.*, ct.name, row_number() OVER (PARTITION BY y.feature_id ORDER BY round(abs(ty-y.yards),9), ty DESC) AS rn FROM y LEFT JOIN ct ON ct.course_id=y.course_id AND ct.hole=y.hole AND round(abs(ct.ty-y.yards),9)<=20)
SELECT course_id, feature_id, hole, floor(yards*10000+0.5+1e-6)/10000 AS yards, name FROM r WHERE rn=1""", ("feat_v", "cards_v"))
def tee_boxes(d):
    """P-13: every tee box of the map, named off the card of its hole."""
    ln = d.view("lines_v")
    x = lambda k: F.col(k)
    holes = ln.select("course_id", "hole", F.array(G.pt("x0", "y0"), G.pt((x("x0") + x("x1")) / 2 + 15, (x("y0") + x("y1")) / 2), G.pt("x1", "y1")).alias("line"), (x("x1") + 3).alias("gx"), (x("y1") + 5).alias("gy"))
    boxes = features(d).filter("kind = 'tee'").select("course_id", "feature_id", F.col("f_hole").alias("hole"), "ring")
    t = B.name_tee_boxes(boxes, holes, d.view("cards_v"))
    return t.select("course_id", "feature_id", "hole", (F.floor(F.col("yards") * 10000 + 0.5 + 1e-6) / 10000).alias("yards"), "name")


LATLNG = "34+{y}*0.00001::DOUBLE AS lat, -84+{x}*0.00001::DOUBLE AS lng"


@query("sample_points", f"""WITH {EDGES}, e AS (SELECT course_id, 34+y0*0.00001::DOUBLE AS la, -84+x0*0.00001::DOUBLE AS lo, 34+y1*0.00001::DOUBLE AS lb, -84+x1*0.00001::DOUBLE AS lp FROM lines_v),
 n AS (SELECT *, greatest(1, CAST(floor(sqrt(pow((lp-lo)*cos(radians(la)),2)+pow(lb-la,2))*pi()/180*6371008.8::DOUBLE/20+0.5) AS BIGINT)) AS n FROM e),
 a AS (SELECT course_id, la+(lb-la)*k/n AS lat, lo+(lp-lo)*k/n AS lng, 0 AS src FROM (SELECT *, unnest(range(0, n)) AS k FROM n) UNION ALL SELECT course_id, lb, lp, 0 FROM e
  UNION ALL SELECT course_id, {LATLNG.format(x='cx', y='cy')}, 1 FROM feat_v WHERE kind='green'
  UNION ALL SELECT f.course_id, {LATLNG.format(x='x', y='y')}, 2 FROM feat_v f JOIN ver ON ver.feature_id=f.feature_id AND ver.ring=0 AND k%2=0 WHERE f.kind='green'
  UNION ALL SELECT f.course_id, avg(34+y*0.00001::DOUBLE), avg(-84+x*0.00001::DOUBLE), 3 FROM feat_v f JOIN ver ON ver.feature_id=f.feature_id AND ver.ring=0 WHERE f.kind IN ('fairway','tee') GROUP BY f.course_id, f.feature_id)
SELECT course_id, {HU('lat+3e-10', 5)} AS lat, {HU('lng+3e-10', 5)} AS lng, CASE min(src) WHEN 0 THEN 'line' WHEN 1 THEN 'green' WHEN 2 THEN 'edge' ELSE 'feature' END AS source FROM a GROUP BY course_id, {HU('lat+3e-10', 5)}, {HU('lng+3e-10', 5)}""", ("feat_v", "lines_v", "shots_v"))
def sample_points(d):
    """P-17: the heights to fetch for every course; a yard of the map is read as a hundred-thousandth of a degree."""
    nudge = 3e-10   # places that stand on a rounding edge
    put = lambda p: F.struct((-84 + p["x"] * 0.00001 + nudge).alias("x"), (34 + p["y"] * 0.00001 + nudge).alias("y"))
    f = features(d).withColumn("ring", F.transform("ring", put))
    ln = d.view("lines_v").select("course_id", F.transform(F.array(G.pt("x0", "y0"), G.pt("x1", "y1")), put).alias("line"))
    mid = d.view("feat_v").filter("kind = 'green'").select("feature_id", put({"x": F.col("cx"), "y": F.col("cy")}).alias("p"))
    g = f.join(mid, "feature_id").select("course_id", "p.x", "p.y", "ring")
    return B.sample_points(ln, g, f, 20.0)


@query("landing_dots", f"""WITH {EDGES}, op AS (SELECT o.player_id, o.club, l.course_id, l.hole, x0, y0, x1, y1, sqrt((x1-x0)*(x1-x0)+(y1-y0)*(y1-y0)) AS l FROM (SELECT DISTINCT player_id, club FROM shots_v) o JOIN lines_v l ON l.course_id=o.player_id%20 AND l.hole%6=length(o.club)),
 dt AS (SELECT o.player_id, o.club, s.shot_id, o.course_id, o.hole, x1+(y1-y0)/l*lat_miss_yds+(x1-x0)/l*dist_miss_yds AS x, y1-(x1-x0)/l*lat_miss_yds+(y1-y0)/l*dist_miss_yds AS y FROM shots_v s JOIN op o ON o.player_id=s.player_id AND o.club=s.club),
 {hits('h', 'dt', 'player_id, club, shot_id, p.course_id, hole, x, y')}, s AS (SELECT shot_id, course_id, hole, min({RANK}) AS p, max(CASE WHEN kind='boundary' THEN 1 ELSE 0 END) AS b FROM h GROUP BY ALL),
 sf AS (SELECT dt.*, CASE WHEN coalesce(p,8)=8 AND dt.course_id%2=0 AND coalesce(b,0)=0 THEN 7 ELSE coalesce(p,8) END AS p FROM dt LEFT JOIN s ON s.shot_id=dt.shot_id AND s.course_id=dt.course_id AND s.hole=dt.hole)
SELECT player_id, club, course_id, hole, CASE WHEN p IN (1,4,5) THEN 'fairway' WHEN p=8 THEN 'rough' ELSE 'trouble' END AS tone, CAST(count(*) AS BIGINT) AS n FROM sf GROUP BY ALL""", ("feat_v", "shots_v", "lines_v"))
def landing_dots(d):
    """P-22: each player's shots with a club, put round the ends of the holes played with it."""
    dots = d.shots.select("player_id", "club", "shot_id", F.col("lat_miss_yds").alias("sx"), (-F.col("dist_miss_yds")).alias("sy"))
    own = d.shots.select("player_id", "club").distinct()
    ln = d.view("lines_v").select("course_id", "hole", F.col("x0").alias("ball_x"), F.col("y0").alias("ball_y"), F.col("x1").alias("target_x"), F.col("y1").alias("target_y"))
    t = own.join(ln, (F.col("course_id") == F.col("player_id") % 20) & (F.col("hole") % 6 == F.length("club")))
    return P.dot_tones(dots, t, features(d), ["player_id", "club"], bounded(d))


RLE = "c AS (SELECT DISTINCT l_suppkey AS j, l_linenumber + (l_partkey%5)*8 AS i FROM lineitem), g AS (SELECT *, i-row_number() OVER (PARTITION BY j ORDER BY i) AS gr FROM c)"


def grid_rows(d):
    c = d.lineitem.select(F.col("l_suppkey").alias("j"), (F.col("l_linenumber") + F.col("l_partkey") % 5 * 8).alias("i")).distinct().withColumn("v", (F.col("i") * 3 + F.col("j")) % 17)
    return T.rle_encode(c, ["j"], "i", "v")


@query("rle_encode", f"WITH {RLE} SELECT j, min(i) AS i0, string_agg(CAST((i*3+j)%17 AS VARCHAR), ',' ORDER BY i) AS ds FROM g GROUP BY j, gr")
def rle_encode(d):
    return grid_rows(d).select("j", "i0", F.array_join(F.transform("ds", lambda v: v.cast("string")), ",").alias("ds"))


@query("rle_decode", f"WITH {RLE} SELECT j, i, (1000+(i*3+j)%17)/10.0::DOUBLE AS value FROM c")
def rle_decode(d):
    return T.rle_decode(grid_rows(d), ["j"], F.lit(1000), 10.0)


# ---- positions ------------------------------------------------------------------------------------------
@query("hole_frame", f"""WITH k AS (SELECT *, radians(CAST(event_id%360 AS DOUBLE)) AS b, radians(1.0::DOUBLE)*6371008.8::DOUBLE*1.0936133::DOUBLE AS u FROM gps_v), e AS (SELECT *, (lng+84.4)*u*cos(radians(34.2::DOUBLE)) AS ea, (lat-34.2)*u AS no FROM k)
SELECT event_id, {HU('ea*cos(b)-no*sin(b)', 4)} AS x, {HU('ea*sin(b)+no*cos(b)', 4)} AS y, {HU('lat', 7)} AS lat_back, {HU('lng', 7)} AS lng_back FROM e""", ("gps_v",))
def hole_frame(d):
    b = (F.col("event_id") % 360).cast("double")
    x, y = geo.to_frame("lat", "lng", F.lit(34.2), F.lit(-84.4), b)
    f = d.gps.withColumn("x", x).withColumn("y", y)
    la, ln = geo.from_frame("x", "y", F.lit(34.2), F.lit(-84.4), b)
    return f.select("event_id", half_up("x", 4).alias("x"), half_up("y", 4).alias("y"), half_up(la, 7).alias("lat_back"), half_up(ln, 7).alias("lng_back"))


@query("geo_points", f"""WITH d AS (SELECT *, radians(lat-34.2::DOUBLE) AS dla, radians(lng+84.4::DOUBLE) AS dlo, radians(34.2::DOUBLE) AS a, radians(lat) AS b FROM gps_v), h AS (SELECT *, 2*6371008.8::DOUBLE*asin(least(1,sqrt(pow(sin(dla/2),2)+cos(a)*cos(b)*pow(sin(dlo/2),2)))) AS m, degrees(atan2(sin(dlo)*cos(b), cos(a)*sin(b)-sin(a)*cos(b)*cos(dlo))) AS br FROM d)
SELECT event_id, {HU('m', 4)} AS metres, CASE WHEN m>0.01 THEN {HU('br+360-360*floor((br+360)/360)', 3)} END AS bearing, {HU('degrees(asin(sin(a)*cos(100/6371008.8::DOUBLE)+cos(a)*sin(100/6371008.8::DOUBLE)*cos(radians(CAST(event_id%360 AS DOUBLE)))))', 8)} AS dest_lat FROM h""", ("gps_v",))
def geo_points(d):
    m = geo.haversine_m(F.lit(34.2), F.lit(-84.4), "lat", "lng")
    br = geo.bearing_deg(F.lit(34.2), F.lit(-84.4), "lat", "lng")
    dl = geo.dest_lat(F.lit(34.2), (F.col("event_id") % 360).cast("double"), F.lit(100.0))
    return d.gps.select("event_id", half_up(m, 4).alias("metres"), F.when(m > 0.01, half_up(br, 3)).alias("bearing"), half_up(dl, 8).alias("dest_lat"))


@query("sql_functions", ORACLES["geo_points"].replace("AS dest_lat FROM h", "AS dest_lat, floor(m*1.0936133::DOUBLE+0.5) AS yards FROM h"))
def sql_functions(d):
    """The functions of section 2.11 in SQL text."""
    registered.register(d.spark)
    return d.spark.sql("""WITH g AS (SELECT event_id, haversine_m(34.2, -84.4, lat, lng) AS m, bearing_deg(34.2, -84.4, lat, lng) AS b FROM {gps})
        SELECT event_id, half_up(m, 4) AS metres, CASE WHEN m > 0.01 THEN half_up(b, 3) END AS bearing, half_up(dest_lat(34.2, event_id % 360, 100), 8) AS dest_lat, half_up(yards(m), 0) AS yards FROM g""", gps=d.gps)


@query("shot_length", f"""WITH p AS (SELECT *, lead(lat) OVER w AS la2, lead(lng) OVER w AS ln2 FROM gps_v WINDOW w AS (PARTITION BY player_id, CAST(ts AS DATE) ORDER BY ts, event_id)), h AS (SELECT *, 2*6371008.8::DOUBLE*asin(least(1,sqrt(pow(sin(radians(la2-lat)/2),2)+cos(radians(lat))*cos(radians(la2))*pow(sin(radians(ln2-lng)/2),2)))) AS m FROM p)
SELECT event_id, CASE WHEN m IS NOT NULL THEN floor(m*1.0936133::DOUBLE+0.5) ELSE floor(sqrt(144.0::DOUBLE+pow(CAST(acc_m AS DOUBLE),2))+0.5) END AS yds FROM h""", ("gps_v",))
def shot_length(d):
    from pyspark.sql import Window
    w = Window.partitionBy("player_id", F.to_date("ts")).orderBy("ts", "event_id")
    g = d.gps.withColumn("la2", F.lead("lat").over(w)).withColumn("ln2", F.lead("lng").over(w))
    return g.select("event_id", S.shot_length("lat", "lng", "la2", "ln2", F.lit(0.0), F.lit(0.0), F.lit(12.0), F.col("acc_m").cast("double")).alias("yds"))


@query("map_tiles", """WITH b AS (SELECT player_id, min(lat) AS s, max(lat) AS n, min(lng) AS w, max(lng) AS e FROM gps_v GROUP BY player_id), z AS (SELECT * FROM b CROSS JOIN (VALUES (15),(16),(17),(18)) t(z)),
 t AS (SELECT player_id, z, CAST(floor((w+180)/360*pow(2,z)) AS BIGINT) AS xa, CAST(floor((e+180)/360*pow(2,z)) AS BIGINT) AS xb, CAST(floor((1-ln(tan(radians(n))+1/cos(radians(n)))/pi())/2*pow(2,z)) AS BIGINT) AS ya, CAST(floor((1-ln(tan(radians(s))+1/cos(radians(s)))/pi())/2*pow(2,z)) AS BIGINT) AS yb FROM z),
 u AS (SELECT player_id, z, unnest(range(xa, xb+1)) AS tx, ya, yb FROM t) SELECT player_id, CAST(z AS INT) AS zoom, tx, unnest(range(ya, yb+1)) AS ty FROM u""", ("gps_v",))
def map_tiles(d):
    b = d.gps.groupBy("player_id").agg(F.min("lat").alias("s"), F.max("lat").alias("n"), F.min("lng").alias("w"), F.max("lng").alias("e"))
    b = b.withColumn("zoom", F.explode(F.array(*[F.lit(z) for z in (15, 16, 17, 18)])))
    b = b.withColumn("tx", F.explode(F.sequence(geo.tile_x("w", "zoom"), geo.tile_x("e", "zoom"))))
    return b.withColumn("ty", F.explode(F.sequence(geo.tile_y("n", "zoom"), geo.tile_y("s", "zoom")))).select("player_id", "zoom", "tx", "ty")
