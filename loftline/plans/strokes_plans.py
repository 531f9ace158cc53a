"""Registered queries for pricing, pattern statistics and picks (J-06 .. J-08, A-07 .. A-10, A-22, A-33, A-35 .. A-39, A-41 .. A-43, K-01 .. K-04, K-07)."""

from __future__ import annotations

from pyspark.sql import functions as F

from loftline.functions.numbers import half_up
from loftline.operators import checks as C
from loftline.operators import picks as P
from loftline.operators import resolve as R
from loftline.operators import strokes as X
from loftline.plans.learning_plans import ORDER, med_cte
from loftline.plans.registry import HU, query
from loftline.plans.shots_plans import ELIG, FAM
from loftline.settings import BASELINE_PUTTS, BUCKET_LIE, DEFAULTS, lookup, table

# made-up price tables of the reference's shapes: 31 distances x 5 lies with a dip per column and gaps
BASELINE = [(l, d, round(a + b * d - (0.12 if d % 60 == 30 else 0.0), 3))
            for l, a, b in (("tee", 2.1, 0.0043), ("fairway", 2.0, 0.0040), ("rough", 2.2, 0.0041), ("sand", 2.4, 0.0042), ("recovery", 2.6, 0.0043))
            for d in range(10, 630, 20) if not (l == "tee" and d < 100) and not (l == "recovery" and d > 500)]
BANDS = [(l, float(a), float(b), round(-0.15 + 0.03 * i + 0.01 * len(l), 3) if i % 4 != 3 else None, 8.0 + 4 * i)
         for l in ("fairway", "rough", "bunker") for i, (a, b) in enumerate(((0, 20), (20, 50), (50, 90), (90, 130), (130, 170), (170, 210), (210, 250))) if l != "bunker" or b <= 50]
PUTTS = [(0, 2, 0.98, 0.0), (3, 5, 0.75, 0.0), (6, 9, 0.45, 0.01), (10, 15, 0.25, 0.03), (16, 25, 0.12, 0.06), (26, None, 0.04, 0.15)]
DEFICIT = 0.05
_v = lambda rows: ",".join("(" + ",".join("NULL" if x is None else f"'{x}'" if isinstance(x, str) else f"{x}::DOUBLE" for x in r) + ")" for r in rows)
TABLES = (f"bl(lie, yds, strokes) AS (VALUES {_v(BASELINE)}), bd(band_lie, from_yds, to_yds, sg, prox_ft) AS (VALUES {_v(BANDS)}), "
          f"pb(from_ft, to_ft, make_pct, three_pct) AS (VALUES {_v(PUTTS)}), pp(ft, putts) AS (VALUES {_v(BASELINE_PUTTS)}), "
          "pseg AS (SELECT ft, putts, lead(ft) OVER (ORDER BY ft) AS ft1, lead(putts) OVER (ORDER BY ft) AS p1 FROM pp), "
          "seg AS (SELECT lie, yds AS x0, strokes AS y0, lead(yds) OVER w AS x1, lead(strokes) OVER w AS y1, lag(yds) OVER w AS pv FROM bl WINDOW w AS (PARTITION BY lie ORDER BY yds)), "
          "base AS (SELECT l.lie, d.d, CASE WHEN x1 IS NULL OR d.d<=x0 THEN y0 ELSE y0+(d.d-x0)/(x1-x0)*(y1-y0) END AS base FROM (SELECT DISTINCT lie FROM bl) l CROSS JOIN (SELECT unnest(range(0,701)) AS d) d "
          "JOIN seg ON seg.lie=CASE WHEN l.lie='tee' AND d.d<100 THEN 'fairway' ELSE l.lie END AND (pv IS NULL OR d.d>=x0) AND (x1 IS NULL OR d.d<x1)), "
          "ex0 AS (SELECT base.*, CASE WHEN d<50 THEN CASE lie WHEN 'sand' THEN 'bunker' WHEN 'tee' THEN 'fairway' WHEN 'fairway' THEN 'fairway' ELSE 'rough' END ELSE CASE lie WHEN 'tee' THEN 'fairway' WHEN 'fairway' THEN 'fairway' WHEN 'rough' THEN 'rough' END END AS bl2 FROM base), "
          "ex1 AS (SELECT ex0.*, CASE WHEN bl2 IS NOT NULL THEN bd.sg END AS sg, bd.prox_ft FROM ex0 LEFT JOIN bd ON bd.band_lie=coalesce(bl2,'rough') AND d>=from_yds AND d<to_yds), "
          f"ex AS (SELECT lie, d, base + CASE WHEN sg IS NULL THEN 0.42*((2.79-2.38)+(0.0066-0.0041)*d) ELSE -sg END + CASE WHEN prox_ft IS NULL THEN {DEFICIT} ELSE greatest(0, 1+(1-make_pct)+three_pct - (SELECT CASE WHEN prox_ft<=1 THEN 1.001 WHEN prox_ft>=90 THEN 2.398 ELSE max(putts+(prox_ft-ft)/(ft1-ft)*(p1-putts)) END FROM pseg WHERE prox_ft>ft AND prox_ft<=ft1)) END AS e "
          "FROM ex1 LEFT JOIN pb ON floor(prox_ft+0.5)>=from_ft AND floor(prox_ft+0.5)<coalesce(to_ft+1, 1e9))")


def baseline(d):
    return table(d.spark, "lie string, yds double, strokes double", [(l, float(x), float(y)) for l, x, y in BASELINE])


def bands(d):
    return table(d.spark, "band_lie string, from_yds double, to_yds double, sg double, prox_ft double", BANDS)


def putts(d):
    return table(d.spark, "from_ft int, to_ft int, make_pct double, three_pct double", PUTTS)


# five kinds of player, each with bands and putting of its own
OWN = (TABLES.replace("bd.sg END AS sg, bd.prox_ft FROM ex0 LEFT JOIN bd ON bd.band_lie", "bd.sg+pid*0.01::DOUBLE END AS sg, bd.prox_ft+pid AS prox_ft FROM (SELECT ex0.*, pid FROM ex0 CROSS JOIN (SELECT unnest(range(0,5)) AS pid)) ex0 LEFT JOIN bd ON bd.band_lie")
       .replace("SELECT ex0.*, CASE WHEN bl2", "SELECT ex0.*, CASE WHEN bl2").replace("ex AS (SELECT lie, d,", "ex AS (SELECT pid, lie, d,").replace("1+(1-make_pct)+three_pct", "1+(1-(make_pct-pid*0.01::DOUBLE))+three_pct"))


def profiles(d):
    """Bands and putts of each player."""
    k = F.col("player_id") % 5
    band = lambda l, a, b, sg, px: F.struct(F.lit(l).alias("band_lie"), F.lit(a).alias("from_yds"), F.lit(b).alias("to_yds"), (F.lit(sg).cast("double") + k * 0.01).alias("sg"), (F.lit(px) + k).alias("prox_ft"))
    putt = lambda a, b, m, t: F.struct(F.lit(a).alias("from_ft"), F.lit(b).cast("int").alias("to_ft"), (F.lit(m) - k * 0.01).alias("make_pct"), F.lit(t).alias("three_pct"))
    return d.rounds.select("player_id").distinct().select("player_id", F.array(*[band(*b) for b in BANDS]).alias("bands"), F.array(*[putt(*b) for b in PUTTS]).alias("putts"))


@query("bucket_join", f"WITH bd(band_lie, from_yds, to_yds, sg, prox_ft) AS (VALUES {_v(BANDS)}) SELECT s.player_id, bd.band_lie, bd.from_yds, CAST(count(*) AS BIGINT) AS n FROM shots_v s LEFT JOIN bd ON bd.band_lie=CASE WHEN lie='rough' THEN 'rough' ELSE 'fairway' END AND to_pin_yds>=from_yds AND to_pin_yds<to_yds GROUP BY ALL", ("shots_v",))
def bucket_join(d):
    s = d.shots.withColumn("bl", lookup(F.col("lie"), BUCKET_LIE))
    return X.range_join(s, bands(d), "to_pin_yds", "bl").groupBy("player_id", "band_lie", "from_yds").agg(F.count(F.lit(1)).alias("n"))


@query("putt_bucket", f"WITH pb(from_ft, to_ft, make_pct, three_pct) AS (VALUES {_v(PUTTS)}) SELECT player_id, CAST(from_ft AS DOUBLE) AS from_ft, CAST(count(*) AS BIGINT) AS n, {HU('avg(1+(1-make_pct)+three_pct)', 6)} AS e_putts FROM shots_v JOIN pb ON putt_ft>=from_ft AND putt_ft<coalesce(to_ft+1,1e9) GROUP BY ALL", ("shots_v",))
def putt_bucket(d):
    j = X.putt_join(d.shots, putts(d), "putt_ft")
    return j.groupBy("player_id", "from_ft").agg(F.count(F.lit(1)).alias("n"), half_up(F.avg(F.lit(1.0) + (1 - F.col("make_pct")) + F.col("three_pct")), 6).alias("e_putts"))


@query("baseline_interp", f"WITH {TABLES} SELECT shot_id, {HU('base', 6)} AS strokes FROM shots_v s JOIN base ON base.lie=s.lie AND base.d=floor(intended_yds+0.5)", ("shots_v",))
def baseline_interp(d):
    t = X.strokes_by_yard(baseline(d)).withColumnRenamed("base", "e")
    return X.price(d.shots, t, "intended_yds", "lie", "v").select("shot_id", half_up("v", 6).alias("strokes"))


@query("expected_strokes", f"WITH {OWN} SELECT shot_id, {HU('e', 5)} AS e FROM shots_v s JOIN ex ON ex.pid=s.player_id%5 AND ex.lie=s.lie AND ex.d=floor(to_pin_yds+0.5)", ("shots_v",))
def expected_strokes(d):
    return X.expected_for(d.shots, profiles(d), X.strokes_by_yard(baseline(d)), [("to_pin_yds", "lie", "v")], DEFICIT).select("shot_id", half_up("v", 5).alias("e"))


_PUTTS = lambda ft: f"(SELECT CASE WHEN {ft}<=1 THEN 1.001 WHEN {ft}>=90 THEN 2.398 ELSE max(putts+({ft}-ft)/(ft1-ft)*(p1-putts)) END FROM pseg WHERE {ft}>ft AND {ft}<=ft1)"
SG = f"""{OWN}, sh AS (SELECT *, CASE WHEN shot_type='putt' THEN floor(putt_ft/18+0.5) ELSE floor(to_pin_yds/8+0.5) END AS etp, CASE WHEN shot_type='putt' THEN 'green' ELSE coalesce(end_lie,'rough') END AS el FROM shots_v),
 ends AS (SELECT s.*, CASE WHEN shot_type='putt' THEN {_PUTTS('putt_ft')} ELSE e0.e END AS a, CASE WHEN part_no%7=0 AND el='green' THEN 0 WHEN el='green' THEN {_PUTTS('etp*3')} ELSE e1.e END AS b
   FROM sh s JOIN ex e0 ON e0.pid=s.player_id%5 AND e0.lie=s.lie AND e0.d=floor(to_pin_yds+0.5) LEFT JOIN ex e1 ON e1.pid=s.player_id%5 AND e1.lie=CASE WHEN el='green' THEN 'fairway' ELSE el END AND e1.d=etp),
 sg AS (SELECT *, a-b-1-CASE WHEN part_no%29=0 THEN 1 ELSE 0 END AS sg, CASE WHEN shot_type='putt' THEN 'putting' WHEN lie='tee' THEN 'off the tee' WHEN to_pin_yds<50 THEN 'around the green' ELSE 'approach' END AS category FROM ends)"""


def gained(d):
    """All shots, putts among them: a putt stays on the green."""
    putt = F.col("shot_type") == "putt"
    s = d.shots.withColumns({"end_to_pin": F.when(putt, half_up(F.col("putt_ft") / 18)).otherwise(half_up(F.col("to_pin_yds") / 8)),
                                "end_lie": F.when(putt, "green").otherwise(F.coalesce("end_lie", F.lit("rough"))), "penalty": F.when(F.col("part_no") % 29 == 0, 1).otherwise(0)})
    return X.strokes_gained(s.withColumn("holed", (F.col("part_no") % 7 == 0) & (F.col("end_lie") == "green")), profiles(d), X.strokes_by_yard(baseline(d)), DEFICIT)


def _sums(df, *keys):
    return df.groupBy(*keys).agg(F.count("sg").alias("n"), F.sum("sg").alias("s"))


@query("strokes_gained", f"WITH {SG} SELECT player_id, club, CAST(count(sg) AS BIGINT) AS n, {HU('sum(sg)+1e-9', 4)} AS sg, {HU('avg(sg)+1e-9', 5)} AS per_shot FROM sg GROUP BY GROUPING SETS ((player_id, club),(player_id))", ("shots_v",))
def strokes_gained(d):
    per = _sums(gained(d), "player_id", "club")
    both = per.rollup("player_id", "club").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.grouping_id().alias("_g")).filter("_g < 3")   # by club and in all, shots read once
    return both.select("player_id", "club", "n", half_up(F.col("s") + 1e-9, 4).alias("sg"), half_up(F.col("s") / F.col("n") + 1e-9, 5).alias("per_shot"))


@query("strokes_gained_category", f"WITH {SG} SELECT player_id, category, CAST(count(sg) AS BIGINT) AS n, {HU('sum(sg)+1e-9', 4)} AS sg, {HU('sum(sg)/count(DISTINCT round_id)+1e-9', 5)} AS per_round FROM sg GROUP BY ALL", ("shots_v",))
def strokes_gained_category(d):
    """A-37: off the tee, approach, around the green and putting, in all and a round."""
    per = _sums(gained(d), "player_id", "category", "round_id").groupBy("player_id", "category").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.count(F.lit(1)).alias("r"))
    return per.select("player_id", "category", "n", half_up(F.col("s") + 1e-9, 4).alias("sg"), half_up(F.col("s") / F.col("r") + 1e-9, 5).alias("per_round"))


@query("strokes_gained_round", f"WITH {SG} SELECT player_id, round_id, {HU('sum(sg)+1e-9', 4)} AS sg FROM sg GROUP BY ALL", ("shots_v",))
def strokes_gained_round(d):
    return gained(d).groupBy("player_id", "round_id").agg(half_up(F.sum("sg") + 1e-9, 4).alias("sg"))


PHI = lambda z: (f"(CASE WHEN {z}>=0 THEN 0.5*(1+(1-(((((1.061405429*(1/(1+0.3275911*abs({z})/sqrt(2)))-1.453152027)*(1/(1+0.3275911*abs({z})/sqrt(2))))+1.421413741)*(1/(1+0.3275911*abs({z})/sqrt(2)))-0.284496736)*(1/(1+0.3275911*abs({z})/sqrt(2)))+0.254829592)*(1/(1+0.3275911*abs({z})/sqrt(2)))*exp(-{z}*{z}/2))) "  # noqa: E731
                 f"ELSE 0.5*(1-(1-(((((1.061405429*(1/(1+0.3275911*abs({z})/sqrt(2)))-1.453152027)*(1/(1+0.3275911*abs({z})/sqrt(2))))+1.421413741)*(1/(1+0.3275911*abs({z})/sqrt(2)))-0.284496736)*(1/(1+0.3275911*abs({z})/sqrt(2)))+0.254829592)*(1/(1+0.3275911*abs({z})/sqrt(2)))*exp(-{z}*{z}/2))) END)")
CDF = "(CASE WHEN j<1 THEN 0 WHEN j+0.5<=mu THEN 2*s1/(s1+s2)*" + PHI("((j+0.5-mu)/s1)") + " ELSE s1/(s1+s2)+2*s2/(s1+s2)*(" + PHI("((j+0.5-mu)/s2)") + "-0.5) END)"


@query("par_prob", f"""WITH s AS (SELECT *, greatest(0.05, 0.30::DOUBLE+0.03::DOUBLE*greatest(0,exp_score-1)) AS s1, greatest(0.05, 0.60::DOUBLE+0.12::DOUBLE*greatest(0,exp_score-1)) AS s2 FROM shots_v), t AS (SELECT *, exp_score-sqrt(2/pi())*(s2-s1) AS mu FROM s)
SELECT shot_id, {HU('p', 6)} AS par_prob, {HU('1-q', 6)} AS double_prob FROM (SELECT a.shot_id, p, {CDF} AS q FROM (SELECT shot_id, {CDF} AS p, mu, s1, s2, 5-shot_no AS j FROM (SELECT *, 4-shot_no AS j FROM t)) a)""", ("shots_v",))
def par_prob(d):
    return d.shots.select("shot_id", half_up(X.hole_out_cdf("exp_score", F.lit(4) - F.col("shot_no")), 6).alias("par_prob"),
                          half_up(1 - X.hole_out_cdf("exp_score", F.lit(5) - F.col("shot_no")), 6).alias("double_prob"))


@query("isotonic", f"""WITH p AS (SELECT player_id, lie, CAST(floor(to_pin_yds/10) AS INT) AS bin, floor(avg(exp_score)*10000+0.5)/10000 AS v FROM shots_v GROUP BY ALL),
 q AS (SELECT *, row_number() OVER w AS i, sum(v) OVER w AS cs FROM p WINDOW w AS (PARTITION BY player_id, lie ORDER BY bin)),
 m AS (SELECT a.player_id, a.lie, k.i AS k, a.i AS s, min((e.cs-a.cs+a.v)/(e.i-a.i+1)) AS mn FROM q a JOIN q k ON k.player_id=a.player_id AND k.lie=a.lie AND k.i>=a.i JOIN q e ON e.player_id=a.player_id AND e.lie=a.lie AND e.i>=k.i GROUP BY ALL)
SELECT q.player_id, q.lie, bin, {HU(HU('max(mn)', 6)+'+1e-9', 5)} AS fit FROM q JOIN m ON m.player_id=q.player_id AND m.lie=q.lie AND m.k=q.i GROUP BY q.player_id, q.lie, bin""", ("shots_v",))
def isotonic(d):
    p = d.shots.groupBy("player_id", "lie", F.floor(F.col("to_pin_yds") / 10).cast("int").alias("bin")).agg(half_up(F.avg("exp_score"), 4).alias("v"))
    return X.isotonic(p, ["player_id", "lie"], "bin", "v").withColumn("fit", half_up(F.col("fit") + 1e-9, 5))


K2 = "player_id, club"


@query("kernel_stats", f"""WITH s AS (SELECT *, CASE WHEN seq%3=0 THEN 1.0 WHEN seq%3=1 THEN 0.5 ELSE 0.25 END::DOUBLE AS w FROM shots_v), {med_cte('q', 's', K2, 'lat_miss_yds', 'w')},
 qq AS (SELECT {K2}, min(CASE WHEN cum>=0.25*tot-1e-9 THEN v END) AS q1, min(CASE WHEN cum>=0.75*tot-1e-9 THEN v END) AS q3 FROM q_c GROUP BY ALL),
 g AS (SELECT {K2}, sum(w)*sum(w)/sum(w*w) AS ne, sum(w*lat_miss_yds)/sum(w) AS mn, sum(w*lat_miss_yds*lat_miss_yds)/sum(w)-pow(sum(w*lat_miss_yds)/sum(w),2) AS v FROM s GROUP BY ALL),
 h AS (SELECT *, sqrt(v*CASE WHEN ne>1 THEN ne/(ne-1) ELSE 1 END) AS sd, pow(greatest(ne,1),-1.0/6) AS hh FROM g JOIN qq USING ({K2})), k AS (SELECT *, least(sd, CASE WHEN q3-q1>0 THEN (q3-q1)/1.349 ELSE sd END) AS sk FROM h)
SELECT {K2}, {HU('ne+1e-9', 4)} AS n_eff, {HU('mn+1e-9', 4)} AS mean, {HU('sd+1e-9', 4)} AS sd, {HU('hh*sk+1e-9', 4)} AS kern, {HU('sqrt(greatest(0,1-pow(least(1,hh*sk/sd),2)))+1e-9', 4)} AS pull FROM k""", ("shots_v",))
def kernel_stats(d):
    s = d.shots.withColumn("w", F.when(F.col("seq") % 3 == 0, 1.0).when(F.col("seq") % 3 == 1, 0.5).otherwise(0.25))
    k = X.kernel(s, ["player_id", "club"], "lat_miss_yds", "w")
    return k.select("player_id", "club", *[half_up(F.col(f) + 1e-9, 4).alias(f) for f in ("n_eff", "mean", "sd", "kern", "pull")])


@query("short_tail", f"""SELECT {K2}, {HU('CASE WHEN t>m THEN (t-m)/(1-m) ELSE 0 END+1e-9', 5)} AS surplus, {HU('m+1e-9', 5)} AS model FROM (SELECT *, (n*obs+5*m)/(n+5) AS t FROM (SELECT *, {PHI('(-0.1::DOUBLE*tot/sd)')} AS m FROM (SELECT {K2}, count(*) AS n, avg(CASE WHEN dist_miss_yds<-0.1::DOUBLE*intended_yds THEN 1.0::DOUBLE ELSE 0 END) AS obs, avg(intended_yds) AS tot, stddev_samp(dist_miss_yds) AS sd FROM shots_v GROUP BY ALL)))""", ("shots_v",))
def short_tail(d):
    g = d.shots.groupBy("player_id", "club").agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("dist_miss_yds") < -0.1 * F.col("intended_yds"), 1.0).otherwise(0.0)).alias("obs"),
                                                 F.avg("intended_yds").alias("tot"), F.stddev_samp("dist_miss_yds").alias("sd"))
    from loftline.functions.numbers import normal_cdf
    g = g.withColumn("m", normal_cdf(-0.1 * F.col("tot") / F.col("sd")))
    return g.select("player_id", "club", half_up(X.short_tail("obs", "n", "m", 5.0) + 1e-9, 5).alias("surplus"), half_up(F.col("m") + 1e-9, 5).alias("model"))


@query("trim_worst", f"""WITH m AS (SELECT label, median(x) AS mx, median(y) AS my, count(*) AS n FROM points_v GROUP BY label),
 r AS (SELECT point_id, p.label, n, row_number() OVER (PARTITION BY p.label ORDER BY sqrt((x-mx)*(x-mx)+(y-my)*(y-my)), point_id) AS rn FROM points_v p JOIN m USING (label))
SELECT label, point_id FROM r WHERE n<2 OR floor(n*0.2+0.5)<=0 OR rn<=greatest(1, n-floor(n*0.2+0.5))""", ("points_v",))
def trim_worst(d):
    return X.trim_worst(d.points, ["label"], "x", "y", "point_id", DEFAULTS.drop_worst_pct).select("label", "point_id")


@query("good_window", f"""WITH s AS (SELECT *, intended_yds+dist_miss_yds AS tot FROM shots_v), m AS (SELECT {K2}, median(tot) AS md FROM s GROUP BY ALL), g AS (SELECT s.*, md, abs(tot-md)<=CASE WHEN club='SW' THEN greatest(8, md*0.1::DOUBLE) ELSE 20 END AS good FROM s JOIN m USING ({K2}))
SELECT {K2}, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (NOT good) AS BIGINT) AS mishits, any_value(md) AS median_all, median(tot) FILTER (good) AS median_good, {HU('count(*) FILTER (NOT good)/count(*)', 6)} AS mishit_rate FROM g GROUP BY ALL""", ("shots_v",))
def good_window(d):
    g = X.good_window(d.shots.withColumn("tot", F.col("intended_yds") + F.col("dist_miss_yds")), ["player_id", "club"], "tot", F.col("club") == "SW")
    return g.withColumn("mishit_rate", half_up("mishit_rate", 6))


@query("band_width", f"""WITH m AS (SELECT {K2}, median(lat_miss_yds) AS md FROM shots_v GROUP BY ALL) SELECT {K2}, {HU('2*quantile_cont(abs(lat_miss_yds-md), 0.65)+1e-9', 6)} AS band_yds FROM shots_v JOIN m USING ({K2}) GROUP BY ALL""", ("shots_v",))
def band_width(d):
    return X.band_width(d.shots, ["player_id", "club"], "lat_miss_yds").withColumn("band_yds", half_up(F.col("band_yds") + 1e-9, 6))


# ---- picks: one decision per (player, round, hole), its shots as priced candidates --------------------
CANDS = """cd AS (SELECT player_id, round_id, shot_id AS ord, club, swing, exp_score, CAST(part_no%40 AS DOUBLE)/40 AS par_prob, CAST(supp_no%25 AS DOUBLE)/80 AS trouble, CAST(part_no%17 AS DOUBLE)/40 AS birdie, intended_yds+dist_miss_yds AS mean_yds, intended_yds AS dist_to_target, to_pin_yds FROM shots_v)"""
PLAIN = lambda pool: (f"SELECT *, row_number() OVER (PARTITION BY player_id, round_id ORDER BY abs(mean_yds-dist_to_target), ord) AS rn FROM (SELECT * FROM (SELECT *, min(exp_score) OVER (PARTITION BY player_id, round_id) AS mn FROM (SELECT * FROM (SELECT *, max(par_prob) OVER (PARTITION BY player_id, round_id) AS mp FROM {pool}) WHERE par_prob>=mp-0.01-1e-9)) WHERE exp_score<=mn+0.03)")
KEYS = ["player_id", "round_id"]


def cands(d):
    return d.shots.select("player_id", "round_id", F.col("shot_id").alias("ord"), "club", "swing", "exp_score", ((F.col("part_no") % 40).cast("double") / 40).alias("par_prob"),
                          ((F.col("supp_no") % 25).cast("double") / 80).alias("trouble"), ((F.col("part_no") % 17).cast("double") / 40).alias("birdie"),
                          (F.col("intended_yds") + F.col("dist_miss_yds")).alias("mean_yds"), F.col("intended_yds").alias("dist_to_target"), "to_pin_yds")


@query("plain_pick", f"WITH {CANDS} SELECT player_id, round_id, ord, club FROM ({PLAIN('cd')}) WHERE rn=1", ("shots_v",))
def plain_pick(d):
    return P.plain_pick(cands(d), KEYS, F.lit(True), "pick").filter("pick").select(*KEYS, "ord", "club")


POOL = """pl AS (SELECT * FROM (SELECT *, CASE WHEN round_id%2=1 THEN true WHEN max(trouble<=0.1+1e-9) OVER v THEN trouble<=0.1+1e-9 ELSE (CASE WHEN max(to_pin_yds>60) OVER v THEN to_pin_yds>60 ELSE true END) AND trouble<=lt+0.02 END AS keep FROM (SELECT *, min(CASE WHEN af THEN CASE WHEN to_pin_yds>60 THEN trouble END ELSE trouble END) OVER v AS lt FROM (SELECT *, max(to_pin_yds>60) OVER v AS af FROM cd WINDOW v AS (PARTITION BY player_id, round_id)) WINDOW v AS (PARTITION BY player_id, round_id)) WINDOW v AS (PARTITION BY player_id, round_id)) WHERE keep)"""


def safe(d):
    c = P.safe_pool(cands(d), KEYS, F.col("round_id") % 2 == 0, F.col("to_pin_yds") > 60)
    return P.plain_pick(c, KEYS, F.col("pool"), "safe")


@query("constrained_pick", f"WITH {CANDS}, {POOL} SELECT player_id, round_id, ord, club FROM ({PLAIN('pl')}) WHERE rn=1", ("shots_v",))
def constrained_pick(d):
    return safe(d).filter("safe").select(*KEYS, "ord", "club")


@query("second_option", f"""WITH {CANDS}, {POOL}, sf AS (SELECT player_id, round_id, ord AS so, club AS sc, swing AS ss, birdie AS sb, dist_to_target AS sd FROM ({PLAIN('pl')}) WHERE rn=1),
 a AS (SELECT * FROM (SELECT cd.*, so, sc, ss, sb, sd, row_number() OVER (PARTITION BY player_id, round_id ORDER BY birdie DESC, CASE WHEN ord=so THEN 0 ELSE 1 END, ord) AS rn FROM cd JOIN sf USING (player_id, round_id)) WHERE rn=1)
SELECT player_id, round_id, so AS safe_ord, ord AS aggr_ord, ord=so OR (club=sc AND swing=ss AND abs(dist_to_target-sd)<=10) OR (birdie-sb<0.005 AND NOT dist_to_target>sd+20) AS same_shot FROM a""", ("shots_v",))
def second_option(d):
    return P.second_option(safe(d), KEYS)


@query("pin_rule_pick")
def pin_rule_pick(d):
    """Order-dependent fold over tie groups; checked against a brute-force walk in the tests."""
    return P.pin_rule(safe(d).filter("pool"), KEYS, F.lit(150.0))


@query("club_guess", f"""WITH t AS (SELECT player_id, club, CASE club WHEN 'Dr' THEN 0 WHEN '4Hy' THEN 1 WHEN '6i' THEN 2 WHEN '8i' THEN 3 WHEN 'PW' THEN 4 ELSE 5 END AS o, avg(intended_yds)+CASE club WHEN 'Dr' THEN 60 WHEN '4Hy' THEN 35 WHEN '6i' THEN 10 WHEN '8i' THEN -15 WHEN 'PW' THEN -40 ELSE -60 END AS tot FROM shots_v GROUP BY player_id, club)
SELECT shot_id, t.club AS club_guess FROM shots_v s JOIN t USING (player_id) QUALIFY row_number() OVER (PARTITION BY shot_id ORDER BY abs(tot-(intended_yds+dist_miss_yds)), o)=1""", ("shots_v",))
def club_guess(d):
    shift = {"Dr": 60.0, "4Hy": 35.0, "6i": 10.0, "8i": -15.0, "PW": -40.0, "SW": -60.0}
    t = d.shots.groupBy("player_id", "club").agg(F.avg("intended_yds").alias("m")).select("player_id", "club", lookup(F.col("club"), ORDER).alias("order_no"), (F.col("m") + lookup(F.col("club"), shift)).alias("total_yds"))
    s = d.shots.select("player_id", "shot_id", (F.col("intended_yds") + F.col("dist_miss_yds")).alias("yds"))
    return P.guess_club(s, t, "yds").select("shot_id", "club_guess")


@query("sweep_report", f"""WITH c AS (SELECT o_orderpriority AS lie, o_orderstatus AS rule, o_orderkey%4=0 AS moved, (o_orderkey%37)/100.0::DOUBLE AS cost, (o_orderkey%21-10)/100.0::DOUBLE AS dt FROM orders)
SELECT lie, rule, CAST(count(*) AS BIGINT) AS fired, CAST(count(*) FILTER (moved) AS BIGINT) AS moved_n, {HU('avg(cost) FILTER (moved)', 6)} AS mean_cost, {HU('median(cost) FILTER (moved)', 6)} AS median_cost, {HU('avg(dt) FILTER (moved)', 6)} AS mean_d_trouble FROM c GROUP BY ALL""")
def sweep_report(d):
    k = F.col("o_orderkey")
    calls = d.orders.select(F.col("o_orderpriority").alias("lie"), F.col("o_orderstatus").alias("rule"), (k % 4 == 0).alias("moved"), ((k % 37) / F.lit(100.0)).alias("cost"), ((k % 21 - 10) / F.lit(100.0)).alias("d_trouble"))
    r = P.sweep_report(calls, ["lie"])
    return r.select("lie", "rule", "fired", "moved_n", *[half_up(f, 6).alias(f) for f in ("mean_cost", "median_cost", "mean_d_trouble")])


@query("costly_moves", """WITH c AS (SELECT o_orderkey AS call_id, o_orderpriority AS lie, (o_orderkey%37)/100.0::DOUBLE AS cost FROM orders WHERE o_orderkey%4=0), k AS (SELECT *, row_number() OVER (PARTITION BY lie ORDER BY cost DESC, call_id) AS place, count(*) OVER (PARTITION BY lie) AS costly FROM c WHERE cost>0.3::DOUBLE)
SELECT lie, CAST(place AS INT) AS place, call_id, cost, CAST(costly AS BIGINT) AS costly FROM k WHERE place<=12""")
def costly_moves(d):
    """A-35: what the sweep prints of single calls; a call in four was moved."""
    k = F.col("o_orderkey")
    calls = d.orders.select(k.alias("call_id"), F.col("o_orderpriority").alias("lie"), (k % 4 == 0).alias("moved"), ((k % 37) / F.lit(100.0)).alias("cost"))
    return P.costly_moves(calls, ["lie"]).select("lie", "place", "call_id", "cost", "costly")


@query("putt_cdf", f"""WITH pb(from_ft, to_ft, make_pct, three_pct) AS (VALUES {_v(PUTTS)}) SELECT shot_id, CAST(j AS INT) AS putts, {HU('CASE j WHEN 0 THEN 0 WHEN 1 THEN make_pct WHEN 2 THEN 1-three_pct ELSE 1 END', 6)} AS chance
 FROM shots_v JOIN pb ON putt_ft>=from_ft AND (to_ft IS NULL OR putt_ft<to_ft+1) CROSS JOIN (SELECT unnest(range(0,4)) AS j) WHERE shot_type='putt'""", ("shots_v",))
def putt_cdf(d):
    """A-38 on the green: the chance of being down in so many putts or fewer."""
    j = X.putt_join(d.shots.filter("shot_type = 'putt'"), putts(d), "putt_ft").filter("make_pct IS NOT NULL")
    j = j.select("shot_id", "make_pct", "three_pct", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("putts"))
    return j.select("shot_id", "putts", half_up(X.putt_cdf("putts", "make_pct", "three_pct"), 6).alias("chance"))


# ---- entries from shares ------------------------------------------------------------------------------
@query("leave_zones", f"""WITH z AS (SELECT player_id, club, to_pin_yds>=100 AS far, count(*) AS n, floor(1000.0::DOUBLE*count(*) FILTER (lat_miss_yds<0)/count(*)+0.5)/10 AS lp, floor(1000.0::DOUBLE*count(*) FILTER (lat_miss_yds>0)/count(*)+0.5)/10 AS rp, floor(1000.0::DOUBLE*count(*) FILTER (lat_miss_yds=0)/count(*)+0.5)/10 AS cp FROM shots_v GROUP BY ALL)
SELECT player_id, club, CAST(sum(n) AS BIGINT) AS n, CAST(sum(floor(lp*n/100+0.5)) AS BIGINT) AS lft, CAST(sum(floor(rp*n/100+0.5)) AS BIGINT) AS rgt, CAST(sum(floor(cp*n/100+0.5)) AS BIGINT) AS mid, sum(n)=sum(floor(lp*n/100+0.5)+floor(rp*n/100+0.5)+floor(cp*n/100+0.5)) AS adds_up, {HU('sum(floor(lp*n/100+0.5))/sum(n)', 6)} AS left_share FROM z GROUP BY player_id, club""", ("shots_v",))
def leave_zones(d):
    pc = lambda cond: half_up(100.0 * F.count(F.when(cond, 1)) / F.count(F.lit(1)), 1)
    v = F.col("lat_miss_yds")
    z = d.shots.groupBy("player_id", "club", (F.col("to_pin_yds") >= 100).alias("far")).agg(F.count(F.lit(1)).alias("n"), pc(v < 0).alias("lft"), pc(v > 0).alias("rgt"), pc(v == 0).alias("mid"))
    r = C.zone_rollup(z, ["player_id", "club"], ["lft", "rgt", "mid"])
    return r.select("player_id", "club", "n", "lft", "rgt", "mid", "adds_up", half_up(F.col("lft") / F.col("n"), 6).alias("left_share"))


@query("entry_assembly", f"""WITH e AS (SELECT player_id, club, swing, lie, count(*) AS n, quantile_cont(intended_yds, 0.75)-quantile_cont(intended_yds, 0.25) AS iqr, max(abs(lat_miss_yds))*2 AS wid, floor(avg(CASE WHEN end_lie='sand' THEN 1.0::DOUBLE ELSE 0 END)*1000+0.5)/1000 AS pen FROM shots_v GROUP BY ALL)
SELECT player_id, club, swing, lie, CAST(n AS BIGINT) AS n, CASE WHEN n>=5 THEN {HU('iqr/1.349+1e-9', 4)} END AS dist_sd, greatest(40.0::DOUBLE, wid/2) AS big_miss_lat, CAST(floor(pen*n+0.5) AS BIGINT) AS penalty_count FROM e""", ("shots_v",))
def entry_assembly(d):
    from loftline.operators.stats import cumulative
    keys = ["player_id", "club", "swing", "lie"]
    g = d.shots.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.max(F.abs("lat_miss_yds")).alias("m"), half_up(F.avg(F.when(F.col("end_lie") == "sand", 1.0).otherwise(0.0)), 3).alias("pen"))
    q = C.interpolated_quantiles(cumulative(d.shots, keys, "intended_yds", None, 32.0), keys, {"q1": 0.25, "q3": 0.75})
    a = C.assemble_entries(g.join(q, keys).withColumn("iqr", F.col("q3") - F.col("q1")).withColumn("width", F.col("m") * 2))
    return a.select(*keys, "n", half_up(F.col("dist_sd") + 1e-9, 4).alias("dist_sd"), "big_miss_lat", "penalty_count")


@query("quality_checks", f"""WITH b AS (SELECT l_suppkey AS k, l_linenumber*10 AS fr, l_linenumber*10+10+CASE WHEN l_suppkey%7=0 AND l_linenumber=3 THEN 1 ELSE 0 END AS tu FROM lineitem GROUP BY ALL),
 w AS (SELECT k, fr, lag(tu) OVER (PARTITION BY k ORDER BY fr) AS pt FROM b)
SELECT 'bands not contiguous' AS rule, k AS id, CAST(fr AS BIGINT) AS at FROM w WHERE pt<>fr UNION ALL SELECT 'share outside 0..1', l_orderkey, CAST(count(*) AS BIGINT) FROM lineitem WHERE l_discount*12>1 GROUP BY l_orderkey
UNION ALL SELECT 'duplicate key', l_orderkey, CAST(l_linenumber AS BIGINT) FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*)>1""")
def quality_checks(d):
    li = d.lineitem
    bands_ = li.select(F.col("l_suppkey").alias("k"), (F.col("l_linenumber") * 10).alias("fr"), (F.col("l_linenumber") * 10 + 10 + F.when((F.col("l_suppkey") % 7 == 0) & (F.col("l_linenumber") == 3), 1).otherwise(0)).alias("tu")).distinct()
    a = C.not_contiguous(bands_, ["k"], "fr", "tu").select(F.lit("bands not contiguous").alias("rule"), F.col("k").alias("id"), F.col("fr").cast("bigint").alias("at"))
    b = C.outside_unit(li.withColumn("share", F.col("l_discount") * 12), "share").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("at")).select(F.lit("share outside 0..1").alias("rule"), F.col("l_orderkey").alias("id"), "at")
    c = C.duplicates(li, ["l_orderkey", "l_linenumber"]).select(F.lit("duplicate key").alias("rule"), F.col("l_orderkey").alias("id"), F.col("l_linenumber").cast("bigint").alias("at"))
    return a.unionByName(b).unionByName(c)


@query("spread_ring", f"""SELECT player_id, club, {HU('CASE WHEN club_n%2=0 THEN 31.5::DOUBLE*1.0 ELSE least(2*sqrt(-2*ln(0.2))*sd, 70) END+1e-9', 4)} AS ring_w, {HU('CASE WHEN club_n%2=0 THEN 22.5::DOUBLE ELSE least(2*sqrt(-2*ln(0.2))*sl, 70) END+1e-9', 4)} AS ring_h, CASE WHEN club_n%2=0 THEN 12.0::DOUBLE ELSE 90.0::DOUBLE END AS ring_tilt, CASE WHEN club_n%2=0 THEN 'measured' ELSE 'profile' END AS ring_source
FROM (SELECT player_id, club, count(*) AS club_n, stddev_samp(dist_miss_yds) AS sd, stddev_samp(lat_miss_yds) AS sl FROM shots_v GROUP BY ALL)""", ("shots_v",))
def spread_ring(d):
    g = d.shots.groupBy("player_id", "club").agg(F.count(F.lit(1)).alias("n"), F.stddev_samp("dist_miss_yds").alias("dist_sd"), F.stddev_samp("lat_miss_yds").alias("lateral_sd")).withColumn("lie_sd_mult", F.lit(1.0))
    even = F.col("n") % 2 == 0
    g = g.withColumn("ell_w", F.when(even, 31.5)).withColumn("ell_h", F.when(even, 22.5)).withColumn("ell_tilt", F.when(even, 12.0))
    r = R.ring(g)
    return r.select("player_id", "club", half_up(F.col("ring_w") + 1e-9, 4).alias("ring_w"), half_up(F.col("ring_h") + 1e-9, 4).alias("ring_h"), "ring_tilt", "ring_source")
