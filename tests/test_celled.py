"""Positions streamed past the outlines of their square, against plain loops: no position meets an outline in a join."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loftline.operators import celled as C
from loftline.operators import spatial as P
from loftline.plans import catalog
from loftline.sources import maps

FEATURE = "course_id long, feature_id long, kind string, f_hole int, ring array<struct<x:double,y:double>>, inner array<array<struct<x:double,y:double>>>"
POINT = "id long, course_id long, hole int, x double, y double"


def star(rnd, cx, cy, r):
    n = rnd.randint(3, 9)
    return [(cx + r * rnd.uniform(0.4, 1) * math.cos(2 * math.pi * k / n), cy + r * rnd.uniform(0.4, 1) * math.sin(2 * math.pi * k / n)) for k in range(n)]


def odd(ring, x, y):
    return len(ring) >= 3 and sum((ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1])) % 2 == 1


def holds(f, x, y):
    return odd(f[4], x, y) and not any(odd(r, x, y) for r in f[5] or [])


def away(f, x, y):
    if holds(f, x, y):
        return 0.0
    best = math.inf
    for (ax, ay), (bx, by) in zip(f[4], f[4][1:] + f[4][:1]):
        vx, vy = bx - ax, by - ay
        t = max(0.0, min(1.0, ((x - ax) * vx + (y - ay) * vy) / (vx * vx + vy * vy))) if vx or vy else 0.0
        best = min(best, math.hypot(x - ax - t * vx, y - ay - t * vy))
    return best


def world(seed, n=120, m=400):
    rnd = random.Random(seed)
    fs = []
    for k in range(n):
        x, y = rnd.uniform(-150, 150), rnd.uniform(-150, 150)
        r = rnd.choice([4, 15, 70])
        fs.append((rnd.choice([1, 2, None]), k, rnd.choice(["green", "sand", "water", "tee", "trees", None]), rnd.choice([1, 2, 3, None]), star(rnd, x, y, r),
                   rnd.choice([None, [], [star(rnd, x, y, r / 2), star(rnd, x + r / 3, y, r / 2)]])))
    fs += [fs[3], (1, 900, "sand", 1, [(0.0, 0.0), (4.0, 4.0)], []), (1, 901, "sand", 1, [(7.0, 7.0)], None)]
    ps = [(k, rnd.choice([1, 2, 3, None]), rnd.choice([1, 2, 3, None]), rnd.choice([None, *[rnd.uniform(-190, 190) for _ in range(9)]]), rnd.uniform(-190, 190)) for k in range(m)]
    return fs, ps + ps[:3]


@pytest.fixture(scope="module")
def both(spark):
    fs, ps = world(4)
    return fs, ps, spark.createDataFrame(fs, FEATURE), spark.createDataFrame(ps, POINT)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def known(p):
    return p[1] is not None and p[3] is not None


def test_holding_meets_in_no_join(both):
    fs, ps, f, p = both
    got = P.containing(p, f)
    assert "Join" not in plan(got)
    want = sorted((q[0], g[1]) for q in ps if known(q) for g in fs if g[0] == q[1] and holds(g, q[3], q[4]))
    assert sorted((r.id, r.feature_id) for r in got.collect()) == want and len(want) > 100


def test_surfaces_keep_every_row_and_meet_in_no_join(both):
    fs, ps, f, p = both

    def plain(q):
        if not known(q):
            return "rough"
        own = [g for g in fs if g[0] == q[1] and g[2] and holds(g, q[3], q[4])]
        rank = [5 if g[2] == "green" and None not in (g[3], q[2]) and g[3] != q[2] else P.PRIORITY[g[2]] for g in own]
        return P.NAME[min(rank, default=8)]
    got = P.surface(p, f, "id")
    assert "Join" not in plan(got)
    assert sorted((r.id, r.surface) for r in got.collect()) == sorted((q[0], plain(q)) for q in ps)


def test_wet_equals_containment(spark, both):
    fs, ps, f, p = both
    more = spark.createDataFrame([(q[0], *ps[(k + 1) % len(ps)][1:]) for k, q in enumerate(ps[:200])], POINT)   # keys that stand at two places
    p = p.unionByName(more)
    hit = P.containing(p, f.filter("kind IN ('water', 'sand', 'green')"))
    own = (F.col("kind") == "sand") | ((F.col("kind") == "green") & F.col("f_hole").eqNullSafe(F.col("hole")))
    want = {r.id for r in hit.groupBy("id").agg(F.bool_or(F.col("kind") == "water").alias("w"), F.bool_or(own).alias("o")).filter("w AND NOT o").collect()}
    got = P._wet(p, f, ["id"])
    assert sorted(r.id for r in got.collect()) == sorted(want) and len(want) > 20
    assert "Join" not in plan(got)


@pytest.mark.parametrize("on", [[], ["hole"]])
def test_nearest_on_shared_columns_and_alone(both, on):
    fs, ps, f, p = both
    f = f.withColumn("hole", F.col("f_hole"))
    got = P._with_nearest(p, f, 25.0, ["hole"] if on else ["kind"], "feature_id", on, alone=True)
    assert "Join" not in plan(got)
    want = []
    for q in ps:
        best = {}
        for g in fs if known(q) else ():
            d = away(g, q[3], q[4])
            if g[0] == q[1] and d <= 25 and (not on or (g[3] == q[2] and q[2] is not None)):
                by = None if on else g[2]
                best[by] = min(best.get(by, (math.inf, 0)), (round(d, 9), g[1]))
        want += [(q[0], k, *v) for k, v in best.items()] or [(q[0], None, None, None)]
    rows = [(r.id, None if on else r.kind, None if r._d is None else round(r._d, 9), r.feature_id) for r in got.collect()]
    assert sorted(rows, key=str) == sorted(want, key=str) and len([w for w in want if w[2] is not None]) > 40


def test_hole_by_tee_and_lone_tees(both):
    """A tee of every kind of hole; no hole named twice for a fix."""
    fs, ps, f, p = both
    tees = f.filter("kind = 'tee'").select("course_id", "f_hole", "ring", "inner")
    got = {(r.id, r.f_hole, round(r._d, 9)) for r in P._with_nearest(p, tees, 30.0, [], "f_hole").collect()}
    want = set()
    for q in ps:
        near = [(round(away(g, q[3], q[4]), 9), g[3] or 0, g[3]) for g in fs if known(q) and g[0] == q[1] and g[2] == "tee"]
        if near and min(near)[0] <= 30:
            want.add((q[0], min(near)[2], min(near)[0]))
    assert got == want and want


def test_small_blocks_give_the_same(monkeypatch):
    """Edges are measured a few at a time; nothing is lost between blocks."""
    fs, ps = world(9, 60, 150)
    xy = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))
    ring = lambda r: [{"x": a, "y": b} for a, b in r]
    t = pa.table([pa.array([ring(g[4]) for g in fs], xy), pa.array([None if g[5] is None else [ring(r) for r in g[5]] for g in fs], pa.list_(xy))], ["_ring", "_inner"])
    s, at = C.Outlines(t), [q for q in ps if q[3] is not None]
    f, k = np.repeat(np.arange(len(fs)), len(at)), np.tile(np.arange(len(at)), len(fs))
    x, y = (np.array([q[i] for q in at])[k] for i in (3, 4))
    monkeypatch.setattr(C, "EDGES", 7)
    assert s.holds(f[::5], x[::5], y[::5]).tolist() == [holds(fs[i], a, b) for i, a, b in zip(f[::5], x[::5], y[::5])]
    outer = [away((*fs[i][:5], [fs[i][4]]), a, b) for i, a, b in zip(f[::5], x[::5], y[::5])]
    assert np.allclose(s.outer.away(f[::5], x[::5], y[::5]), outer)


def test_rings_of_many_relations_are_stitched_in_batches(spark):
    """A relation is no Python call of its own; parts come in any order and direction, some never close."""
    rnd, rows = random.Random(6), []
    for k in range(300):
        ring = [(float(k), 0.0), (float(k), 1.0), (k + 1.0, 1.0), (k + 1.0, 0.0)]
        for role, cut in (("outer", rnd.randint(1, 3)), ("inner", 0)):
            loop = [*ring, ring[0]]
            ways = [loop] if not cut else [loop[:cut + 1], loop[cut:][::rnd.choice([1, -1])]][:1 if k % 7 == 0 else 2]
            rows += [(k, role, pos, way) for pos, way in enumerate([*ways, [(9.0, 9.0)]])]
    rnd.shuffle(rows)
    got = maps.stitch_rings(spark.createDataFrame(rows, "relation_id long, role string, pos int, pts array<struct<lat:double,lon:double>>"))
    assert "InPandas" not in plan(got) and "MapInArrow" in plan(got)
    found = {(r.relation_id, r.role): [(p.lat, p.lon) for p in r.ring] for r in got.collect()}
    assert len(found) == 600
    for (k, role), pts in found.items():
        assert (pts[0] == pts[-1]) == (role == "inner" or k % 7 != 0) and (k % 7 == 0 and role == "outer" or len(pts) == 5 and len(set(pts)) == 4)


def test_clamp_takes_the_first_step_inside_and_opens_none(spark):
    """Against plain steps: what is outside and repeats is one row."""
    fs, ps = world(5, 300, 900)
    f, p = spark.createDataFrame(fs, FEATURE), spark.createDataFrame(ps, POINT)
    own = f.filter("kind = 'green'").select("course_id", F.col("f_hole").alias("hole"), "feature_id", "ring", F.struct(F.lit(0.0).alias("x"), F.element_at("ring", 1)["y"].alias("y")).alias("ctr"))
    t = P.near_rings(p, own, 6.0, ["hole"], ["feature_id", "ring", "ctr"])
    df = P.clamp_inside(t.select("id", "feature_id", "ring", "ctr", "x", "y"))
    assert "Join" not in plan(df) and "greatest(1" not in plan(df)
    want = []
    for q in ps:
        for g in fs:
            if not known(q) or g[0] != q[1] or g[2] != "green" or g[3] != q[2] or q[2] is None or away((*g[:5], None), q[3], q[4]) > 6:
                continue
            x, y, c = q[3], q[4], (0.0, g[4][0][1])
            if not odd(g[4], x, y):
                feet = []
                for (ax, ay), (bx, by) in zip(g[4], g[4][1:] + g[4][:1]):
                    s = max(0.0, min(1.0, ((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / ((bx - ax) ** 2 + (by - ay) ** 2)))
                    feet.append((math.hypot(x - ax - s * (bx - ax), y - ay - s * (by - ay)), ax + s * (bx - ax), ay + s * (by - ay)))
                _, u, v = min(feet)
                ln = math.hypot(u - c[0], v - c[1])
                steps = [(u + (c[0] - u) * k * 0.25 / ln, v + (c[1] - v) * k * 0.25 / ln) for k in range(1, max(1, math.ceil(ln / 0.25) - 1) + 1)]
                x, y = next((z for z in steps if odd(g[4], *z)), c)
            want.append((q[0], g[1], round(x, 6), round(y, 6)))
    got = [(r.id, r.feature_id, round(r.x, 6), round(r.y, 6)) for r in df.collect()]
    assert set(got) == set(want) and len(set(want)) > 8


def test_elevation_sends_no_opened_blocks(spark):
    """Blocks of cells round each query were broadcast, as explode's rows are not counted."""
    text = plan(catalog.queries()["idw_elevation"](spark, "/root/testdata/sf0.001"))
    assert "Generate" in text and "Broadcast" not in text


def test_no_list_goes_to_python_as_null(both):
    """Spark walks a batch's null lists again at each row it writes, so the cost of a batch would grow with its square."""
    _, _, f, p = both
    text = P.surface(p, f, "id")._jdf.queryExecution().optimizedPlan().toString()
    assert "_ring" in text and "null AS _ring" not in text and "null AS _inner" not in text


def test_water_entries_read_their_places_once_each(spark, both):
    """Landings and steps pass the outlines once; shots without a step give the ball."""
    _, _, f, _ = both
    pool = f.limit(1).select(F.lit(7).cast("long").alias("course_id"), F.lit(1).cast("long").alias("feature_id"), F.lit("water").alias("kind"), F.lit(1).alias("f_hole"),
                             F.expr("array(named_struct('x',-5D,'y',-5D),named_struct('x',5D,'y',-5D),named_struct('x',5D,'y',5D),named_struct('x',-5D,'y',5D))").alias("ring"), "inner")
    rows = [(1, 7, 1, 0.0, 0.0, 0.0, 50.0), (2, 7, 1, 0.0, 0.0, 0.0, 1.0), (3, 7, 1, 40.0, 0.0, 0.0, 50.0), (None, 7, 1, 0.0, 0.0, 0.0, 50.0), (4, 7, None, 0.0, 0.0, 4.0, 0.0)]
    got = P.water_entry(spark.createDataFrame(rows, "id long, course_id long, hole int, ex double, ey double, sx double, sy double"), pool, "id")
    assert plan(got).count("MapInArrow") == 2 and "Join" not in plan(got)
    assert {(r.id, r.x, r.y, r.k0) for r in got.collect()} == {(1, 0.0, 6.0, 3), (2, 0.0, 1.0, None), (4, 4.0, 0.0, None)}
