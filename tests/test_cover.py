"""Covers of polygons against ring tests of every position."""

import math
import random

import pytest
from pyspark.sql import functions as F

from loftline.operators import spatial as P
from loftline.settings import DEFAULTS, YARDS_PER_METRE

FEATURE = "course_id long, feature_id long, kind string, f_hole int, ring array<struct<x:double,y:double>>, inner array<array<struct<x:double,y:double>>>"


def star(rnd, cx, cy, r):
    n = rnd.randint(3, 12)
    return [(cx + r * rnd.uniform(0.4, 1) * math.cos(2 * math.pi * k / n), cy + r * rnd.uniform(0.4, 1) * math.sin(2 * math.pi * k / n)) for k in range(n)]


def within(ring, x, y):
    odd = False
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
        if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
            odd = not odd
    return odd


def holds(f, x, y):
    return within(f[4], x, y) and not any(within(r, x, y) for r in f[5] or [])


def course(seed):
    rnd = random.Random(seed)
    kinds = ["green", "sand", "water", "tee", "fairway", "trees", "rough"]
    fs = [(k % 2, k, rnd.choice(kinds), rnd.choice([1, 2, None]), star(rnd, rnd.uniform(-100, 100), rnd.uniform(-100, 100), rnd.choice([3, 12, 60])), None) for k in range(50)]
    fs = [(*f[:5], [star(rnd, f[4][0][0] / 2, f[4][0][1] / 2, 5)] if f[1] % 5 == 0 else f[5]) for f in fs]
    fs.append((0, 900, "boundary", 0, [(-90.0, -90.0), (90.0, -90.0), (90.0, 90.0), (-90.0, 90.0)], None))
    fs.append((1, 901, "fairway", 1, [(0.0, 0.0), (5.0, 5.0)], []))   # two points hold nothing
    pts = [(k, k % 2, rnd.choice([1, 2, None]), rnd.uniform(-130, 130), rnd.uniform(-130, 130), rnd.choice([None, 2.0, 6.0, 8.0, 11.0])) for k in range(700)]
    return fs, pts + [(9000, 0, 1, 90.0, 90.0, 1.0), (9001, 0, 1, 0.0, 0.0, 1.0), (9002, 7, 1, 0.0, 0.0, 1.0)]


def plain_surface(fs, course_id, hole, x, y):
    own = [f for f in fs if f[0] == course_id and holds(f, x, y)]
    p = min((P.PRIORITY["fairway"] if f[2] == "green" and f[3] is not None and hole is not None and f[3] != hole else P.PRIORITY[f[2]] for f in own if f[2] != "boundary"), default=None)
    if course_id == 0 and not any(f[2] == "boundary" for f in own) and (p or 99) > P.PRIORITY["trees"] and p != P.PRIORITY["rough"]:
        return "ob"
    return P.NAME[p or P.PRIORITY["rough"]]


@pytest.fixture(scope="module", params=[1, 2])
def both(spark, request):
    fs, pts = course(request.param)
    return fs, pts, spark.createDataFrame(fs, FEATURE), spark.createDataFrame(pts, "id long, course_id long, hole int, x double, y double, acc double")


def test_containing_equals_plain(both):
    fs, pts, f, p = both
    got = sorted((r.id, r.feature_id) for r in P.containing(p, f).collect())
    assert got == sorted((q[0], g[1]) for q in pts for g in fs if g[0] == q[1] and holds(g, q[3], q[4])) and len(got) > 300


def test_cells_are_what_they_say(both):
    fs, _, f, _ = both
    by, rnd = {x[1]: x for x in fs}, random.Random(3)
    big, fine = P.cover(f)
    for rows, size in ((big.collect(), P.SMALL * P.SIDE), (fine.filter("NOT _edge").collect(), P.SMALL)):
        for r in rows:
            assert all(holds(by[r.feature_id], (r._cx + rnd.random()) * size, (r._cy + rnd.random()) * size) for _ in range(5))


def test_surface_equals_plain(spark, both):
    fs, pts, f, p = both
    bounded = spark.createDataFrame([(0,)], "course_id long")
    got = {r.id: r.surface for r in P.surface(p, f, "id", bounded).collect()}
    assert got == {i: plain_surface(fs, c, h, x, y) for i, c, h, x, y, _ in pts}
    assert len(set(got.values())) == 8
    free = {r.id: r.surface for r in P.surface(p, f.filter("kind <> 'boundary'"), "id").collect()}
    assert free == {i: plain_surface([(g[0] + 10, *g[1:]) for g in fs if g[2] != "boundary"], c + 10, h, x, y) for i, c, h, x, y, _ in pts}


def test_lie_confidence_equals_plain(spark, both):
    fs, pts, f, p = both
    bounded = spark.createDataFrame([(0,)], "course_id long")
    got = {r.id: (r.lie, r.confidence) for r in P.lie_confidence(p, f, "id", F.col("acc"), bounded).collect()}
    for i, c, h, x, y, acc in pts:
        lie = plain_surface(fs, c, h, x, y)
        coarse = acc is not None and acc > DEFAULTS.coarse_m
        r = max(acc or 5.0, 5.0) * YARDS_PER_METRE
        same = coarse or all(plain_surface(fs, c, h, x + r * k * math.cos(a * math.pi / 8), y + r * k * math.sin(a * math.pi / 8)) == lie for k in (1, 0.5) for a in range(16))
        assert got[i] == (lie, "low" if coarse or not same or lie in ("water", "ob") else "high"), (i, c, h, x, y, acc)


def test_no_features(spark, both):
    _, pts, f, p = both
    none = f.filter("false")
    assert {r.surface for r in P.surface(p, none, "id").collect()} == {"rough"} and P.containing(p, none).count() == 0
