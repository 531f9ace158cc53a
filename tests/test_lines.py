"""Tee boxes, sample points, greens and dots against plain loops and hand-numbered cases."""

import math
import random

from pyspark.sql import functions as F

from loftline.operators import greens as R
from loftline.operators import spatial as P
from loftline.operators import teeboxes as B

XY = "array<struct<x:double,y:double>>"


def plain_yards(line, g, p):
    """To the nearest foot on the line, on along it, then to the green."""
    if len(line) < 2:
        return math.dist(p, g)
    best, along = None, 0.0
    for k, (a, b) in enumerate(zip(line, line[1:])):
        ln = math.dist(a, b)
        t = max(0, min(1, ((p[0] - a[0]) * (b[0] - a[0]) + (p[1] - a[1]) * (b[1] - a[1])) / ln ** 2)) if ln > 1e-9 else 0
        off = math.dist(p, (a[0] + (b[0] - a[0]) * t, a[1] + (b[1] - a[1]) * t))
        if best is None or off < best[0]:
            best = (off, along + t * ln, k == 0 and t == 0)
        along += ln
    return along - best[1] + (best[0] if best[2] else 0) + math.dist(line[-1], g)


def test_card_yards_equal_plain(spark):
    rnd = random.Random(1)
    rows = []
    for k in range(200):
        line = [(rnd.uniform(-50, 50), 60.0 * i) for i in range(rnd.randint(1, 6))]
        if k % 9 == 0:
            line.insert(1, line[0])
        rows.append((k, line, rnd.uniform(-60, 60), rnd.uniform(-80, 400), 5.0, 300.0))
    rows.append((900, None, 0.0, 0.0, 3.0, 4.0))
    df = spark.createDataFrame(rows, f"id int, line {XY}, x double, y double, gx double, gy double")
    for r in df.withColumn("got", B.card_yards("line", "gx", "gy", "x", "y")).collect():
        assert abs(r.got - plain_yards([(p.x, p.y) for p in r.line or []], (r.gx, r.gy), (r.x, r.y))) < 1e-9
    assert {r.id for r in df.filter(B.along_line("line", "x", "y")["behind"]).collect()}


def test_tees_and_names(spark):
    square = lambda x, y: [(x - 1, y - 1), (x + 1, y - 1), (x + 1, y + 1), (x - 1, y + 1)]
    boxes = spark.createDataFrame([(1, 1, 1, square(0.0, 0.0)), (1, 2, 1, square(0.0, 30.0)), (1, 3, 1, square(0.0, -25.0)), (1, 4, 1, square(0.0, 150.0)), (1, 5, 2, square(0.0, 0.0)), (1, 6, 1, square(0.0, 10.0))], f"course_id long, feature_id int, hole int, ring {XY}")
    holes = spark.createDataFrame([(1, 1, [(0.0, 0.0), (0.0, 390.0)], 0.0, 400.0)], f"course_id long, hole int, line {XY}, gx double, gy double")
    cards = spark.createDataFrame([(1, 1, 1, " Gold", 425), (1, 1, 2, "Blue", 400), (1, 1, 3, "Blue/White", 390), (1, 1, 4, "BLUE", 372), (1, 1, 5, "White", 380), (1, 1, 6, "", 400), (1, 1, 7, "Red", 0), (1, 1, 8, None, 400)], "course_id long, hole int, ord int, name string, yards int")
    got = {r.feature_id: (r.yards and round(r.yards, 6), r.name) for r in B.name_tee_boxes(boxes, holes, cards).collect()}
    assert got == {1: (400.0, "Blue"), 2: (370.0, "White"), 3: (425.0, "Gold"), 4: (250.0, None), 5: (None, None), 6: (390.0, "Blue")}   # 390 is 10 from both: the longer tee
    assert sorted(r.name for r in B.card_tees(cards).collect()) == ["Blue", "Gold", "White"]


def test_sample_points(spark):
    lines = spark.createDataFrame([(1, [(0.0, 10.0), (0.001, 10.0), (0.001, 10.002)]), (2, [])], f"course_id long, line {XY}")
    greens = spark.createDataFrame([(1, 0.001, 10.002, [(0.01 + k / 1000, 10.01) for k in range(9)])], f"course_id long, x double, y double, ring {XY}")
    feats = spark.createDataFrame([(1, "tee", [(0.5, 0.5), (0.7, 0.9)]), (1, "sand", [(0.1, 0.1)]), (1, "fairway", []), (1, "tee", [(0.6, 0.7)])], f"course_id long, kind string, ring {XY}")
    got = sorted((r.lat, r.lng, r.source) for r in B.sample_points(lines, greens, feats, 50.0).collect())
    m = 0.001 * math.pi / 180 * 6371008.8
    first, second = max(1, math.floor(m * math.cos(math.radians(10)) / 50 + 0.5)), max(1, math.floor(2 * m / 50 + 0.5))
    want = {(10.0, round(0.001 * k / first, 5), "line") for k in range(first)} | {(round(10 + 0.002 * k / second, 5), 0.001, "line") for k in range(second + 1)}
    want |= {(10.01, round(0.01 + k / 1000, 5), "edge") for k in range(0, 9, 2)} | {(0.7, 0.6, "feature")}
    assert got == sorted(want)   # the green's centre is the line's end, the two tees share a place


def grid(spark):
    """A slope of 2 cm up a yard of y on cells two yards wide, a bank beyond the green."""
    cells = [(7, i, j, i * 2.0, j * 2.0, j * 2.0 * 0.02 + (5.0 if abs(i) > 5 else 0.0)) for i in range(-8, 9) for j in range(-8, 9)]
    ring = [(-10.0, -12.0), (10.0, -12.0), (10.0, 12.0), (-10.0, 12.0)]
    return spark.createDataFrame(cells, "green_id int, i int, j int, x double, y double, z double"), spark.createDataFrame([(7, ring)], f"green_id int, ring {XY}")


def test_read_keeps_to_the_green(spark):
    cells, greens = grid(spark)
    assert R.on_green(cells, greens).agg(F.min("x"), F.max("x"), F.max("y")).first() == (-10.0, 10.0, 12.0)
    putts = spark.createDataFrame([(1, 7, 0.0, -6.0, 0.0, 6.0), (2, 7, 8.0, 0.0, -8.0, 0.0), (3, 7, 0.0, 6.0, 0.0, -6.0), (4, 7, 0.0, 0.0, 0.0, 0.2), (5, 7, 90.0, 90.0, 99.0, 99.0), (6, 8, 0.0, 0.0, 5.0, 5.0)], "id int, green_id int, bx double, by double, px double, py double")
    got = {r.id: (r.along_pct, r.across_pct, r.words) for r in R.putt_read(putts, cells, greens, "id", 2.0).collect()}
    pct = round(0.02 / 0.9144 * 100, 1)
    assert got == {1: (pct, 0.0, f"Uphill {pct}% · straight"), 2: (0.0, pct, f"Level · breaks right to left {pct}%"), 3: (-pct, 0.0, f"Downhill {pct}% · straight")}


def test_grid_for_green(spark):
    rnd = random.Random(4)
    greens = [(k % 3, k, rnd.uniform(-200, 200), rnd.uniform(-200, 200)) for k in range(150)]
    grids = [(k % 3, k, rnd.uniform(-200, 200), rnd.uniform(-200, 200)) for k in range(60)] + [(0, 900, greens[0][2], greens[0][3]), (0, 901, greens[0][2], greens[0][3])]
    got = {r.green_id: r.grid_id for r in R.grid_for_green(spark.createDataFrame(greens, "course_id int, green_id int, x double, y double"), spark.createDataFrame(grids, "course_id int, grid_id int, gx double, gy double")).collect()}
    want = {g[1]: min((math.dist(g[2:], q[2:]), q[1]) for q in grids if q[0] == g[0])[1] for g in greens if any(q[0] == g[0] and math.dist(g[2:], q[2:]) <= 25 for q in grids)}
    assert got == want and got[0] == 900


def test_dots_turn_with_the_line(spark):
    dots = spark.createDataFrame([(1, 10, 3.0, 5.0), (1, 11, 0.0, 0.0), (2, 12, 1.0, 1.0)], "player_id int, shot_id int, sx double, sy double")
    t = spark.createDataFrame([(1, 5, 1, 0.0, 0.0, 0.0, 100.0), (1, 5, 2, 0.0, 0.0, 100.0, 0.0), (2, 5, 1, 4.0, 4.0, 4.0, 4.0)], "player_id int, course_id int, hole int, ball_x double, ball_y double, target_x double, target_y double")
    got = {(r.hole, r.shot_id): (r.x, r.y) for r in P.placed_dots(dots, t, ["player_id"]).collect()}
    assert got == {(1, 10): (3.0, 95.0), (1, 11): (0.0, 100.0), (2, 10): (95.0, -3.0), (2, 11): (100.0, 0.0)}
