"""Rows are streamed past what they are measured against: no sample, cell or pair of both is written."""

import math
import random

import pytest
from pyspark.sql import functions as F

from loftline.functions import rings as G
from loftline.operators import greens as R
from loftline.operators import spatial as P
from loftline.operators.terrain import planes

XY = "array<struct<x:double,y:double>>"


@pytest.fixture
def small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def uneven_greens(spark):
    """Cells off their lattice, with holes, some of them at one place; greens without cells and without a plane."""
    r = random.Random(3)
    cells = [(g, i, j, i * 2.0 + r.choice([0, 0, 0.3]), j * 2.0 + r.choice([0, 0, -0.2]), r.uniform(0, 1)) for g in (1, 2) for i in range(-6, 7) for j in range(-6, 7) if r.random() < 0.8]
    cells += [(1, 40, 40, cells[5][3], cells[5][4], 0.2), (3, 0, 0, 0.0, 0.0, 1.0)]
    rings = [(g, [(-9.0, -9.0), (9.0, -9.0), (9.0, 9.0), (-9.0, 9.0)]) for g in (1, 2, 3, 4)]
    return spark.createDataFrame(cells, "green_id int, i int, j int, x double, y double, z double"), spark.createDataFrame(rings, f"green_id int, ring {XY}")


def test_putts_are_read_as_by_brute_force(spark, small_batches):
    cells, greens = uneven_greens(spark)
    r = random.Random(8)
    putts = [(k, r.choice([1, 2, 3, 4]), *[float(r.randint(-14, 14)) for _ in range(4)]) for k in range(80)]
    one = (900, 1, -19.0, 0.0, -14.5, 0.0)   # few samples near cells of the green
    putts += [putts[0], putts[0], (None, 1, 0.0, 0.0, 6.0, 2.0), (901, 1, None, 0.0, 3.0, 3.0), (902, None, 0.0, 0.0, 3.0, 3.0), one, one, one]
    df = spark.createDataFrame(putts, "id int, green_id int, bx double, by double, px double, py double")
    fit = {(p.green_id, p.i, p.j): (p.b, p.c) for p in planes(R.on_green(cells, greens), keys=("green_id",), at=cells).collect()}
    near = [tuple(c)[:5] for c in cells.collect()]
    want = set()
    for p in putts:
        if None in p[1:] or (ln := math.hypot(p[4] - p[2], p[5] - p[3])) < 0.5:
            continue
        n, hits = max(2, math.ceil(ln)), []
        for t in range(n + 1):
            x, y = p[2] + (p[4] - p[2]) * t / n, p[3] + (p[5] - p[3]) * t / n
            best = min(((round(math.hypot(c[3] - x, c[4] - y), 9), c[1], c[2]) for c in near if c[0] == p[1]), default=(9.0, 0, 0))
            if best[0] <= 4 and (p[1], *best[1:]) in fit:
                hits.append(fit[(p[1], *best[1:])])
        if len(hits) * putts.count(p) >= 2:
            b, c = (sum(h[k] for h in hits) / len(hits) for k in (0, 1))
            ux, uy = (p[4] - p[2]) / ln, (p[5] - p[3]) / ln
            want.add((p[0], p[1], *(math.floor(v / 0.9144 * 1000 + 0.5 + 1e-9) / 10 for v in (b * ux + c * uy, b * uy - c * ux))))
    got = [tuple(g)[:4] for g in R.putt_read(df, cells, greens, "id", 2.0).collect()]
    assert len(got) == len(want) > 30 and set(got) == want


def test_samples_of_putts_are_not_written(spark):
    cells, greens = uneven_greens(spark)
    df = spark.range(5).select("id", F.lit(1).alias("green_id"), *[F.lit(v).alias(k) for k, v in (("bx", -9.0), ("by", 0.0), ("px", 9.0), ("py", 0.0))])
    text = plan(R.putt_read(df, cells, greens, "id", 2.0))
    assert "MapInArrow" in text and "_cells" not in text and "explode(sequence(0, cast(_n" not in text and "_n#" not in text


def test_lines_measure_features_as_by_brute_force(spark, small_batches):
    r = random.Random(6)
    lines = [(c, h, r.uniform(-80, 80), r.uniform(0, 50), r.uniform(-80, 80), r.uniform(100, 200)) for c in (1, 2) for h in (1, 2, 3, None)] + [(1, 9, None, 0.0, 5.0, 5.0), (None, 1, 0.0, 0.0, 9.0, 9.0)]
    feats = []
    for k in range(60):
        x, y, n = r.uniform(-150, 150), r.uniform(-50, 250), r.choice([1, 2, 3, 4, 8])
        feats.append((r.choice([1, 2, 3]), k, "sand", [(x + r.uniform(5, 30) * math.cos(6.28 * i / n), y + 20 * math.sin(6.28 * i / n)) for i in range(n)]))
    feats += [feats[0], (1, feats[1][1], "sand", feats[2][3]), (1, 70, None, []), (1, 71, "tee", None), (1, 72, "tee", [(0.0, 60.0), (0.0, 60.0)])]
    df = spark.createDataFrame(feats, f"course_id long, feature_id long, kind string, ring {XY}")
    ln = spark.createDataFrame(lines, "course_id long, hole int, x0 double, y0 double, x1 double, y1 double")
    x = P.sample_line(ln, 10.0).join(df, "course_id").withColumn("d", F.when(G.contains("ring", "x", "y"), F.lit(0.0)).otherwise(G.edge_distance("ring", "x", "y")))
    want = {tuple(v)[:4]: v.d for v in x.groupBy("course_id", "feature_id", "kind", "hole").agg(F.min("d").alias("d")).filter("d <= 90").collect()}
    found = P.line_distance(ln, df, 90.0)
    got = {tuple(v)[:4]: v.d for v in found.collect()}
    assert len(want) > 60 and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert "MapInArrow" in plan(found) and "SortMergeJoin" not in plan(found) and "BroadcastHashJoin" not in plan(found)


def test_idw_pairs_do_not_grow_with_density(spark):
    r = random.Random(2)
    rows = [(k, r.uniform(0, 8), r.uniform(0, 8), float(k % 13)) for k in range(600)] + [(1000 + k, 4.0, 4.0, float(k)) for k in range(300)]   # all in one cell of eight yards, many at one place
    s = spark.createDataFrame(rows, "ord int, x double, y double, z double")
    q = spark.createDataFrame([(k, r.uniform(0, 8), r.uniform(0, 8)) for k in range(40)] + [(40, 4.0, 4.1), (41, 300.0, 300.0)], "id int, x double, y double")
    want = {}
    for p in q.collect():
        near = sorted((math.hypot(p.x - t[1], p.y - t[2]), t[0], t[3]) for t in rows)[:4]
        want[p.id] = sum(t[2] / t[0] ** 2 for t in near) / sum(1 / t[0] ** 2 for t in near)
    df = P.idw(q, s, "id", snap=0.0)
    assert all(abs(t.z - want[t.id]) < 1e-9 and t.used == 4 for t in df.collect())
    pairs = P.idw_pairs(q, s, "id").groupBy("id").count()
    assert pairs.filter("id < 41").agg(F.max("count")).first()[0] < 200
