"""Large tables are dealt into tasks of a bounded number of rows; places and corrections meet without their pairs."""

import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from loftline.functions import rings as G
from loftline.operators import spatial as P
from loftline.plans import data, merges_plans, review_plans, spatial_plans
from loftline.settings import DEFAULTS


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at, r = str(tmp_path_factory.mktemp("dealt")), random.Random(5)
    orders = [(k, r.randint(1, 40), date(1995, 1, 1 + k % 28)) for k in range(300)]
    lines = [(k, p, r.randint(1, 90), n, float(r.randint(1, 50)), 100.0 * n, r.randint(0, 10) / 100, r.randint(0, 8) / 100, "RNA"[r.randint(0, 2)], "OF"[n % 2], date(1996, 1, 2))
             for k in range(300) for n in range(1, 7) for p in [r.randint(1, 200)]]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderdate date").write.parquet(f"{at}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
                          "l_returnflag string, l_linestatus string, l_shipdate date").write.parquet(f"{at}/lineitem.parquet")
    spark.createDataFrame([(k, k % 50 + 1) for k in range(1, 401)], "p_partkey long, p_size int").coalesce(1).write.parquet(f"{at}/part.parquet")
    return at


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("query", [review_plans.evidence, merges_plans.teach_switch])
def test_lines_are_dealt_by_count(spark, folder, monkeypatch, query):
    want = sorted(map(str, query(data.Data(spark, folder)).collect()))
    monkeypatch.setattr(data, "TASK_ROWS", 100)
    got = query(data.Data(spark, folder))
    assert sorted(map(str, got.collect())) == want
    assert "REPARTITION_BY_NUM" in plan(got) and "Broadcast" not in plan(got)
    assert data.Data(spark, folder).shots.rdd.getNumPartitions() >= 18


def test_parts_of_one_file_become_polygons_in_many_tasks(spark, folder, monkeypatch):
    want = sorted(map(str, spatial_plans.ring_area(data.Data(spark, folder)).collect()))
    monkeypatch.setattr(data, "TASK_PARTS", 50)
    got = spatial_plans.ring_area(data.Data(spark, folder))
    assert sorted(map(str, got.collect())) == want
    assert got.rdd.getNumPartitions() >= 8


def test_centroid_reads_its_sums_once(spark):
    df = spark.range(1).select(F.array(G.pt(F.col("id"), F.lit(0)), G.pt(F.col("id") + 4, F.lit(0)), G.pt(F.col("id"), F.lit(3))).alias("ring")).select(G.centroid("ring").alias("c"))
    assert df.select("c.x", "c.y").first() == (4 / 3, 1.0)
    assert len(df._jdf.queryExecution().analyzed().toString()) < 20_000


def test_green_distances_reads_each_edge_once(spark):
    ring = [(-5.0, -5.0), (5.0, -5.0), (5.0, 5.0), (-5.0, 5.0)]
    rows = [(1, 0.0, -30.0, ring, (0.0, 0.0)), (2, 0.0, 0.0, ring, (0.0, 0.0)), (3, -50.0, -50.0, ring, (0.0, 0.0)), (4, 0.0, 20.0, [(90.0, 90.0), (91.0, 90.0), (91.0, 91.0)], (0.0, 0.0)), (5, 0.0, -1.0, ring, (0.0, 0.0))]
    df = P.green_distances(spark.createDataFrame(rows, "id int, x double, y double, ring array<struct<x:double,y:double>>, ctr struct<x:double,y:double>"))
    got = {r.id: tuple(round(v, 6) for v in (r.front, r.center, r.back)) for r in df.collect()}
    h = 2 ** 0.5
    assert got == {1: (25, 30, 35), 2: (0, 0, 12), 3: (round(45 * h, 6), round(50 * h, 6), round(55 * h, 6)), 4: (8, 20, 32), 5: (6, 1, 6)}
    assert "array_sort" not in df._jdf.queryExecution().analyzed().toString()


@pytest.mark.parametrize("strict", [False, True])
def test_votes_without_pairs(spark, strict, monkeypatch):
    monkeypatch.setattr(P, "BLOCK", 64)   # many small blocks
    r = random.Random(8)
    rows = [(r.choice([1, 2, None]), r.choice([None, *map(float, range(-40, 60, 7))]), float(r.randint(-30, 60)), r.choice(["sand", "rough", None]), r.choice([None, *range(1000)])) for _ in range(400)]
    v = spark.createDataFrame(rows, "course_id int, xm double, ym double, corrected string, t_s long")
    seen = {}
    for c, x, y, lie, t in rows:
        if c is not None and x is not None:
            n, last = seen.get((c, x, y, lie), (0, -1))
            seen[c, x, y, lie] = n + 1, max(last, -1 if t is None else t)
    near = lambda a, b: ((a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2) ** 0.5 <= DEFAULTS.vote_radius_m
    want = {}
    for c, x, y in {k[:3] for k in seen}:
        best = []
        for lie in {k[3] for k in seen}:
            m = [(a[1], a[2], *s) for a, s in seen.items() if a[0] == c and a[3] == lie and near(a[1:3], (x, y))]
            mated = [a for a in m if any(near(a, b) and a[:2] != b[:2] for b in m)]
            if strict:
                m = [a for a in m if a in mated or a[2] >= DEFAULTS.vote_min]
            elif not mated and not any(a[2] >= 2 for a in m):
                continue
            n = sum(a[2] for a in m)
            if n >= DEFAULTS.vote_min:
                best.append((n, max(a[3] for a in m), lie or "", lie))
        if best:
            want[c, x, y] = max(best)[3], max(best)[0]
    df = P.override_vote(v, v, strict=strict)
    assert {(a.course_id, a.qx, a.qy): (a.lie, a.votes) for a in df.collect()} == want
    assert "Join" not in plan(df) and want
