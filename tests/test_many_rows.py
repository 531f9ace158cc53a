"""Steps whose rows multiply: nothing that explode made is broadcast, and cells keep only what can decide."""

import random

import pytest
from pyspark.sql import functions as F

from loftline.functions import rings as G
from loftline.operators import spatial as P
from loftline.plans import catalog
from loftline.plans.data import Data

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def sent(text):
    """The parts of a plan under a broadcast."""
    lines, out = text.split("\n"), []
    for k, line in enumerate(lines):
        if "BroadcastExchange" in line:
            depth = len(line) - len(line.lstrip(" :+-"))
            for x in lines[k + 1:]:
                if len(x) - len(x.lstrip(" :+-")) <= depth:
                    break
                out.append(x)
    return "\n".join(out)


@pytest.mark.parametrize("name", ["inferred_putts", "reconcile", "short_game_bands", "aggression_scorecard", "chip_outcome", "hole_review",
                                  "ellipse_trouble", "landing_dots", "landing_tones", "surface_classify", "water_entry", "zonal_shift", "lie_confidence"])
def test_nothing_that_explode_made_is_broadcast(spark, name):
    assert "Generate explode" not in sent(plan(catalog.queries()[name](spark, SF)))


def squares(spark, n, seed):
    """Squares that overlap, on one course."""
    r = random.Random(seed)
    kinds = ["green", "sand", "water", "tee", "trees", "fairway"]
    rows = []
    for k in range(n):
        x, y, a = r.uniform(-60, 60), r.uniform(-60, 60), r.uniform(3, 25)
        rows.append((1, k, r.choice(kinds), r.randint(1, 3), x, y, a))
    f = spark.createDataFrame(rows, "course_id long, feature_id long, kind string, f_hole int, cx double, cy double, a double")
    ring = lambda k: F.array(*[G.pt(F.col("cx") + i * k * F.col("a"), F.col("cy") + j * k * F.col("a")) for i, j in ((1, 1), (-1, 1), (-1, -1), (1, -1))])
    inner = F.when(F.col("feature_id") % 3 == 0, F.array(ring(0.4))).otherwise(F.array().cast("array<array<struct<x:double,y:double>>>"))
    return f.select("course_id", "feature_id", "kind", "f_hole", ring(1.0).alias("ring"), inner.alias("inner"))


def places(spark, n, seed):
    r = random.Random(seed)
    return spark.createDataFrame([(k, 1, r.randint(1, 3), r.uniform(-90, 90), r.uniform(-90, 90)) for k in range(n)], "id long, course_id long, hole int, x double, y double")


def test_nearest_equals_all_pairs_and_meets_few(spark):
    f, p = squares(spark, 800, 1), places(spark, 60, 2)
    d = F.when(P.inside(), F.lit(0.0)).otherwise(G.edge_distance("ring", "x", "y"))
    pairs = p.join(f, "course_id").withColumn("d", d).filter("d <= 20")
    want = {(r.id, r.kind): (round(r.m.d, 9), r.m.feature_id) for r in pairs.groupBy("id", "kind").agg(F.min(F.struct("d", "feature_id")).alias("m")).collect()}
    got = {(r.id, r.kind): (round(r.dist, 9), r.feature_id) for r in P.nearest(p, f, "id", 20.0).collect()}
    assert got == want and len(got) > 150
    met = P._with_nearest(p, f, 20.0, ["kind"], "feature_id").count()
    assert met < pairs.count() / 2


def test_cells_test_only_what_can_decide(spark):
    f = squares(spark, 400, 3)
    _, fine = P._known(f)
    tested = fine.agg(F.avg(F.size("test"))).first()[0]
    edges = P.cover(f)[1].filter("_edge").groupBy("course_id", "_cx", "_cy").count().agg(F.avg("count")).first()[0]
    assert tested < edges / 3
