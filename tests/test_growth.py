"""Steps that once met a question with all readings, an import with all rounds."""

import random

from pyspark.sql import functions as F

from loftline.operators import merges as M
from loftline.operators import weather as W
from loftline.plans import catalog, ingest_plans, rounds_plans
from loftline.plans.data import Data
from loftline.sources import maps, shotlists
from loftline.streaming import running

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def rows_out(df):
    """The most rows that a join of a finished query gave."""
    df.collect()
    nodes, most = [df._jdf.queryExecution().executedPlan()], 0
    while nodes:
        n = nodes.pop()
        name = n.nodeName()
        if name == "AdaptiveSparkPlan":
            nodes.append(n.executedPlan())
            continue
        if name.endswith("QueryStage"):
            nodes.append(n.plan())
            continue
        if "Join" in name:
            most = max(most, n.metrics().apply("numOutputRows").value())
        kids = n.children()
        nodes += [kids.apply(k) for k in range(kids.size())]
    return most


def test_busy_day_of_rounds_is_not_paired(spark):
    r, names = random.Random(4), ["Maple Links Golf Club", "Oak Hill", None, "maple"]
    played = [(1, k, r.choice(names), 5, r.choice([4, 5]), r.randint(70, 75), r.randint(0, 400)) for k in range(400)]
    asked = [(1, k, r.choice(names), r.choice([4, 5]), r.choice([None, *range(70, 78)])) for k in range(300)]
    words = lambda c: {w for w in (c or "").lower().split() if w not in ("links", "golf", "club")}
    alike = lambda a, b: bool(words(a)) and bool(words(b)) and (words(a) <= words(b) or words(b) <= words(a))
    want = {}
    for p, key, course, day, score in asked:
        hits = [(0 if total == score else 1, pos, rid) for q, rid, c, u, lo, total, pos in played if day in (u, lo) and alike(c, course)]
        want[key] = min(hits)[:2] if hits else None
    pl = spark.createDataFrame(played, "player_id long, round_id long, course string, utc_day int, local_day int, total int, pos long")
    im = spark.createDataFrame(asked, "player_id long, key long, course string, day int, score int")
    got = M.match_rounds(im, pl)
    at = {x[1]: x for x in played}
    score = {x[1]: x[4] for x in asked}
    found = {x.key: x.matched for x in got.collect()}
    assert {k: m is not None and (0 if at[m][5] == score[k] else 1, at[m][6]) or None for k, m in found.items()} == want
    assert rows_out(got) <= 1000


def readings(spark, n, seed):
    r = random.Random(seed)
    v = lambda lo, hi: r.choice([None, round(r.uniform(lo, hi), 1), round(r.uniform(lo, hi), 1)])
    rows = [(r.choice([1, 2, None]), r.randint(-90_000, 200_000), v(0, 9), v(50, 80), v(40, 60), v(0, 100), v(0, 12)) for _ in range(n)]
    return rows, spark.createDataFrame(rows, "course_id long, t_s long, rain_mm double, temp_f double, dew_f double, cloud double, wind double")


def figures(rows, course, lo, hi):
    got = [x for x in rows if course is not None and x[0] == course and lo < x[1] <= hi]
    col = lambda f: [y for y in map(f, got) if y is not None]
    mean = lambda v: sum(v) / len(v) if v else None
    rain, spread = col(lambda x: x[2]), col(lambda x: None if None in (x[3], x[4]) else x[3] - x[4])
    return sum(rain) if rain else None, min(spread, default=None), mean(col(lambda x: x[5])), mean(col(lambda x: x[6]))


def near(a, b):
    return a == b or (None not in (a, b) and abs(a - b) < 1e-6)


def test_windows_equal_all_pairs_and_readings_are_not_paired(spark):
    rows, h = readings(spark, 1500, 5)
    r = random.Random(6)
    asked = [(k, r.choice([1, 2, 3, None]), r.choice([r.randint(-95_000, 260_000), rows[k][1]]), r.randint(-60_000, 230_000)) for k in range(300)]
    q = spark.createDataFrame(asked, "q_id long, course_id long, asof_s long, sunrise_s long")
    rain = W.rain_windows(h, q)
    got, night = {x.q_id: x for x in rain.collect()}, {x.q_id: x for x in W.night_block(h, q).collect()}
    for k, course, asof, rise in asked:
        day, half = figures(rows, course, asof - 86400, asof), figures(rows, course, asof - 43200, asof)
        assert near(got[k].rain24, day[0]) and near(got[k].rain12, half[0]) and near(got[k].spread, day[1]) and near(got[k].cloud, day[2]) and near(got[k].wind, day[3])
        dark = figures(rows, course, rise - 28800, min(rise, asof))
        assert all((a is None) == (b is None) and (a is None or abs(a - b) <= 0.0501) for a, b in zip((night[k].spread, night[k].cloud, night[k].wind), dark[1:]))
    assert any(x.rain12 is not None for x in got.values()) and rows_out(W.rain_windows(h, q)) <= 6000


def test_a_round_is_opened_once(spark):
    r = spark.createDataFrame([], shotlists.ROUND + ", key string")
    p = plan(shotlists.flatten(r))
    assert p.count("Generate") == 1 and "Union" not in p


def test_holes_are_neither_dealt_nor_sorted(spark):
    d = Data(spark, SF)
    p = plan(catalog.queries()["score_names"](spark, SF))
    assert p.index("Generate") < p.index("Join")   # the plan stands upside down: the join is done first
    want = d.view("played_v").groupBy("player_id", "round_id", "hole", "s", "par").count()
    assert rounds_plans.played(d).groupBy("player_id", "round_id", "hole", "s", "par").count().exceptAll(want).count() == 0


def test_a_snapshot_has_many_files_and_is_parsed_three_times(spark, monkeypatch):
    monkeypatch.setattr(ingest_plans, "FILE_PARTS", 20)
    d = Data(spark, SF)
    folder = ingest_plans.snapshot(d)
    assert spark.read.text(folder).select(F.input_file_name()).distinct().count() >= 5
    f = maps.relation_features(maps.osm_elements(spark, folder))
    assert "xml" not in f._jdf.queryExecution().executedPlan().toString() and f.count() > 0


def test_rounds_of_a_table_keep_no_state(spark):
    p = plan(running.running_corrections(Data(spark, SF).shots))
    assert "TransformWithState" not in p and "MapInArrow" in p
