"""Hand-numbered cases of the smaller operators."""

import json

from pyspark.sql import functions as F

from loftline.operators import courses as K
from loftline.operators import picks
from loftline.operators import spatial as P
from loftline.operators import stats, weather
from loftline.streaming import trails as T


def test_responses(spark):
    docs = [{"course_id": 1, "current": {"time": 1000, "wind_speed_10m": 10.0, "wind_direction_10m": -90.0, "temperature_2m": 20.0, "dew_point_2m": 10.0}, "current_units": {"wind_speed_10m": "km/h", "temperature_2m": "°C"},
             "daily": {"time": [0, 86400], "precipitation_sum": [1.26, 9.0], "temperature_2m_max": [20.0, 30.0], "sunrise": [21600, 108000]}, "daily_units": {"temperature_2m_max": "°C"}},
            {"course_id": 2, "current": {"time": 7 * 86400 + 5, "wind_speed_10m": 3.0, "wind_direction_10m": 10.0}, "daily": {"time": [86400 * k for k in range(9)], "precipitation_sum": [float(k) for k in range(9)], "temperature_2m_max": [None] * 9, "sunrise": list(range(9))}},
            {"course_id": 3, "current": {"time": 5, "wind_speed_10m": 3.0}}, {"course_id": 4}]
    df = spark.createDataFrame([(json.dumps(x),) for x in docs] + [("no json",), (None,)], "j string")
    cur = {r.course_id: r for r in weather.parse_current(df, "j").collect()}
    assert set(cur) == {1, 2} and (cur[1].wind_mph, cur[1].wind_from_deg, cur[1].temp_f, cur[1].dew_f) == (6.2, 270.0, 68.0, 50.0) and cur[2].temp_f is None and cur[2].wind_mph == 3.0
    day = {r.course_id: (r.sunrise_s, r.rain_days, r.tmax_days) for r in weather.parse_daily(df, "j").collect()}
    assert day[1] == (21600, [], []) and day[2] == (7, [2.0, 3.0, 4.0, 5.0, 6.0], [None] * 5) and day[4][0] is None


def test_tee_point_where_no_box(spark):
    pts = spark.createDataFrame([(1, 1, 1, 0.0, 0.0), (2, 1, 1, 0.0, 40.0), (3, 1, 2, 0.0, 0.0), (4, 1, 2, 0.0, 16.0), (5, 1, 3, 0.0, 0.0), (6, 1, 1, 100.0, 0.0)], "id int, course_id long, hole int, x double, y double")
    box = [(1, 10, "tee", 1, [(-5.0, -5.0), (5.0, -5.0), (5.0, 5.0), (-5.0, 5.0)], None), (1, 11, "tee", 9, [(95.0, -5.0), (105.0, -5.0), (105.0, 5.0)], None)]
    tees = spark.createDataFrame(box, "course_id long, feature_id int, kind string, f_hole int, ring array<struct<x:double,y:double>>, inner array<array<struct<x:double,y:double>>>")
    at = spark.createDataFrame([(1, 1, 0.0, 40.0), (1, 2, 0.0, 1.0)], "course_id long, hole int, tee_x double, tee_y double")
    assert {r.id: r.on_tee for r in P.near_tee(pts, tees, at, "id", 15.0).collect()} == {1: True, 2: False, 3: True, 4: True, 5: False, 6: False}


def test_costly_moves(spark):
    rows = [(k, "a" if k < 30 else "b", k % 2 == 0, k / 40) for k in range(40)]
    got = picks.costly_moves(spark.createDataFrame(rows, "call_id int, lie string, moved boolean, cost double"), ["lie"], top=3).orderBy("lie", "place").collect()
    assert [(r.lie, r.place, r.call_id, r.costly) for r in got] == [("a", 1, 28, 8), ("a", 2, 26, 8), ("a", 3, 24, 8), ("b", 1, 38, 5), ("b", 2, 36, 5), ("b", 3, 34, 5)]


def test_composed_tee(spark):
    nine = lambda label, p, s: (label, [p] * 9, [100] * 9, s)
    df = spark.createDataFrame([([nine("A", 4, list(range(9, 0, -1))), nine("B", 3, list(range(1, 10)))],)], "nines array<struct<label:string,pars:array<int>,yards:array<int>,si:array<int>>>")
    t = df.select(F.explode(K.nine_combos("nines", ordered=True)).alias("c"), "nines").select(K.composed_tee("nines", "c", F.lit(70.5), F.lit(121)).alias("t")).collect()
    assert [(r.t.label, r.t.par_total, r.t.si[:2], r.t.si[9:11], r.t.rating) for r in t] == [("A / B", 63, [17, 15], [2, 4], 70.5), ("B / A", 63, [1, 3], [18, 16], 70.5)]
    same = df.select(K.composed_tee("nines", F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit("x").alias("label")), F.lit(1.0), F.lit(1)).alias("t")).first()
    assert same.t is None


def test_median_of_pairs(spark):
    cases = [[(1.0, 1.0), (2.0, 1.0)], [(3.0, 0.5), (1.0, 2.0)], [(None, 9.0), (5.0, 1.0)], [], [(1.0, 1.0), (1.0, 1.0), (2.0, 2.0), (7.0, 1.0)]]
    df = spark.createDataFrame([(k, c) for k, c in enumerate(cases)], "id int, a array<struct<v:double,w:double>>")
    own = {r.id: r.m for r in df.select("id", stats.weighted_median_of(F.col("a")).alias("m")).collect()}
    rows = df.select("id", F.explode("a").alias("p")).select("id", "p.v", "p.w")
    other = {r.id: r.m for r in stats.weighted_median(rows, ["id"], "v", F.col("w"), "m").collect()}
    assert own == {k: other.get(k) for k in range(len(cases))}


def test_late_fix_is_dropped(spark, tmp_path):
    """S-08: what comes a trigger after the watermark has passed its window is counted in none."""
    src, schema = str(tmp_path / "in"), "ts timestamp, event_type string, value double"
    for part in ([("2026-01-01 10:00:00", "fix", 1.0)], [("2026-01-01 12:00:00", "fix", 1.0)], [("2026-01-01 12:01:00", "fix", 1.0)], [("2026-01-01 10:05:00", "fix", 100.0), ("2026-01-01 11:55:00", "fix", 1.0)], [("2026-01-01 20:00:00", "fix", 1.0)], [("2026-01-01 20:00:01", "fix", 1.0)]):
        spark.createDataFrame(part, "ts string, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(src)
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    T.counts_per_window(s, "1 hour", late="30 minutes").writeStream.format("memory").queryName("late").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination(180)
    got = {r.h: (r.n, r.total) for r in spark.table("late").select(F.date_format("start", "HH").alias("h"), "n", "total").collect()}
    assert got == {"10": (1, 1.0), "11": (1, 1.0), "12": (2, 2.0)}
