"""Weather joined to a stream from a table that changes; OSM XML; SQL functions."""

import math

from pyspark.sql import functions as F

from loftline.functions import geo, registered
from loftline.functions import rings as G
from loftline.sources import maps
from loftline.streaming import enrich

Q = "q_id long, course_id long, asof_s long, note string"


def test_table_changes_between_batches(spark, tmp_path):
    src, answers, out, ck = (str(tmp_path / k) for k in ("in", "answers", "out", "ck"))

    def ask(rows):
        spark.createDataFrame(rows, Q).coalesce(1).write.mode("append").parquet(src)

    def answer(rows):
        spark.createDataFrame(rows, enrich.ANSWER).coalesce(1).write.mode("append").parquet(answers)

    def run():
        s = spark.readStream.schema(Q).parquet(src)
        s.writeStream.foreachBatch(enrich.weather_sink(answers, out)).option("checkpointLocation", ck).trigger(availableNow=True).start().awaitTermination(180)
        return {r.q_id: (r.fetched_s, r.stale, r.temp_f, r.due) for r in spark.read.parquet(out).collect()}

    day = 86400
    answer([(1, 1000, 70.0), (2, 1000, None)])
    ask([(1, 1, 1100, "a"), (2, 1, 1900, "a"), (3, 2, 1100, "a"), (4, 2, 1000 + 7 * day, "a"), (5, 2, 1001 + 7 * day, "a"), (6, 3, 5, "a"), (7, 1, 999, "a")])
    first = run()
    assert first == {1: (1000, False, 70.0, None), 2: (1000, True, None, "stale"), 3: (None, None, None, None), 4: (None, None, None, None), 5: (None, None, None, "empty"),
                     6: (None, None, None, "never"), 7: (None, None, None, "never")}
    answer([(1, 1850, 71.5), (3, 0, 50.0), (2, 2000, 60.0), (2, 2100, None)])
    ask([(11, 1, 1900, "b"), (12, 3, 5, "b"), (13, 2, 2050, "b"), (14, 2, 2200, "b")])
    assert run() == first | {11: (1850, False, 71.5, None), 12: (0, False, 50.0, None), 13: (2000, False, 60.0, None), 14: (2000, False, 60.0, None)}


XML = """<?xml version='1.0'?>
<osm>
 <node id="1" lat="1.0" lon="1.0"/><node id="2" lat="1.0" lon="2.0"/>
 <node id="3" lat="2.0" lon="2.0"><tag k="natural" v="tree"/></node>
 <way id="10"><nd ref="1"/><nd ref="2"/><nd ref="99"/><nd ref="3"/><tag k="golf" v="fairway"/></way>
 <way id="11"><nd ref="3"/><nd ref="1"/></way>
 <way id="12"><nd ref="98"/></way>
 <relation id="20"><member type="way" ref="11" role="outer"/><member type="way" ref="10" role="outer"/><member type="way" ref="77" role="inner"/><member type="node" ref="10" role=""/><tag k="natural" v="wood"/></relation>
</osm>
"""


def test_xml_elements_equal_json(spark, tmp_path):
    (tmp_path / "map.xml").write_text(XML)
    got = {(r.type, r.id): r for r in maps.osm_elements(spark, str(tmp_path / "map.xml")).collect()}
    assert set(got) == {("way", 10), ("way", 11), ("way", 12), ("relation", 20)}
    ring = [(p.lat, p.lon) for p in got["way", 10].geometry]
    assert ring == [(1.0, 1.0), (1.0, 2.0), (2.0, 2.0)] and got["way", 12].geometry is None and got["way", 11].tags == {}
    members = [(m.type, m.role, m.geometry and [(p.lat, p.lon) for p in m.geometry]) for m in got["relation", 20].members]
    assert members == [("way", "outer", [(2.0, 2.0), (1.0, 1.0)]), ("way", "outer", ring), ("way", "inner", None), ("node", "", None)]
    f = maps.relation_features(maps.osm_elements(spark, str(tmp_path / "map.xml"))).collect()
    assert [(r.id, r.kind, sorted((p.lat, p.lon) for p in r.ring), r.inner) for r in f] == [(20, "trees", sorted(ring), None)]


def test_functions_in_sql_equal_columns(spark):
    registered.register(spark)
    df = spark.createDataFrame([(34.2, -84.4, 34.3, -84.5, 120.0, 500.0), (0.0, 179.9, 1.0, -179.9, 350.0, 5e5)], "a double, b double, c double, d double, e double, f double")
    sql = spark.sql("SELECT haversine_m(a, b, c, d) AS h, bearing_deg(a, b, c, d) AS r, dest_lat(a, e, f) AS la, dest_lng(a, b, e, f) AS lo, wrap180(e) AS w FROM {df}", df=df).collect()
    own = df.select(geo.haversine_m("a", "b", "c", "d"), geo.bearing_deg("a", "b", "c", "d"), geo.dest_lat("a", "e", "f"), geo.dest_lng("a", "b", "e", "f"), F.lit(0.0)).collect()
    for s, o in zip(sql, own):
        assert all(math.isclose(x, y, rel_tol=1e-12, abs_tol=1e-9) for x, y in zip(s[:4], o[:4])) and -180 <= s.w < 180
    ring = spark.createDataFrame([([(0.0, 0.0), (4.0, 0.0), (4.0, 3.0), (0.0, 3.0)], x / 2, y / 2) for x in range(-1, 10) for y in range(-1, 8)], "ring array<struct<x:double,y:double>>, x double, y double")
    assert spark.sql("SELECT count_if(ring_contains(ring, x, y) <> {c}) AS n, min(ring_area(ring)) AS a FROM {r}", r=ring.withColumn("c", G.contains("ring", "x", "y")), c=F.col("c")).first() == (0, 12.0)
    assert [tuple(r) for r in spark.sql("SELECT half_up(2.345, 2), half_up(-0.5, 0), half_up(NULL, 1)").collect()] == [(2.35, 0.0, None)]
