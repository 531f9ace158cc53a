"""Hand-numbered checks of single rules, and properties: permutation, idempotence, batch = stream, fold = brute force."""

import math
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from loftline.functions import rings as G
from loftline.functions.numbers import half_up, normal_cdf
from loftline.operators import history as H
from loftline.operators import merges as M
from loftline.operators import picks as P
from loftline.operators import scoring as S
from loftline.operators import shots as SH
from loftline.operators import skew
from loftline.operators import spatial as SP
from loftline.operators import stats as W
from loftline.operators import strokes as X
from loftline.settings import DEFAULTS
from loftline.sources import maps, shotlists
from loftline.streaming import trails as T


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_settings_merge_keeps_other_keys():
    s = DEFAULTS.merged({"heads_up": {"hist_share": 0.5}, "takeover_n": 10})
    assert s.heads_up["hist_share"] == 0.5 and s.heads_up["today_of"] == 4 and s.takeover_n == 10
    with pytest.raises(KeyError):
        DEFAULTS.merged({"nope": 1})


def test_half_up_goes_toward_plus_infinity(spark):
    df = spark.createDataFrame([(-0.25,), (0.25,), (-2.5,)], "v double")
    assert rows(df.select(half_up("v", 1), half_up("v"))) == [(-0.2, 0.0), (0.3, 0.0), (-2.5, -2.0)]


def test_close_out_right_of_line(spark):
    df = spark.createDataFrame([(0.0, 0.0, 0.0, 100.0, 10.0, 95.0, 5.0, 20.0)], "sx double, sy double, tx double, ty double, ex double, ey double, start_acc_m double, end_acc_m double")
    r = SH.close_out(df).first()
    assert (r.distance_miss_yds, r.lateral_miss_yds, r.on_target, r.curve_auto, r.dist_class, r.low_acc) == (-5.0, 10.0, False, 1, 0, True)


def test_miss_band_edges(spark):
    df = spark.createDataFrame([(7.9,), (8.0,), (-20.0,), (20.1,)], "v double")
    assert [r[0] for r in rows(df.select(SH.miss_band("v")))] == [0, 1, -1, 2]


def test_strokes_for_plus_handicap(spark):
    df = spark.createDataFrame([(18, -1), (1, -1), (1, 19)], "si int, h int")
    assert [r[0] for r in rows(df.select(S.strokes_on("si", "h")))] == [-1, 0, 2]


def test_match_points_and_ties(spark):
    df = spark.createDataFrame([([4] * 18, [4] * 18), ([3] * 18, [4] * 18), ([3] * 17 + [None], [4] * 18)], "scores array<int>, ghost array<int>")
    assert [(r.you, r.opp) for r in S.match_points(df).collect()] == [(4.0, 4.0), (8.0, 0.0), (5.5, 0.0)]


def test_card_fix_second_run_changes_nothing(spark):
    nine = lambda n, p: {"label": n, "pars": [p] * 9, "si": list(range(1, 10))}
    cards = spark.createDataFrame([("C", [nine("Red", 4), nine("Blue", 4)])], "course string, nines array<struct<label:string,pars:array<int>,si:array<int>>>")
    base = spark.createDataFrame([(1, "C", "red / BLUE", [5] * 18, list(range(1, 19)), [4] * 18, 70.0, 113, 90, 0.0, "L", 1.0, 5, None)],
                                 "round_id long, course string, routing string, pars array<int>, stroke_index array<int>, scores array<int>, rating double, slope int, par int, diff_used double, result string, your_points double, updated_at int, card_fix string")
    once = S.fix_cards(base, cards, "c@1", 100)
    r = once.first()
    assert r.action == "changed" and r.par == 72 and r.prev.par == 90 and r.updated_at == 100
    again = S.fix_cards(once.drop("action", "prev"), cards, "c@1", 200).first()
    assert again.action == "already fixed" and again.updated_at == 100


def _weighted_median(pts):
    pts = sorted(pts)
    half, cum = sum(w for _, w in pts) / 2, 0
    for i, (v, w) in enumerate(pts):
        cum += w
        if abs(cum - half) < 1e-9 and i + 1 < len(pts):
            return (v + pts[i + 1][0]) / 2
        if cum > half:
            return v
    return pts[-1][0]


def test_weighted_median_matches_the_walk(spark):
    rnd = random.Random(4)
    data = [(k, float(rnd.randint(-40, 40)), rnd.choice([1.0, 0.5, 0.2])) for k in range(40) for _ in range(rnd.randint(1, 12))]
    got = dict(rows(W.weighted_median(spark.createDataFrame(data, "k int, v double, w double"), ["k"], "v", F.col("w"), "m")))
    for k in range(40):
        assert got[k] == pytest.approx(_weighted_median([(v, w) for a, v, w in data if a == k]))


def test_equal_weights_give_sample_variance(spark):
    df = spark.createDataFrame([(float(v), 1.0) for v in (1, 4, 9, 16)], "x double, w double")
    assert df.agg(*W.moments("x", None, "w")).select(W.w_var()).first()[0] == pytest.approx(df.agg(F.var_samp("x")).first()[0])


def test_halo_equals_plain_window(spark):
    rnd = random.Random(1)
    data = [(i % 3, rnd.randint(0, 5), i, float(rnd.randint(0, 9)), "round", 0) for i in range(120)]
    pool = spark.createDataFrame([(p, y, y * 400 + i, v, k, i) for p, y, i, v, k, _ in data], "player_id int, yr int, day_no int, differential double, kind string, round_id int")
    got = {r.round_id: (r.diff, r.n) for r in H.rolling5(pool).collect()}
    for p in range(3):
        seq = sorted((y * 400 + i, i, v) for a, y, i, v, _, _ in data if a == p)
        for j, (_, i, _) in enumerate(seq):
            last = [v for _, _, v in seq[max(0, j - 4):j + 1]]
            assert got[i] == (math.floor(sum(last) / len(last) * 10 + 0.5) / 10, len(last))


def test_numbered_splits_keep_the_order(spark):
    df = spark.createDataFrame([(0, i // 10, i) for i in range(35)], "k int, b int, v int")
    assert all(r.v + 1 == r.pos for r in skew.numbered(df, ["k"], "b", [F.col("v")]).collect())


def test_merge_ties_and_idempotence(spark):
    sch = "id int, stamp long, body string"
    lo = spark.createDataFrame([(1, 5, "l"), (2, 1, "l")], sch)
    cl = spark.createDataFrame([(1, 5, "c"), (2, 9, "c"), (3, 1, "c")], sch)
    tb = spark.createDataFrame([(3, 1)], "id int, stamp long")
    one = M.last_write_wins(lo, tb, cl)
    assert {r.id: (r.body, r.deleted, r.push) for r in one.collect()} == {1: ("l", False, True), 2: ("c", False, False), 3: (None, True, True)}
    live = one.filter("NOT deleted").select("id", "stamp", "body")
    assert sorted(rows(M.last_write_wins(live, tb, live).filter("NOT deleted").select("id", "stamp", "body"))) == sorted(rows(live))
    up = M.import_upsert(lo, cl)
    assert {r.id: r.action for r in up.collect()} == {1: "unchanged", 2: "updated", 3: "added"}
    done = up.select("id", "stamp", "body")
    assert {r.action for r in M.import_upsert(done, cl).collect()} == {"unchanged"}


def test_isotonic_equals_pool_adjacent_violators(spark):
    rnd = random.Random(2)
    data = [(k, i, round(rnd.uniform(1, 5), 2)) for k in range(12) for i in range(rnd.randint(1, 9))]
    got = {}
    for r in X.isotonic(spark.createDataFrame(data, "k int, x int, y double"), ["k"], "x", "y").collect():
        got.setdefault(r.k, {})[r.x] = r.fit
    for k in range(12):
        blocks = []
        for v in [y for a, _, y in data if a == k]:
            blocks.append([v, 1])
            while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] > blocks[-1][0] / blocks[-1][1]:
                s, n = blocks.pop()
                blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + n]
        want = [s / n for s, n in blocks for _ in range(n)]
        assert [got[k][i] for i in range(len(want))] == pytest.approx(want, abs=2e-6)


def test_normal_cdf(spark):
    assert spark.range(1).select(normal_cdf(F.lit(1.0))).first()[0] == pytest.approx(0.841345, abs=1e-6)


def test_pin_rule_against_a_walk(spark):
    rnd = random.Random(7)
    data = []
    for d in range(60):
        n = rnd.randint(2, 7)
        safe = rnd.randrange(n)
        data += [(d, d * 100 + i, rnd.choice("ABCDE"), "full", round(rnd.uniform(3, 4), 2), rnd.choice([0.3, 0.305, 0.5]), round(rnd.uniform(0, 0.2), 2), float(rnd.randint(130, 170)), i == safe) for i in range(n)]
    df = spark.createDataFrame(data, "d int, ord int, club string, swing string, exp_score double, par_prob double, trouble double, mean_yds double, safe boolean")
    got = {r.d: r.ord for r in P.pin_rule(df, ["d"], F.lit(150.0)).collect()}
    for d in range(60):
        c = [r for r in data if r[0] == d]
        best = max((r[4], r[6]) for r in c if r[8])
        key = lambda r: 2 * (150 - r[7]) if r[7] < 150 else r[7] - 150
        clubs = {}
        for r in c:
            clubs.setdefault(r[2], []).append(r)
        todo = sorted((min(map(key, rs)), k) for k, rs in clubs.items())
        pick = None
        while todo and pick is None:
            k0 = todo[0][0]
            group = [r for v, k in todo if v <= k0 + 2 for r in clubs[k]]
            todo = [t for t in todo if t[0] > k0 + 2]
            ok = [r for r in group if r[6] <= best[1] + 0.05 + 1e-9 and r[4] <= best[0] + 0.5 + 1e-9 and (r[4] <= best[0] + 0.15 + 1e-9 or r[6] <= best[1] - 0.02 + 1e-9)]
            if ok:
                top = max(r[5] for r in ok)
                pick = min((r[4], r[1]) for r in ok if r[5] >= top - 0.01 - 1e-9)[1]
        assert got.get(d) == pick


def test_ring_contains_and_distance(spark):
    df = spark.createDataFrame([(5.0, 5.0), (15.0, 5.0), (10.0, 5.0), (0.0, 5.0)], "x double, y double").withColumn(
        "ring", F.array(G.pt(F.lit(0), F.lit(0)), G.pt(F.lit(10), F.lit(0)), G.pt(F.lit(10), F.lit(10)), G.pt(F.lit(0), F.lit(10))))
    assert rows(df.select(G.contains("ring", "x", "y"), G.distance("ring", "x", "y"))) == [(True, 0.0), (False, 5.0), (False, 0.0), (True, 0.0)]


def test_idw_equals_brute_force(spark):
    rnd = random.Random(3)
    pts = [(i, rnd.uniform(-90, 90) * (0.05 if i % 2 else 1), rnd.uniform(-90, 90), rnd.uniform(0, 9)) for i in range(80)]
    s = spark.createDataFrame(pts, "ord long, x double, y double, z double")
    q = spark.createDataFrame([(i, rnd.uniform(-90, 90), rnd.uniform(-90, 90)) for i in range(25)], "id int, x double, y double")
    got = dict(rows(SP.idw(q, s, "id", cell=20.0).select("id", "z")))
    for i, x, y in rows(q):
        near = sorted((math.hypot(px - x, py - y), o, z) for o, px, py, z in pts)[:4]
        want = near[0][2] if near[0][0] < 1 else sum(z / d ** 2 for d, _, z in near) / sum(1 / d ** 2 for d, _, _ in near)
        assert got[i] == pytest.approx(want)


def test_idw_reaches_any_distance(spark):
    s = spark.createDataFrame([(i, 5000.0 * (i % 4), 5000.0 * (i // 4), float(i)) for i in range(8)], "ord long, x double, y double, z double")
    q = spark.createDataFrame([(1, 10.0, 10.0), (2, 90000.0, -70000.0), (3, 5000.2, 0.1)], "id int, x double, y double")
    got = {r.id: r for r in SP.idw(q, s, "id").collect()}
    assert {i: r.used for i, r in got.items()} == {1: 4, 2: 4, 3: 4} and got[3].z == 1.0
    assert {r.used for r in SP.idw(q, s.limit(2), "id").collect()} == {2} and SP.idw(q, s.limit(0), "id").count() == 0


def _square(x0, y0, x1, y1):
    return [(float(x0), float(y0)), (float(x1), float(y0)), (float(x1), float(y1)), (float(x0), float(y1))]


FEATURE = "course_id long, feature_id long, kind string, f_hole int, ring array<struct<x:double,y:double>>, inner array<array<struct<x:double,y:double>>>"


def test_water_entry_walks_the_whole_line(spark):
    f = spark.createDataFrame([(1, 1, "water", 1, _square(-20, 150, 20, 700), None), (1, 2, "green", 1, _square(-5, 600, 5, 640), None), (1, 3, "water", 2, _square(500, 0, 510, 10), None)], FEATURE)
    shots = [(1, 1, 1, 0.0, 650.0, 0.0, 0.0), (2, 1, 1, 0.0, 500.0, 0.0, 0.0), (3, 1, 1, 0.0, 151.0, 0.0, 150.0), (4, 1, 1, 0.0, 400.0, 0.0, 400.0), (5, 1, 1, 300.0, 0.0, 0.0, 0.0), (6, 1, 2, 0.0, 650.0, 0.0, 0.0)]
    df = spark.createDataFrame(shots, "shot_id long, course_id long, hole int, ex double, ey double, sx double, sy double")
    got = {r.shot_id: (r.x, r.y, r.k0) for r in SP.water_entry(df, f, "shot_id").collect()}
    assert got[1] == (0.0, 638.0, 6)                # an own green inside the water is reached first
    assert got[2] == (0.0, 148.0, 176)              # 352 yards back
    assert got[3] == (0.0, 150.0, None) and got[4] == (0.0, 400.0, None)   # under a step, and no line at all: the ball
    assert 5 not in got and got[6] == (0.0, 148.0, 251)   # another hole's green is no way out


def test_safest_spot_without_hazards(spark):
    g = spark.createDataFrame([(1, 1, "green", 1, _square(0, 0, 10, 10), None), (1, 2, "green", 2, _square(100, 0, 110, 10), None), (2, 3, "green", 1, _square(0, 0, 10, 10), None)], FEATURE)
    h = spark.createDataFrame([(1, 9, "water", 1, _square(12, 0, 20, 10), None)], FEATURE)
    b = spark.createDataFrame([(2, 8, "boundary", 0, _square(-2, -500, 500, 500), None)], FEATURE)
    got = {r.green_id: (r.x, r.y, r.d) for r in SP.safest_spot(g, h, b).collect()}
    assert got[2] == (105.0, 5.0, None) and got[1] == (0.0, 4.0, 12.0) and got[3][0] == 8.0 and got[3][2] == 10.0


def test_pin_on_the_centre_does_not_divide(spark):
    ring = [(0.0, 0.0), (10.0, 0.0), (10.0, 0.0), (0.0, 0.0)]
    df = spark.createDataFrame([(1, ring, (5.0, 0.0), 5.0, 0.0)], "id int, ring array<struct<x:double,y:double>>, ctr struct<x:double,y:double>, x double, y double")
    assert [(r.x, r.y) for r in SP.clamp_inside(df).collect()] == [(5.0, 0.0)]


def test_stitch_rings_closes_reversed_members(spark):
    seg = spark.createDataFrame([(1, "outer", 0, [(0.0, 0.0), (0.0, 1.0)]), (1, "outer", 1, [(0.0, 0.0), (1.0, 1.0), (0.0, 1.0)])],
                                "relation_id long, role string, pos int, pts array<struct<lat:double,lon:double>>")
    r = maps.stitch_rings(seg).collect()
    assert len(r) == 1 and r[0].ring[0] == r[0].ring[-1] and len(r[0].ring) == 4


def test_relations_with_clearings(spark):
    pt = lambda *ps: [{"lat": float(a), "lon": float(b)} for a, b in ps]
    way = lambda role, *ps: {"type": "way", "role": role, "geometry": pt(*ps)}
    rel = [(7, "relation", {"natural": "wood"}, None, [way("outer", (0, 0), (0, 9)), way("inner", (2, 2), (2, 3), (3, 3), (2, 2)), way("outer", (9, 9), (0, 9)), way("outer", (9, 9), (9, 0), (0, 0)), way("outer", (20, 20), (21, 21))]),
           (8, "relation", {"golf": "bunker"}, None, [way("outer", (0, 0), (0, 1))])]
    got = maps.relation_features(spark.createDataFrame(rel, "id long, type string, tags map<string,string>, geometry array<struct<lat:double,lon:double>>, members array<struct<type:string,role:string,geometry:array<struct<lat:double,lon:double>>>>")).collect()
    assert [(r.id, r.kind, len(r.ring), len(r.inner), len(r.inner[0])) for r in got] == [(7, "trees", 4, 1, 3)]


def test_shot_list_folder(spark):
    import json
    import os
    root = tempfile.mkdtemp(prefix="rounds-")
    os.makedirs(f"{root}/2026-01-02-oak")
    doc = {"schema": 1, "complete": True, "round": {"date": "2026-01-02", "yardsPerHoleSP": [400]},
           "driving": [{"hole": 1, "club": "Driver", "yds": 240, "endLie": "fairway", "offlineYds": 7, "side": "left"}],
           "approach": [{"hole": 1, "startYds": 150, "startLie": "deep rough", "club": "7i", "endLie": "green", "missNote": "20' short right", "missTotalFt": 20}],
           "putting": [{"hole": 1, "startFt": 20, "result": "make"}]}
    with open(f"{root}/2026-01-02-oak/shots.json", "w") as f:
        json.dump(doc, f, indent=1)
    out = shotlists.flatten(shotlists.read_rounds(spark, root)).orderBy("shot_no").collect()
    assert [r.category for r in out] == ["driving", "approach", "putting"]
    assert out[0].lateral_miss_yds == -7 and out[0].start_yds == 400 and out[0].key == "2026-01-02-oak"
    assert (out[1].dist_sign, out[1].lat_sign, out[1].miss_total_yds, out[1].lie_detail) == (-1, 1, 6.7, "deep")
    assert out[2].made and out[2].shot_type == "putt" and out[2].id == "sp:2026-01-02:1:3"


def test_unknown_words_fail_loudly(spark):
    with pytest.raises(Exception, match="unknown club"):
        spark.createDataFrame([("wiffle",)], "c string").select(shotlists.map_club(F.col("c"))).collect()


def _walk(spark):
    rnd = random.Random(5)
    pts, t, la, ln = [], 0, 34.0, -84.0
    for i in range(300):
        t += rnd.choice([1, 2, 4])
        if (i // 30) % 2:
            la += 0.00002
        pts.append((1, i, t, la + rnd.uniform(-1, 1) * 1e-6, ln, 5.0))
    return spark.createDataFrame(pts, "player_id long, event_id long, t_s long, lat double, lng double, acc_m double").withColumn("day", F.to_date(F.lit("2026-01-01")))


def _stream(spark, df, parts, query, name):
    """Feeds the rows part by part through a streaming query and returns what it wrote."""
    src, ck = tempfile.mkdtemp(prefix="src-"), tempfile.mkdtemp(prefix="ck-")
    timed = df.withColumn("ts", F.timestamp_seconds("t_s"))
    for part in parts:
        timed.filter(part).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(timed.schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = query(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", ck).trigger(availableNow=True).start()
    q.awaitTermination(180)
    return spark.table(name).collect()


def _two_days(spark):
    """The walk of two players over midnight, 1,400 fixes each, and a last far fix that moves the watermark on."""
    rnd = random.Random(8)
    pts, n = [], 0
    for player in (1, 2):
        t, la = 86400 - 1500, 34.0 + player
        for i in range(1400):
            t += rnd.choice([1, 2, 4])
            la += 0.00002 * ((i // 30) % 2)
            n += 1
            pts.append((player, n, t, la + rnd.uniform(-1, 1) * 1e-6, -84.0, 5.0))
    pts.append((3, n + 1, 86400 * 4, 0.0, 0.0, 5.0))
    pts.append((3, n + 2, 86400 * 6, 0.0, 0.0, 5.0))
    df = spark.createDataFrame(pts, "player_id long, event_id long, t_s long, lat double, lng double, acc_m double")
    return df.withColumn("day", F.to_date(F.timestamp_seconds("t_s"))), [F.col("t_s") < 86400 - 600, (F.col("t_s") >= 86400 - 600) & (F.col("t_s") < 86400 + 900), (F.col("t_s") >= 86400 + 900) & (F.col("player_id") < 3), (F.col("player_id") == 3) & (F.col("t_s") < 86400 * 5), F.col("t_s") >= 86400 * 5]


def test_thin_batch_equals_stream(spark):
    df, parts = _two_days(spark)
    want = sorted(r.event_id for r in T.thin(df).collect())
    got = _stream(spark, df, parts, lambda s: T.stream_thin(s.withWatermark("ts", "1 hour")), "thinned")
    assert sorted(r.event_id for r in got) == want and len(want) > 900


def test_stops_batch_equals_stream_and_plain_loop(spark):
    df, parts = _two_days(spark)
    want = sorted((r.player_id, r.t0, r.t1, r.n) for r in T.stops(df).collect())
    got = _stream(spark, df, parts, lambda s: T.stream_stops(s.withWatermark("ts", "1 hour")), "stopped")
    assert sorted((r.player_id, r.t0, r.t1, r.n) for r in got) == want and len(want) > 20
    plain = []
    for key in {(r.player_id, r.day) for r in df.collect()}:
        fx = [r for r in sorted(df.collect(), key=lambda r: (r.t_s, r.event_id)) if (r.player_id, r.day) == key]
        a = 0
        for b in range(1, len(fx) + 1):   # fixes a..b-1 are near each other
            far = [k for k in range(a, b) if b < len(fx) and T.metres(fx[k].lat, fx[k].lng, fx[b].lat, fx[b].lng) > 6.0]
            if b == len(fx) or far:
                if fx[b - 1].t_s - fx[a].t_s >= 15:
                    plain.append((key[0], fx[a].t_s, fx[b - 1].t_s, b - a))
                    a = b
                elif far:
                    a = far[-1] + 1
    assert want == sorted(plain)


def test_rest_holds_few_fixes():
    rest = T.Rest(T.DEFAULTS)
    for t in range(20000):
        rest.take(t, 34.0 + (t % 3) * 1e-6, -84.0, 4.0)
    assert len(rest.s["fixes"]) + len(rest.s["places"]) < 20 and rest.stop()[2] == 20000


def test_holes_and_close_expire(spark):
    df, parts = _two_days(spark)
    near = df.withColumn("near_hole", F.when(F.col("event_id") % 40 == 0, ((F.col("event_id") / 40).cast("int") % 9 + 1)))
    got = _stream(spark, near, parts, lambda s: T.stream_holes(s.withWatermark("ts", "1 hour"), length=9), "holes")
    assert [r.hole for r in sorted((r for r in got if r.player_id == 1), key=lambda r: r.t_s)][:4] == [2, 3, 4, 5]
    pos = df.filter("event_id % 100 = 0").withColumn("hole", F.lit(1))
    got = _stream(spark, pos, parts, lambda s: T.stream_close(s.withWatermark("ts", "1 hour")), "closed")
    assert {r.player_id for r in got} == {1, 2} and len(got) == 26


def test_ids_once(spark):
    df, parts = _two_days(spark)
    twice = df.unionByName(df)
    got = _stream(spark, twice, parts, lambda s: T.once_per_id(s, "1 hour"), "once")
    assert sorted(r.event_id for r in got) == sorted(r.event_id for r in df.collect())


def test_stops_found_on_pauses(spark):
    s = T.stops(_walk(spark)).orderBy("t0").collect()
    assert len(s) == 5 and all(r.t1 - r.t0 >= 15 for r in s)


def test_match_stops_is_one_to_one(spark):
    sch = "player_id long, day string, t0 long, lat double, lng double"
    st = spark.createDataFrame([(1, "d", 0, 34.0, -84.0), (1, "d", 9, 34.00003, -84.0), (1, "d", 20, 34.01, -84.0)], sch)
    # two holes of a day, each with its own shot 1
    x = spark.createDataFrame([(1, "d", 34.00002, -84.0, 71, 1), (1, "d", 34.01, -84.0, 72, 1)], "player_id long, day string, lat double, lng double, shot_id long, shot_no int")
    assert {r.t0: r.shot_id for r in T.match_stops(st, x).collect()} == {0: None, 9: 71, 20: 72}


def test_match_stops_equals_plain_greedy(spark):
    rnd = random.Random(12)
    st = [(p, "d", i, 60.0 + rnd.uniform(0, 4e-4), 20.0 + rnd.uniform(0, 8e-4)) for p in (1, 2) for i in range(40)]
    xs = [(p, "d", 60.0 + rnd.uniform(0, 4e-4), 20.0 + rnd.uniform(0, 8e-4), p * 1000 + i, i % 5) for p in (1, 2) for i in range(50)]
    got = {(r.player_id, r.t0): r.shot_id for r in T.match_stops(spark.createDataFrame(st, "player_id long, day string, t0 long, lat double, lng double"),
                                                                 spark.createDataFrame(xs, "player_id long, day string, lat double, lng double, shot_id long, shot_no int")).collect()}
    want, used = {(p, t): None for p, _, t, *_ in st}, set()
    for yds, p, t, sid in sorted((T.metres(a, b, c, d) / 0.9144, p, t, sid) for p, _, t, a, b in st for q, _, c, d, sid, _ in xs if p == q):
        if yds <= 8 and want[p, t] is None and sid not in used:
            want[p, t] = sid
            used.add(sid)
    assert got == want and len(used) > 10


def test_next_shot_no(spark):
    rows_ = [(1, 1, 1, 1, 34.0, False), (1, 1, 1, 2, None, False), (1, 1, 1, 3, None, False), (1, 1, 2, 1, 34.0, False), (1, 1, 2, 4, None, True)]
    got = T.next_shot_no(spark.createDataFrame(rows_, "player_id long, round_id long, hole int, shot_no int, lat double, placed boolean")).collect()
    assert {r.hole: r.shot_no for r in got} == {1: 2, 2: 5}


def test_mirror_sink_replay_is_harmless(spark):
    out, small = tempfile.mkdtemp(prefix="mirror-"), tempfile.mkdtemp(prefix="mirror-")
    sink = T.mirror_sink(out)
    sch = "id int, stamp long, body string"
    sink(spark.createDataFrame([(1, 1, "a"), (2, 5, "b")], sch), 0)
    for _ in range(2):
        sink(spark.createDataFrame([(1, 2, "a2"), (2, 3, "old")], sch), 1)
    want = [(1, 2, "a2"), (2, 5, "b")]
    assert sorted(rows(T.mirror_table(spark, out).select("id", "stamp", "body"))) == want
    spark.sparkContext.setLocalProperty("sql.streaming.queryId", "another")   # a new query over a table that exists
    sink(spark.createDataFrame([(3, 1, "c")], sch), 0)
    spark.sparkContext.setLocalProperty("sql.streaming.queryId", None)
    assert sorted(rows(T.mirror_table(spark, out).select("id", "stamp", "body"))) == [*want, (3, 1, "c")]
    T.compact_mirror(spark, out, small)
    assert T.mirror_table(spark, small).count() == 3
