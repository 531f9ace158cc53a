"""Running corrections: the stream after every trigger equals the batch rules over what has come so far."""

import random

from pyspark.sql import functions as F

from loftline.operators import review as V
from loftline.settings import DEFAULTS
from loftline.streaming import running

SHOT = ("player_id long, round_id long, hole int, shot_id long, ts_s long, shot_type string, club string, lie string, intended_yds double, "
        "dist_miss_yds double, lat_miss_yds double, contact int, teach boolean, logged string, end_assumed boolean")


def shot(i, t, player=1, round_id=1, dist=None, lat=0.0, contact=None, club="7i", lie="fairway", **over):
    row = dict(player_id=player, round_id=round_id, hole=1 + i % 18, shot_id=i, ts_s=t, shot_type="full", club=club, lie=lie, intended_yds=150.0,
               dist_miss_yds=dist, lat_miss_yds=lat, contact=contact, teach=None, logged="full", end_assumed=None) | over
    return tuple(row.values())


def batch(spark, rows):
    got = V.corrections(V.evidence(spark.createDataFrame(rows, SHOT))).collect()
    out = {}
    for r in got:
        out.setdefault((r.player_id, r.round_id), []).append((r.kind, r.key, r.axis, r.dir, r.n, r.mean_miss and round(r.mean_miss, 6), r.raw_shift and round(r.raw_shift, 6)))
    return {k: sorted(v) for k, v in out.items()}


def run(spark, tmp_path, parts):
    """What each trigger gives, a file a trigger."""
    src, seen = str(tmp_path / "in"), []
    for part in parts:
        timed = spark.createDataFrame(part, SHOT).withColumn("ts", F.timestamp_seconds("ts_s"))
        timed.coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(timed.schema).option("maxFilesPerTrigger", 1).parquet(src).withWatermark("ts", "30 minutes")

    def keep(df, epoch):
        rows = df.collect()
        if rows or epoch < len(parts):
            seen.append({(r.player_id, r.round_id): (r.n_shots, sorted((x.kind, x.key, x.axis, x.dir, x.n, x.mean_miss and round(x.mean_miss, 6), x.raw_shift and round(x.raw_shift, 6)) for x in r.corrections)) for r in rows})
    q = running.running_corrections(stream, idle_s=4 * 3600).writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(300)
    return seen


def test_every_prefix_equals_batch(spark, tmp_path):
    rnd = random.Random(2)
    rows = []
    for i in range(60):
        rows.append(shot(i, 1000 + 240 * i, player=1 + i % 2, round_id=1 + i % 3, dist=rnd.choice([-20.0, -12.0, 0.0, 0.0, 15.0, None]), lat=rnd.choice([-9.0, 0.0, 0.0, 8.0]),
                         contact=rnd.choice([None, -1, 0, 0, 2]), club=rnd.choice(["7i", "6i", "PW"]), lie=rnd.choice(["fairway", "rough", None]), logged=rnd.choice(["full", "full", "skipped"])))
    parts = [rows[k:k + 15] for k in range(0, 60, 15)]
    late = parts[1].pop(12)           # comes a part later, within the watermark: its place is by time
    parts[2].append(late)
    again = list(parts[2][12])         # a shot sent again with another miss
    again[9] = -25.0 if again[9] != -25.0 else 25.0
    parts[3].append(tuple(again))
    seen = run(spark, tmp_path, parts)
    state = {}
    for k in range(4):
        state |= seen[k]
        now = {}
        for r in (x for p in parts[:k + 1] for x in p):
            now[r[3]] = r
        want = batch(spark, list(now.values()))
        assert {g: c for g, (_, c) in state.items() if c} == want
    assert any(c for _, c in state.values())


def test_too_late_and_expired(spark, tmp_path):
    miss = dict(dist=-20.0)
    parts = [[shot(1, 100_000, **miss), shot(2, 100_100, **miss)], [shot(3, 110_000, player=2, **miss)],
             [shot(4, 100_050, **miss), shot(5, 110_010, **miss)],   # 4 is behind the watermark of 108,200
             [shot(6, 140_000, player=2, **miss)], [shot(7, 140_010, **miss)], [shot(8, 140_020, **miss)]]
    seen = run(spark, tmp_path, parts)
    counts = [s[1, 1][0] for s in seen if (1, 1) in s]
    assert counts == [2, 3, 1, 2]   # the fourth shot is dropped; four idle hours forget the round


def test_batch_form_gives_each_round_once(spark):
    rows = [shot(i, 100 * i, dist=-20.0) for i in range(4)] + [shot(9, 5, player=3, dist=0.0)]
    got = {(r.player_id, r.round_id): r for r in running.running_corrections(spark.createDataFrame(rows, SHOT)).collect()}
    assert got[1, 1].n_shots == 4 and {x.axis for x in got[1, 1].corrections} == {"distance"} and got[3, 1].corrections == []
    assert running.running_corrections(spark.createDataFrame([], SHOT)).count() == 0
    assert running.standing([("lie", "rough", "contact", 1, 1, True, 0, None), ("lie", "rough", "contact", 2, 2, True, 0, None), ("lie", "rough", "contact", 3, 3, False, 1, None)], 2) == {("lie", "rough", "contact"): [(3, 1, None)]}
    assert DEFAULTS.clear_after == 2
