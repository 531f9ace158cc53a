"""Running corrections of a round (S-05): what W-02 and W-04 say of the shots so far, kept up while the round is played.

Which misses a shot logs, for which group and axis, is plain columns (``review.miss_rows``) and needs no state.  What
stands and what it adds up to depends on the order of all of a round's shots, also of those that come late or are sent
again; these few rows are a round's state, and a timer ends it.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from loftline.operators.review import miss_rows
from loftline.settings import DEFAULTS, Settings

#: The state store that keeps several states of a key.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CORRECTION = "struct<kind:string,key:string,axis:string,dir:int,n:bigint,mean_miss:double,raw_shift:double>"
OUT = f"player_id long, round_id long, as_of_s long, n_shots int, corrections array<{CORRECTION}>"


def standing(rows: list[tuple], clear_after: int) -> dict[tuple, list[tuple]]:
    """(kind, key, axis) -> the (shot_id, dir, miss) after the last run of ``clear_after`` good ones; rows are (kind, key, axis, ts_s, shot_id, ok, dir, miss)."""
    groups = defaultdict(list)
    for kind, key, axis, *rest in rows:
        groups[kind, key, axis].append(rest)
    out = {}
    for name, g in groups.items():
        g.sort(key=lambda r: r[:2])
        start = max((i + 1 for i in range(len(g)) if g[i][2] and i >= clear_after - 1 and g[i - clear_after + 1][2]), default=0)
        out[name] = [(shot, d, miss) for _, shot, _, d, miss in g[start:] if d]
    return out


def correct(evidence: dict[tuple, list[tuple]], cfg: Settings) -> list[dict]:
    """W-04 over one round's evidence: enough misses one way, more than the other; lie groups inside a family group go."""
    found = {}
    for name, g in evidence.items():
        sides = {d: [r for r in g if r[1] == d] for d in (-1, 1)}
        d = -1 if len(sides[-1]) > len(sides[1]) else 1
        if len(sides[d]) >= cfg.evidence_min and len(sides[d]) > len(sides[-d]):
            miss = [m for *_, m in sides[d] if m is not None]
            found[name] = d, len(sides[d]), sum(miss) / len(miss) if miss else None, {r[0] for r in sides[d]}
    family = [(axis, d, ids) for (kind, _, axis), (d, _, _, ids) in found.items() if kind == "family"]
    return [{"kind": kind, "key": key, "axis": axis, "dir": d, "n": n, "mean_miss": mean, "raw_shift": None if mean is None else -cfg.within_round_fraction * mean}
            for (kind, key, axis), (d, n, mean, ids) in sorted(found.items())
            if not (kind == "lie" and any(a == axis and e == d and ids <= f for a, e, f in family))]


class RoundCorrections(StatefulProcessor):
    """State: a list of the round's rows in the order they came; of rows for one shot, group and axis the last counts."""

    def __init__(self, cfg: Settings = DEFAULTS, idle_ms: int | None = None):
        self.cfg, self.idle_ms = cfg, idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", "shot_id long, kind string, key string, axis string, ts_s long, ok boolean, dir int, miss double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        gone = timerValues.getCurrentWatermarkInMs() if self.idle_ms is not None else None
        new = [(int(r.shot_id), r.kind, r.key, r.axis, int(r.ts_s), bool(r.ok), None if pd.isna(r.dir) else int(r.dir), None if pd.isna(r.miss) else float(r.miss))
               for pdf in rows for r in pdf.itertuples(index=False) if gone is None or r.ts_s * 1000 >= gone]   # what the watermark has passed is dropped
        old = [tuple(r) for r in self.rows.get()] if self.rows.exists() else []
        if gone is not None and old and max(r[4] for r in old) * 1000 + self.idle_ms <= gone:
            old = []   # the timer of this trigger comes after its rows
        if not new and not old:
            return
        held = {r[:4]: r for r in old + new}
        if self.idle_ms is not None:
            self.rows.put(list(held.values()))
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at[0] if isinstance(at, tuple) else at)
            self.handle.registerTimer(max(max(r[4] for r in held.values()) * 1000 + self.idle_ms, gone + 1))
        yield pd.DataFrame({"player_id": [key[0]], "round_id": [key[1]], "as_of_s": [max(r[4] for r in held.values())], "n_shots": [len({r[0] for r in held.values()})],
                            "corrections": [correct(standing([(*r[1:5], r[0], *r[5:]) for r in held.values()], self.cfg.clear_after), self.cfg)]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.rows.clear()
        return iter(())

    def close(self) -> None:
        pass


def _store(spark: SparkSession) -> None:
    """A session that names no store for several states a key gets one that has them."""
    if "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass"):
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    _ = spark.streams.active   # a batch run needs the store's coordinator as well


def running_corrections(shots: DataFrame, idle_s: int = 12 * 3600, cfg: Settings = DEFAULTS) -> DataFrame:
    """S-05: (player_id, round_id, as_of_s, n_shots, corrections) of each round that got shots, as of the shots so far.

    ``shots`` is a stream with a watermark on ``ts``, or a table, which gives each round once and as it ends.  A round's
    latest row holds: readers keep it by (player_id, round_id).  ``n_shots`` counts the shots that say something of a
    miss.  A late shot takes its place by time; one that the watermark has passed is dropped.  A round is forgotten
    ``idle_s`` after its last shot.
    """
    live = miss_rows(shots, cfg)
    if not live.isStreaming:
        return _whole(live, cfg)
    _store(shots.sparkSession)
    got = live.groupBy("player_id", "round_id").transformWithStateInPandas(RoundCorrections(cfg, idle_s * 1000), OUT, "update", "eventTime")
    return got.select("player_id", "round_id", "as_of_s", "n_shots", "corrections")


def _whole(live: DataFrame, cfg: Settings) -> DataFrame:
    """The rounds of a table, each as it ends: all rows of a round are there, so no state is kept and rounds go through Python in batches."""
    fields = ("shot_id", "kind", "key", "axis", "ts_s", "ok", "dir", "miss")
    rows = live.groupBy("player_id", "round_id").agg(F.collect_list(F.struct(*fields)).alias("rows"))

    def ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held_in, as_of, shots, found = b.column("rows"), [], [], []
            flat = list(zip(*(c.to_pylist() for c in held_in.flatten().flatten())))
            ends = held_in.value_lengths().to_numpy(zero_copy_only=False).cumsum().tolist()
            for start, end in zip([0, *ends], ends):
                held = {r[:4]: r for r in flat[start:end]}   # of rows for one shot, group and axis the last counts
                as_of.append(max(r[4] for r in held.values()))
                shots.append(len({k[0] for k in held}))
                found.append(correct(standing([(*r[1:5], r[0], *r[5:]) for r in held.values()], cfg.clear_after), cfg))
            yield pa.RecordBatch.from_arrays([b.column("player_id"), b.column("round_id"), pa.array(as_of, pa.int64()), pa.array(shots, pa.int32()), pa.array(found, kind)],
                                             ["player_id", "round_id", "as_of_s", "n_shots", "corrections"])

    kind = pa.list_(pa.struct([("kind", pa.string()), ("key", pa.string()), ("axis", pa.string()), ("dir", pa.int32()), ("n", pa.int64()), ("mean_miss", pa.float64()), ("raw_shift", pa.float64())]))
    return rows.mapInArrow(ended, OUT)
