"""The input tables and the golf-shaped views over them, each once for Spark and once as oracle SQL text.

Every view column is written in the part of SQL both engines share, so the two sides read the same rows and
only the operators under test differ.
"""

from __future__ import annotations

import math
import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

#: Rows of lineitem, and of part as polygons, that one task holds about.
TASK_ROWS, TASK_PARTS = 250_000, 20_000

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations")

_SEQ = ("row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber,l_partkey,l_suppkey,l_quantity,"
        "l_extendedprice,l_discount,l_tax,l_shipdate,l_returnflag,l_linestatus)")

# {days}: whole days since 1990-01-01, spelled per engine
_SHOTS = """
SELECT s.*,
  tx + lat_miss_yds + CAST((seq%3-1)*2 AS DOUBLE) AS ex, ty + dist_miss_yds AS ey
FROM (SELECT player_id, round_id, round_date, course_id, seq, round_id*100 + seq AS shot_id,
  day_no, day_no*86400 + 28800 + seq*240 AS ts_s, CAST(floor(day_no/365.25) AS INT) AS yr,
  CAST(floor((seq-1)/3.0) AS INT)+1 AS hole, CAST((seq-1)%3 AS INT)+1 AS shot_no,
  CASE l_partkey%6 WHEN 0 THEN 'Dr' WHEN 1 THEN '4Hy' WHEN 2 THEN '6i' WHEN 3 THEN '8i' WHEN 4 THEN 'PW' ELSE 'SW' END AS club,
  CASE l_linestatus WHEN 'O' THEN 'full' ELSE 'finesse' END AS swing,
  CASE WHEN l_partkey%11=0 THEN 'putt' WHEN l_partkey%11<3 THEN 'shortGame' WHEN l_linestatus='O' THEN 'full' ELSE 'finesse' END AS shot_type,
  CASE l_returnflag WHEN 'R' THEN 'tee' WHEN 'N' THEN 'fairway' ELSE 'rough' END AS lie,
  CAST(80 + 3*CAST(l_quantity AS INT) AS DOUBLE) AS intended_yds,
  CAST((CAST(round(l_discount*100) AS INT)-5)*4.0 + (CAST(l_partkey AS INT)%7-3)*0.5 AS DOUBLE) AS dist_miss_yds,
  CAST((CAST(round(l_tax*100) AS INT)-4)*5.0 + (CAST(l_suppkey AS INT)%5-2)*0.5 AS DOUBLE) AS lat_miss_yds,
  CASE WHEN l_partkey%10=0 THEN NULL ELSE CAST(l_suppkey%5 AS INT)-2 END AS contact,
  CASE WHEN l_partkey%17=0 THEN 'skipped' WHEN l_partkey%3=0 THEN 'quick' ELSE 'full' END AS logged,
  CASE WHEN round_id%23=0 THEN false END AS teach,
  CASE l_suppkey%4 WHEN 0 THEN 'safe' WHEN 1 THEN 'aggressive' WHEN 2 THEN 'own' ELSE 'custom' END AS line_played,
  CAST(2.0 + (l_partkey%25)/10.0 AS DOUBLE) AS exp_score,
  CAST(l_suppkey%60 - 30 AS DOUBLE) AS sx, CAST(l_partkey%50 AS DOUBLE) AS sy,
  CAST(l_suppkey%60 - 30 + l_partkey%41 - 20 AS DOUBLE) AS tx, CAST(l_partkey%50 + 80 + 3*CAST(l_quantity AS INT) AS DOUBLE) AS ty,
  CAST(l_partkey%16 AS DOUBLE) AS start_acc_m, CASE WHEN l_suppkey%9=0 THEN NULL ELSE CAST(l_suppkey%14 AS DOUBLE) END AS end_acc_m,
  CASE l_partkey%5 WHEN 0 THEN 'green' WHEN 1 THEN 'fairway' WHEN 2 THEN 'rough' WHEN 3 THEN 'sand' END AS end_lie,
  CASE WHEN l_partkey%29=0 THEN true END AS end_assumed,
  CASE WHEN l_partkey%4=0 THEN NULL ELSE CAST(l_partkey%9-4 AS DOUBLE) END AS aim_offset_yds,
  CAST(l_suppkey%7-3 AS DOUBLE) AS wind_yds,
  CASE WHEN l_partkey%8=1 THEN CAST(l_partkey%37-18 AS DOUBLE) END AS start_line_deg,
  CASE WHEN l_suppkey%3=0 THEN CAST(l_partkey%15-7 AS DOUBLE) END AS curve_yds,
  CASE l_partkey%4 WHEN 0 THEN 'draw' WHEN 1 THEN 'straight' WHEN 2 THEN 'fade' END AS shape,
  CAST(4*CAST(l_quantity AS INT) + CAST(l_linenumber AS INT) AS DOUBLE) AS to_pin_yds,
  CAST(CAST(l_quantity AS INT) AS DOUBLE) AS putt_ft, l_suppkey%2=0 AS made, l_partkey%13<>0 AS reviewed,
  l_partkey AS part_no, l_suppkey AS supp_no
FROM (SELECT l.*, o_custkey%50 AS player_id, o_orderkey AS round_id, o_orderdate AS round_date, o_custkey%20 AS course_id,
        {days} AS day_no, {seq} AS seq
      FROM lineitem l JOIN orders ON l_orderkey=o_orderkey) t) s
"""

_ROUNDS = """
SELECT o_custkey%50 AS player_id, o_orderkey AS round_id, o_orderdate AS round_date, o_custkey%20 AS course_id,
  {days} AS day_no, CAST(floor({days}/365.25) AS INT) AS yr,
  CAST(68.0 + (o_orderkey%70)/10.0 AS DOUBLE) AS rating, CAST(113 + o_orderkey%41 AS INT) AS slope, 72 AS par,
  CAST((o_custkey%250)/10.0 AS DOUBLE) AS diff_used, (o_orderkey*7919)%100003 AS updated_at,
  CASE WHEN o_orderkey%11=0 THEN 'card' ELSE 'round' END AS kind
FROM orders
"""

_HOLES = """
SELECT player_id, round_id, hole, CASE hole%6 WHEN 0 THEN 5 WHEN 1 THEN 3 ELSE 4 END AS par,
  CASE WHEN hole<=9 THEN 2*hole-1 ELSE 2*(hole-9) END AS si,
  CASE hole%6 WHEN 0 THEN 5 WHEN 1 THEN 3 ELSE 4 END + CAST((round_id*31 + hole*17 + round_id%7*hole)%5 AS INT) - 1 AS score
FROM rounds_v {holes18}
"""

_GPS = """
SELECT user_id AS player_id, event_id, ts, {epoch} AS t_s, CAST(34.2 + (CAST(floor(value) AS INT)%40)*0.00001 AS DOUBLE) AS lat,
  CAST(-84.4 + (event_id%30)*0.00001 AS DOUBLE) AS lng, CAST(event_id%13 AS INT) AS acc_m FROM events
"""

_POINTS = """
SELECT vec_id AS point_id, label, CAST(embedding[{i0}] AS DOUBLE)*400 AS x, CAST(embedding[{i1}] AS DOUBLE)*400 AS y,
  CAST(embedding[{i2}] AS DOUBLE)*10 AS z FROM embeddings
"""

_WORDS = {
    "duckdb": {"days": "date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE))", "seq": _SEQ,
               "epoch": "CAST(floor(epoch(ts)) AS BIGINT)", "i0": "1", "i1": "2", "i2": "3",
               "holes18": "CROSS JOIN (SELECT CAST(unnest(range(1,19)) AS INT) AS hole) h"},
    "spark": {"days": "datediff(o_orderdate, DATE '1990-01-01')", "seq": _SEQ,
              "epoch": "CAST(floor(unix_micros(CAST(ts AS TIMESTAMP))/1000000) AS BIGINT)", "i0": "0", "i1": "1", "i2": "2",
              "holes18": "LATERAL VIEW explode(sequence(1,18)) h AS hole"},
}

_VIEWS = {"shots_v": _SHOTS, "rounds_v": _ROUNDS, "hole_scores_v": _HOLES, "gps_v": _GPS, "points_v": _POINTS}
_NEEDS = {"hole_scores_v": ("rounds_v",)}


def view_sql(name: str, engine: str = "duckdb") -> str:
    return _VIEWS[name].format(**_WORDS[engine]).strip()


def add_view(name: str, text: str, needs: tuple = ()) -> None:
    """Register a further shared view; plan modules use it for their own derived inputs."""
    _VIEWS[name] = text
    _NEEDS[name] = needs


def ordered_needs(names) -> list[str]:
    out: list[str] = []

    def visit(n):
        for m in _NEEDS.get(n, ()):
            visit(m)
        if n not in out:
            out.append(n)

    for n in names:
        visit(n)
    return out


def oracle(body: str, needs=()) -> str:
    """Oracle text with the views it names put in front as common table expressions."""
    body = body.strip()
    ctes = ", ".join(f"{n} AS ({view_sql(n)})" for n in ordered_needs(needs))
    if not ctes:
        return body
    if body.upper().startswith("WITH "):
        head = "WITH RECURSIVE " if body.upper().startswith("WITH RECURSIVE ") else "WITH "
        return f"{head}{ctes}, {body[len(head):]}"
    return f"WITH {ctes} {body}"


class Data:
    """Lazy access to one data folder: ``d.lineitem``, ``d.view('shots_v')``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._open: dict[str, DataFrame] = {}
        self._counted: dict[str, int] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._open:
            self._open[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self._open[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.table(name)
        raise AttributeError(name)

    def _dealt(self, name: str, view: str) -> DataFrame:
        """The table as ``view`` reads it: a large one is dealt into tasks of a bounded number of rows, whatever its files.

        Joins, numbering and windows of a round stay in the task that its lines are dealt to and sort them there several
        times over; left to Spark's coalescing, which goes by compressed bytes, such tasks grow with the table.  Orders are
        then no table to be broadcast by the size of their files.  Parts become polygons, whose work one small file would keep in one task.
        """
        key, size = {("shots_v", "lineitem"): ("l_orderkey", TASK_ROWS), ("shots_v", "orders"): (None, TASK_ROWS),
                     ("feat_v", "part"): ("p_partkey", TASK_PARTS)}.get((view, name), (None, 0))
        df = self.table(name)
        if not size:
            return df
        if name == "orders":
            return df.hint("merge") if self._tasks("lineitem", size) > self._wave else df
        tasks = self._tasks(name, size)
        return df.repartition(tasks, key) if tasks > (self._wave if name == "lineitem" else 1) else df

    def _tasks(self, name: str, size: int) -> int:
        if name not in self._counted:
            self._counted[name] = self.table(name).count()
        return math.ceil(self._counted[name] / size)

    @property
    def _wave(self) -> int:
        return self.spark.sparkContext.defaultParallelism

    def view(self, name: str, **given: DataFrame) -> DataFrame:
        """The view's rows; ``given`` are frames to be read in place of the views that it names."""
        refs = {t: self._dealt(t, name) for t in TABLES if t in _VIEWS[name]}
        refs.update({v: given[v] if v in given else self.view(v) for v in _VIEWS if v != name and v in _VIEWS[name]})
        text = view_sql(name, "spark")
        for ref in refs:
            text = _swap(text, ref)
        return self.spark.sql(text, **refs)

    @cached_property
    def shots(self) -> DataFrame:
        return self.view("shots_v")

    @cached_property
    def rounds(self) -> DataFrame:
        return self.view("rounds_v")

    @cached_property
    def holes(self) -> DataFrame:
        # Spark's size estimate does not count what explode makes of a row, so it would broadcast all holes
        return self.view("hole_scores_v").hint("merge")

    @cached_property
    def gps(self) -> DataFrame:
        return self.view("gps_v")

    @cached_property
    def points(self) -> DataFrame:
        return self.view("points_v")


def _swap(text: str, ref: str) -> str:
    """Names the frame itself in the text, so that no view is shared between sessions or folders."""
    return re.sub(rf"\b(FROM|JOIN)(\s+){ref}\b", rf"\1\2{{{ref}}}", text)
