"""Places along a hole's line: card yardage of a tee box, the tee it most likely is, points to sample on a course."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loftline.functions import rings as G
from loftline.functions.numbers import c, half_up
from loftline.settings import EARTH_M

#: Combination tees are no boxes on the ground (fixed value).
COMBINED = r"(?i)/|combo|hybrid|mixed"
TOL_YDS = 20.0


def along_line(line, x, y) -> Column:
    """Struct of a place's foot on a line ``array<struct<x,y>>``: ``total`` length, ``s`` from the start to the nearest foot (the
    first one of equals), ``off`` distance to it, ``behind`` if that is the start itself.  Null for a line of fewer than two points."""
    px, py, line = c(x), c(y), c(line)

    def step(s, q):
        p = s["p"]
        dx, dy = q["x"] - p["x"], q["y"] - p["y"]
        ln = F.hypot(dx, dy)
        t = F.when(ln > 1e-9, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - p["x"]) * dx + (py - p["y"]) * dy) / F.nullif(ln * ln, F.lit(0.0))))).otherwise(F.lit(0.0))
        off = F.hypot(px - (p["x"] + dx * t), py - (p["y"] + dy * t))
        better = s["off"].isNull() | (off < s["off"])
        return F.struct(q["x"].alias("_"), q.alias("p"), (s["total"] + ln).alias("total"), F.when(better, s["total"] + t * ln).otherwise(s["s"]).alias("s"),
                        F.when(better, off).otherwise(s["off"]).alias("off"), F.when(better, s["off"].isNull() & (t == 0.0)).otherwise(s["behind"]).alias("behind"))

    none = F.lit(None).cast("double")
    start = F.struct(line[0]["x"].alias("_"), line[0].alias("p"), F.lit(0.0).alias("total"), none.alias("s"), none.alias("off"), F.lit(False).alias("behind"))
    end = lambda s: F.struct(s["total"].alias("total"), s["s"].alias("s"), s["off"].alias("off"), s["behind"].alias("behind"))
    return F.when(F.size(line) >= 2, F.aggregate(F.slice(line, F.lit(2), F.size(line) - 1), start, step, end))


def card_yards(line, gx, gy, x, y) -> Column:
    """Yards to the green's centre as a card measures: to the line, along it, on to the centre; a box behind the line's start
    walks up to it first.  Straight where there is no line."""
    f, line = along_line(line, x, y), c(line)
    last = F.get(line, F.size(line) - 1)
    return F.coalesce(f["total"] - f["s"] + F.when(f["behind"], f["off"]).otherwise(F.lit(0.0)) + F.hypot(last["x"] - c(gx), last["y"] - c(gy)), F.hypot(c(x) - c(gx), c(y) - c(gy)))


def card_tees(cards: DataFrame) -> DataFrame:
    """(course_id, hole, name, yards): the tees of a card that may be boxes: named, no combination, one for each name, with a yardage.

    ``cards`` has a row for each tee and hole: course_id, hole, ord (its place on the card), name, yards.
    """
    t = cards.withColumn("name", F.trim("name")).filter((F.col("name") != "") & ~F.col("name").rlike(COMBINED) & (F.col("yards") > 0))
    one = t.groupBy("course_id", "hole", F.lower("name").alias("_n")).agg(F.min(F.struct("ord", "name", "yards")).alias("t"))
    return one.select("course_id", "hole", "t.name", "t.yards")


def name_tee_boxes(boxes: DataFrame, holes: DataFrame, cards: DataFrame, tol: float = TOL_YDS) -> DataFrame:
    """P-13: (course_id, feature_id, hole, yards, name): each box's card yardage and the tee nearest to it, within ``tol``.

    ``boxes``: course_id, feature_id, hole, ring; ``holes``: course_id, hole, line, gx, gy (the green's centre).  Equally
    near tees: the longer one.  Two boxes may be one tee; a box with no tee near has no name; without the hole no yards.
    """
    mid = G.centroid("ring")
    b = boxes.select("course_id", "feature_id", "hole", mid["x"].alias("_x"), mid["y"].alias("_y")).join(holes, ["course_id", "hole"], "left")
    b = b.withColumn("yards", F.when(F.col("gx").isNotNull(), card_yards("line", "gx", "gy", "_x", "_y")))
    t = card_tees(cards).groupBy("course_id", "hole").agg(F.collect_list(F.struct("yards", "name")).alias("_t"))   # a handful a hole
    near = F.filter(F.transform("_t", lambda e: F.struct(F.round(F.abs(e["yards"] - F.col("yards")), 9).alias("d"), (-e["yards"]).alias("short"), e["name"].alias("name"))), lambda e: e["d"] <= tol)
    return b.join(t, ["course_id", "hole"], "left").select("course_id", "feature_id", "hole", "yards", F.array_min(near)["name"].alias("name"))


def sample_points(lines: DataFrame, greens: DataFrame, features: DataFrame, step_m: float = 50.0, digits: int = 5) -> DataFrame:
    """P-17: (course_id, lat, lng, source): the places to take a course's heights at, each once to ``digits`` places.

    Hole lines (course_id, line array<struct<x: lng, y: lat>>) every ``step_m`` and at their end; of greens (course_id, x, y,
    ring) the centre and about every fourth part of the ring; of fairways and tees among ``features`` (course_id, kind, ring)
    the mean of the ring.  ``source`` names the first of line, green, edge, feature that gave the place.
    """
    k = math.pi / 180 * EARTH_M
    seg = lines.withColumn("e", F.explode(F.filter(F.transform("line", lambda p, i: F.struct(p.alias("a"), F.get("line", i + 1).alias("b"))), lambda e: e["b"].isNotNull())))
    ln = F.hypot((F.col("e.b.x") - F.col("e.a.x")) * F.cos(F.radians("e.a.y")), F.col("e.b.y") - F.col("e.a.y")) * k
    n = F.greatest(F.lit(1.0), half_up(ln / step_m)).cast("int")
    at = lambda v: F.col(f"e.a.{v}") + (F.col(f"e.b.{v}") - F.col(f"e.a.{v}")) * F.col("k") / F.col("n")
    on = seg.withColumn("n", n).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).select("course_id", at("x").alias("x"), at("y").alias("y"), F.lit(0).alias("src"))
    end = lines.filter(F.size("line") > 0).select("course_id", F.element_at("line", -1).alias("p")).select("course_id", "p.x", "p.y", F.lit(0).alias("src"))
    mid = greens.select("course_id", "x", "y", F.lit(1).alias("src"))
    every = F.greatest(F.lit(1), F.floor(F.size("ring") / 4).cast("int"))
    rim = greens.withColumn("p", F.explode(F.filter("ring", lambda p, i: i % every == 0))).select("course_id", "p.x", "p.y", F.lit(2).alias("src"))
    mean = lambda v: F.aggregate("ring", F.lit(0.0), lambda s, p: s + p[v]) / F.size("ring")
    own = features.filter(F.col("kind").isin("fairway", "tee") & (F.size("ring") > 0)).select("course_id", mean("x").alias("x"), mean("y").alias("y"), F.lit(3).alias("src"))
    all_ = on.unionByName(end).unionByName(mid).unionByName(rim).unionByName(own)
    names = F.array(*[F.lit(s) for s in ("line", "green", "edge", "feature")])
    return (all_.groupBy("course_id", half_up("y", digits).alias("lat"), half_up("x", digits).alias("lng")).agg(F.min("src").alias("src"))
            .select("course_id", "lat", "lng", F.get(names, F.col("src")).alias("source")))
