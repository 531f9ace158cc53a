"""Positions against course polygons.

Questions of containment and of the nearest feature are answered in ``celled``: positions are streamed past the outlines
of their square, listed there by small cell.  ``cover`` and ``_known`` give such lists as frames: a cell known to lie inside
a feature needs no ring test, one outside is not listed, only positions in cells near an outline are tested.

Other joins are two-stage: an equality join on (course, grid cell) prunes, then the exact ring expression decides.  Features
are listed once per cell they touch; positions stay single rows.

Positions: course_id, x, y.  Features: course_id, feature_id, kind, ring array<struct<x,y>>, inner array<ring>.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loftline.functions import rings as G
from loftline.functions.numbers import c
from loftline.operators import celled as C
from loftline.operators.skew import evaluated_once
from loftline.operators.streamed import starts
from loftline.settings import DEFAULTS, YARDS_PER_METRE, Settings, lookup

CELL = 60.0
#: Cells of a cover, in yards: small ones near outlines, large ones (so many small ones a side) within.
SMALL, SIDE = 10.0, 6
PRIORITY = {"green": 1, "sand": 2, "water": 3, "tee": 4, "fairway": 5, "trees": 6, "ob": 7, "rough": 8}
NAME = {v: k for k, v in PRIORITY.items()}


def _unsent(cells: DataFrame) -> DataFrame:
    """Cells to be joined by sorting: Spark's size estimate counts neither what explode makes of a feature nor the points of its ring, so it would broadcast them."""
    return cells.hint("merge")


def gridded(features: DataFrame, margin: float = 0.0, cell: float = CELL) -> DataFrame:
    """Features with their box, repeated for every cell the box (grown by ``margin``) touches."""
    b = G.bbox("ring")
    f = features.select("*", b["x0"].alias("_x0"), b["y0"].alias("_y0"), b["x1"].alias("_x1"), b["y1"].alias("_y1"))
    return f.withColumn("_c", F.explode(G.cover_cells("_x0", "_y0", "_x1", "_y1", cell, margin))).select(
        "*", F.col("_c.cx").alias("_cx"), F.col("_c.cy").alias("_cy")).drop("_c")


def near(points: DataFrame, features: DataFrame, margin: float = 0.0, cell: float = CELL, keep_box: bool = False) -> DataFrame:
    """Candidate (point, feature) pairs: same course and cell, box within ``margin``."""
    f = gridded(features, margin, cell)
    p = points.withColumn("_cx", G.cell("x", cell)).withColumn("_cy", G.cell("y", cell))
    j = p.join(_unsent(f), ["course_id", "_cx", "_cy"])
    m = float(margin)
    j = j.filter((F.col("x") >= F.col("_x0") - m) & (F.col("x") <= F.col("_x1") + m) & (F.col("y") >= F.col("_y0") - m) & (F.col("y") <= F.col("_y1") + m))
    return j.drop("_cx", "_cy") if keep_box else j.drop("_cx", "_cy", "_x0", "_y0", "_x1", "_y1")


def near_rings(points: DataFrame, features: DataFrame, reach: float, on: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Each point with every feature that agrees in ``on`` and whose ring is within ``reach``, 0 inside, whatever its clearings: the feature's columns ``keep`` and ``_d``."""
    bare = features.withColumn("inner", F.lit(None).cast("array<array<struct<x:double,y:double>>>"))
    return C.within(points, bare, reach, on, keep)


def _in(ring, inner, x, y) -> Column:
    none = F.array().cast("array<array<struct<x:double,y:double>>>")
    return G.contains(ring, x, y) & ~F.exists(F.coalesce(inner, none), lambda r: G.contains(r, x, y))


def inside(x="x", y="y") -> Column:
    """P-02: in the outer ring and in no clearing."""
    return _in(F.col("ring"), F.col("inner"), x, y)


def _all_edges() -> Column:
    """Edges of the ring and of its clearings."""
    none = F.array().cast("array<array<struct<x:double,y:double>>>")
    return F.concat(G.edges("ring"), F.flatten(F.transform(F.coalesce("inner", none), G.edges)))


def _edge_near(edges, x, y, box, reach) -> Column:
    """Whether an edge comes within ``reach``; one whose box is farther than ``box`` is not measured."""
    def close(e):
        p, q = e["a"], e["b"]
        return ((F.least(p["x"], q["x"]) <= x + box) & (F.greatest(p["x"], q["x"]) >= x - box) & (F.least(p["y"], q["y"]) <= y + box) & (F.greatest(p["y"], q["y"]) >= y - box)
                & (G.seg_distance(x, y, p["x"], p["y"], q["x"], q["y"]) <= reach))
    return F.exists(edges, close)


def _marked(cells: DataFrame, size: float, margin: float) -> DataFrame:
    """Cells (_cx, _cy) of features with ``_edge``: an outline may be within ``margin`` of the cell; cells wholly outside go.

    An edge whose box is out of reach is not measured, and only cells without an edge are tested for lying inside.
    """
    x, y = (F.col("_cx") + 0.5) * size, (F.col("_cy") + 0.5) * size
    edge = _edge_near(F.col("_e"), x, y, size / 2 + margin + 1e-6, size * math.sqrt(0.5) + margin + 1e-6)
    return evaluated_once(cells.withColumn("_edge", edge)).filter(F.col("_edge") | inside(x, y))


def cover(features: DataFrame, margin: float = 0.0, small: float = SMALL, side: int = SIDE) -> tuple[DataFrame, DataFrame]:
    """P-01: (large cells inside each feature, small cells inside it or near an outline), with ``_edge`` for the latter.

    A small cell belongs to a large one that is neither inside nor outside.  Cells are found from the features alone,
    once, whatever the number of positions.
    """
    large = small * side
    b = G.bbox("ring")
    f = features.withColumns({"_e": _all_edges(),
                              "_x0": b["x0"] - margin, "_y0": b["y0"] - margin, "_x1": b["x1"] + margin, "_y1": b["y1"] + margin})
    f = evaluated_once(f)
    own = [*features.columns, "_e", "_x0", "_y0", "_x1", "_y1"]
    cells = f.withColumn("_c", F.explode(G.cover_cells("_x0", "_y0", "_x1", "_y1", large))).select(*own, F.col("_c.cx").alias("_cx"), F.col("_c.cy").alias("_cy"))
    big = _marked(cells, large, margin)
    k = F.sequence(F.lit(0), F.lit(side - 1))
    subs = F.flatten(F.transform(k, lambda i: F.transform(k, lambda j: F.struct((F.col("_cx") * side + i).alias("cx"), (F.col("_cy") * side + j).alias("cy")))))
    fine = big.filter("_edge").repartition("course_id", "_cx", "_cy").withColumn("_c", F.explode(subs)).select(*own, F.col("_c.cx").alias("_cx"), F.col("_c.cy").alias("_cy"))
    within = [((F.col(f"_c{k}") + 1) * small >= F.col(f"_{k}0")) & (F.col(f"_c{k}") * small <= F.col(f"_{k}1")) for k in "xy"]
    gone = ["_e", "_x0", "_y0", "_x1", "_y1"]
    return big.filter("NOT _edge").drop("_edge", *gone), _marked(fine.filter(within[0] & within[1]), small, margin).drop(*gone)


def containing(points: DataFrame, features: DataFrame) -> DataFrame:
    """P-01: every feature a point lies in, with its columns but for the rings; positions are streamed past the outlines of their square."""
    return C.holding(points, features, [k for k in features.columns if k not in ("course_id", "ring", "inner")])


_UNKNOWN = C.UNKNOWN   # a green of no known hole is everyone's own


def _rank() -> Column:
    """Priority, another hole's green read as fairway; null for the boundary."""
    return lookup(F.when(F.col("kind") == "green", "fairway").otherwise(F.col("kind")), PRIORITY)


def _known(features: DataFrame, margin: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """One row a cell: what every position in it lies in (``base`` priority, ``greens`` by hole, ``bound``), and in small cells the features to test.

    A feature that cannot better what a whole small cell or the large one round it lies in is not tested there, so that
    the lists stay short however many features overlap.  Rings join the lists after that.
    """
    box = G.bbox("ring")
    features = features.withColumns({"_p": _rank(), "_b": F.col("kind") == "boundary", "_g": F.when(F.col("kind") == "green", F.coalesce("f_hole", F.lit(_UNKNOWN)))})
    features = features.withColumn("_k", F.xxhash64("_p", "_b", "_g", "ring", "inner"))
    big, fine = cover(features, margin)
    on = ["course_id", "_cx", "_cy"]
    agg = lambda sure: [F.min(F.when(sure, F.col("_p"))).alias("base"), F.collect_set(F.when(sure, F.col("_g"))).alias("greens"), F.max(sure & F.col("_b")).alias("bound")]
    big = big.groupBy(*on).agg(*agg(F.lit(True)))
    fine = fine.groupBy(*on).agg(*agg(~F.col("_edge")), F.collect_set(F.when(F.col("_edge"), F.struct("_p", "_b", "_g", "_k"))).alias("_try"))
    wide = big.select("course_id", F.col("_cx").alias("_lx"), F.col("_cy").alias("_ly"), F.struct("base", "greens", "bound").alias("_l"))
    fine = fine.withColumns({"_lx": F.floor(F.col("_cx") / SIDE), "_ly": F.floor(F.col("_cy") / SIDE)}).join(_unsent(wide), ["course_id", "_lx", "_ly"], "left")
    base = F.coalesce(F.least("base", "_l.base"), F.lit(99))
    bound = F.coalesce("bound", F.lit(False)) | F.coalesce("_l.bound", F.lit(False))
    green = lambda g: F.array_contains("greens", g) | F.coalesce(F.array_contains("_l.greens", g), F.lit(False))
    worth = F.filter("_try", lambda e: F.when(e["_b"], ~bound & (base > PRIORITY["trees"])).otherwise(
        (e["_p"] < base) | F.coalesce(~green(e["_g"]) & ~green(F.lit(_UNKNOWN)), F.lit(False))))
    fine = fine.select(*on, "base", "greens", "bound", F.explode_outer(worth).alias("_w")).withColumn("_k", F.col("_w._k"))
    ring = F.struct("_p", "_b", "_g", "ring", "inner", F.struct(*[v.alias(k) for k, v in box.items()]).alias("_box"))
    rings = features.select("course_id", "_k", ring.alias("_f")).dropDuplicates(["course_id", "_k"])
    known = fine.join(_unsent(rings), ["course_id", "_k"], "left").groupBy(*on).agg(
        F.first("base").alias("base"), F.first("greens").alias("greens"), F.first("bound").alias("bound"), F.collect_list("_f").alias("test"))
    return big, known


def _bounded(points: DataFrame, bounded: DataFrame | None) -> DataFrame:
    """Points with ``_bd``: their course has a boundary."""
    if bounded is None:
        return points.withColumn("_bd", F.lit(False))
    return points.join(bounded.select("course_id", F.lit(True).alias("_bd")).distinct(), "course_id", "left").withColumn("_bd", F.coalesce("_bd", F.lit(False)))


_CODES = C.Codes(PRIORITY["green"], PRIORITY["trees"], PRIORITY["rough"], PRIORITY["ob"])


def surface(points: DataFrame, features: DataFrame, key: str, bounded: DataFrame | None = None) -> DataFrame:
    """P-03: the highest-priority surface at each point; other holes' greens read as fairway; outside a course's
    boundary is ob (never where mapped rough says otherwise); nothing is rough.

    ``bounded`` lists the courses that have a boundary.  Points are streamed past the outlines of their square.
    """
    out = C.surfaces(_bounded(points, bounded), features, _rank(), _CODES)
    return out.select(*points.columns, lookup(F.col("_code"), NAME).alias("surface"))


def lie_confidence(points: DataFrame, features: DataFrame, key: str, acc: Column, bounded: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """P-04: the surface at a fix and at 32 probes on circles of r and r/2; any change, poor accuracy or a penalty
    surface makes it low.

    A fix that is too coarse is low whatever lies around it and reads its centre alone, as does one on a penalty surface;
    the circle of any other is at most that of the coarsest fix that counts, by which a square's outlines are widened.
    Probes are read one after the other, each for the fixes that none has told yet.
    """
    fine = F.coalesce(acc <= cfg.coarse_m, F.lit(True))
    pts = points.select(key, "course_id", "hole", "x", "y", acc.alias("_acc"), fine.alias("_ask"), (F.greatest(F.when(fine, acc), F.lit(5.0)) * YARDS_PER_METRE).alias("_r"))
    penalty = [PRIORITY["water"], PRIORITY["ob"]]
    out = C.probed(_bounded(pts, bounded), features, _rank(), _CODES, max(5.0, cfg.coarse_m) * YARDS_PER_METRE, penalty)
    low = F.col("_code").isin(penalty) | (F.col("_acc") > cfg.coarse_m) | F.col("_differs")
    return out.select(key, lookup(F.col("_code"), NAME).alias("lie"), F.when(low, "low").otherwise("high").alias("confidence"))


def _with_nearest(points: DataFrame, features: DataFrame, reach: float, by: Sequence[str], first: str, on: Sequence[str] = (), alone: bool = False) -> DataFrame:
    """Points with the nearest feature of each ``by`` within ``reach`` (``by``, ``first``, distance ``_d``), of equally near ones the least ``first``.

    Points are streamed past their cell's features, of which a cell keeps those that can be nearest to a position in it.
    ``on``: further columns that points and features share.  ``alone``: points without any stay, with nulls.
    """
    return C.nearest(points, features, reach, by, first, on, alone)


def nearest(points: DataFrame, features: DataFrame, key: str, reach: float) -> DataFrame:
    """P-05: distance (0 inside) to the nearest feature of each kind within reach."""
    j = _with_nearest(points, features.select("course_id", "feature_id", "kind", "ring", "inner"), reach, ["kind"], "feature_id")
    return j.groupBy(key, "kind").agg(F.min(F.struct(F.col("_d").alias("d"), "feature_id")).alias("m")).select(
        key, "kind", F.col("m.d").alias("dist"), F.col("m.feature_id").alias("feature_id"))


# ---- lines --------------------------------------------------------------------------------------------

def sample_line(lines: DataFrame, step: float, x0="x0", y0="y0", x1="x1", y1="y1") -> DataFrame:
    """P-06: points every ``step`` along each segment, its end included."""
    ln = F.hypot(c(x1) - c(x0), c(y1) - c(y0))
    n = F.greatest(F.lit(1), F.ceil(ln / step)).cast("int")
    out = lines.withColumn("_n", n).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("_n"))))
    return out.withColumn("x", c(x0) + (c(x1) - c(x0)) * F.col("k") / F.col("_n")).withColumn("y", c(y0) + (c(y1) - c(y0)) * F.col("k") / F.col("_n")).drop("_n")


#: Tasks that the features of one course are dealt to; pairs of a sample and a feature that are measured at once.
SPREAD, PAIRS = 32, 1 << 16


def _measured(px: np.ndarray, py: np.ndarray, x: np.ndarray, y: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Distance from each place to the ring in column ``own`` of x and y, 0 inside; an edge at a time."""
    odd, best, dx, dy = np.zeros(len(px), bool), np.full(len(px), np.inf), np.full(len(px), np.nan), np.full(len(px), np.nan)
    ax, ay = x[-1][own], y[-1][own]
    for k in range(len(x)):
        bx, by = x[k][own], y[k][own]
        vx, vy, wx, wy = bx - ax, by - ay, px - ax, py - ay
        odd ^= ((ay > py) != (by > py)) & (px < vx * wy / np.where(vy == 0, np.nan, vy) + ax)
        l2 = vx * vx + vy * vy
        t = np.where(l2 == 0, 0.0, np.clip((wx * vx + wy * vy) / np.where(l2 == 0, np.nan, l2), 0.0, 1.0))
        ex, ey = px - (ax + t * vx), py - (ay + t * vy)
        d = ex * ex + ey * ey
        near = d < best
        best, dx, dy = np.where(near, d, best), np.where(near, ex, dx), np.where(near, ey, dy)
        ax, ay = bx, by
    return np.where(odd & (len(x) >= 3), 0.0, np.hypot(dx, dy))


def _nearest_samples(sx: np.ndarray, sy: np.ndarray, line: np.ndarray, ring: pa.Array, reach: float) -> tuple[np.ndarray, ...]:
    """(ring, line, distance) of those within reach: samples of a line stand together, rings of a length are measured together."""
    size = pc.fill_null(pc.list_value_length(ring), 0).to_numpy(zero_copy_only=False)
    end = np.cumsum(size)
    fx, fy = (pc.struct_field(ring.flatten(), k).to_numpy(zero_copy_only=False).astype(float) for k in ("x", "y"))
    out = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    for n in np.unique(size[size > 0]):
        every = np.flatnonzero(size == n)
        step = max(1, PAIRS // max(len(sx), int(n)))
        for at in range(0, len(every), step):
            own = every[at:at + step]
            x, y = (k[(end[own] - n) + np.arange(n)[:, None]] for k in (fx, fy))
            near = np.ones((len(own), len(sx)), bool)
            for p, v in ((sx, x), (sy, y)):
                near &= (p >= np.fmin.reduce(v)[:, None] - reach) & (p <= np.fmax.reduce(v)[:, None] + reach)
            f, s = np.nonzero(near)
            if not len(f):
                continue
            with np.errstate(invalid="ignore", over="ignore"):
                d = _measured(sx[s], sy[s], x, y, f)
            first = np.flatnonzero(np.r_[True, (f[1:] != f[:-1]) | (line[s[1:]] != line[s[:-1]])])
            d = np.fmin.reduceat(d, first)
            ok = d <= reach
            for o, v in zip(out, (own[f[first]], line[s[first]], d)):
                o.append(v[ok])
    return tuple(np.concatenate(o) for o in out)


def _line_reads(reach: float):
    """Measures features that come sorted, after the samples of their course's lines: one course's samples and a batch are held."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        course, parts, held = None, [], None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            cut = np.flatnonzero(starts(t, ["course_id", "_s", "_feature"])).tolist() + [len(t)]
            for a, b in zip(cut, cut[1:]):
                own = t.slice(a, b - a)
                now = own["course_id"][0].as_py(), own["_s"][0].as_py()
                if now != course:
                    course, parts, held = now, [], None
                if not own["_feature"][0].as_py():
                    parts.append(own)
                    continue
                if held is None:
                    if not parts:
                        continue
                    held = pa.concat_tables(parts).combine_chunks()
                    code = pc.dictionary_encode(held["hole"].combine_chunks(), null_encoding="encode")
                    number = code.indices.to_numpy(zero_copy_only=False)
                    order = np.argsort(number, kind="stable")
                    sx, sy = (held[k].to_numpy()[order] for k in ("x", "y"))
                    number, holes = number[order], code.dictionary
                f, h, d = _nearest_samples(sx, sy, number, own["ring"].combine_chunks(), reach)
                own = own.take(f)
                yield from pa.table([own["course_id"], own["feature_id"], own["kind"], holes.take(pa.array(h)), pa.array(d)], ["course_id", "feature_id", "kind", "hole", "d"]).to_batches()
    return read


def line_distance(lines: DataFrame, features: DataFrame, reach: float, step: float = 10.0) -> DataFrame:
    """Distance from each feature to each hole's sampled line, for pairs within reach.

    Features are dealt by course, a course's features over SPREAD tasks with a copy of its samples each, and streamed past
    the samples there: a feature is one row that is written once, its pairs with samples never are.
    """
    s = sample_line(lines, step).filter("x IS NOT NULL AND y IS NOT NULL AND course_id IS NOT NULL").select(
        "course_id", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("_s"), F.lit(False).alias("_feature"), "hole", "x", "y")
    f = features.filter("course_id IS NOT NULL AND ring IS NOT NULL").select(
        "course_id", F.pmod(F.xxhash64("feature_id"), F.lit(SPREAD)).cast("int").alias("_s"), F.lit(True).alias("_feature"), "feature_id", "kind", "ring")
    both = s.unionByName(f, allowMissingColumns=True).repartition("course_id", "_s").sortWithinPartitions("course_id", "_s", "_feature")
    kind = lambda k: both.schema[k].dataType.simpleString()
    j = both.mapInArrow(_line_reads(reach), f"course_id {kind('course_id')}, feature_id {kind('feature_id')}, kind {kind('kind')}, hole {kind('hole')}, d double")
    return j.groupBy("course_id", "feature_id", "kind", "hole").agg(F.min("d").alias("d"))


def assign_features(lines: DataFrame, features: DataFrame, reach: float) -> DataFrame:
    """P-07: which holes a feature belongs to.

    Tees go to the holes starting in them, else the nearest line; trees and hazards to every hole in reach;
    fairways and rough to the holes crossing them, else the nearest.
    """
    d = line_distance(lines, features, reach)
    starts = lines.select("course_id", "hole", F.col("x0").alias("x"), F.col("y0").alias("y"))
    tee_in = containing(starts, features.filter("kind = 'tee'")).select("course_id", "feature_id", "hole").withColumn("_tee", F.lit(True))
    d = d.join(tee_in, ["course_id", "feature_id", "hole"], "left")
    w = Window.partitionBy("course_id", "feature_id")
    hit = F.when(F.col("kind") == "tee", F.coalesce("_tee", F.lit(False))).otherwise(F.col("d") == 0)
    d = d.withColumn("_hit", hit)
    any_hit = F.max("_hit").over(w)
    first = F.min(F.struct("d", "hole")).over(w)
    many = F.col("kind").isin("trees", "sand", "water")
    keep = F.when(many, True).when(any_hit, F.col("_hit")).otherwise(F.col("hole") == first["hole"])
    return d.withColumn("_k", keep).filter("_k").select("course_id", "feature_id", "kind", "hole", "d")


def assign_greens(lines: DataFrame, greens: DataFrame, reach: float) -> DataFrame:
    """P-08: the green holding the line's end, else the nearest centroid in reach; holes without one keep a null.

    A centroid in reach has its box in reach, so the reach is the margin of the search.
    """
    ends = lines.select("course_id", "hole", F.col("x1").alias("x"), F.col("y1").alias("y"))
    g = evaluated_once(greens.withColumn("_ctr", G.centroid("ring")))
    j = near(ends, g, reach).withColumn("_in", G.contains("ring", "x", "y")).withColumn("_d", F.hypot(F.col("x") - F.col("_ctr.x"), F.col("y") - F.col("_ctr.y")))
    j = j.filter(F.col("_in") | (F.col("_d") <= reach))
    best = j.groupBy("course_id", "hole").agg(F.min_by("feature_id", F.struct(F.when(F.col("_in"), 0).otherwise(1), F.when(F.col("_in"), F.lit(0.0)).otherwise(F.col("_d")), F.col("feature_id"))).alias("green_id"))
    return lines.select("course_id", "hole").join(best, ["course_id", "hole"], "left")


def tee_places(lines: DataFrame, tees: DataFrame, share: float = 0.6, clear: float = 100 * YARDS_PER_METRE) -> DataFrame:
    """P-18: what stands for each hole's tee: its tee polygons, or where none is mapped the first ``share`` of its line,
    ended ``clear`` yards before the green; a line is a ring of two points, which holds nothing but has a distance."""
    ln = F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    part = F.when(ln > 0, F.greatest(F.lit(0.0), F.least(F.lit(share), (ln - clear) / F.nullif(ln, F.lit(0.0))))).otherwise(0.0)
    end = lambda a, b: F.col(a) + (F.col(b) - F.col(a)) * part
    bare = lines.withColumn("f_hole", F.col("hole")).join(tees.select("course_id", "f_hole").distinct(), ["course_id", "f_hole"], "left_anti")
    stretch = bare.select("course_id", F.lit(None).cast("long").alias("feature_id"), F.lit("tee").alias("kind"), "f_hole",
                          F.array(G.pt("x0", "y0"), G.pt(end("x0", "x1"), end("y0", "y1"))).alias("ring"), F.lit(None).cast("array<array<struct<x:double,y:double>>>").alias("inner"))
    return tees.select("course_id", "feature_id", "kind", "f_hole", "ring", "inner").unionByName(stretch)


def hole_by_tee(points: DataFrame, lines: DataFrame, tees: DataFrame, key: str, reach: float) -> DataFrame:
    """P-18: from an unknown hole, the hole whose tee is nearest, within reach of the fix."""
    places = tee_places(lines, tees).select("course_id", "f_hole", "ring", F.lit(None).cast("array<array<struct<x:double,y:double>>>").alias("inner"))
    j = _with_nearest(points, places, reach, [], "f_hole")
    return j.groupBy(key).agg(F.min(F.struct(F.col("_d").alias("dd"), "f_hole")).alias("m")).select(key, F.col("m.f_hole").alias("hole"), F.col("m.dd").alias("dist"))


def best_boundary(lines: DataFrame, outlines: DataFrame) -> DataFrame:
    """P-09: per course the outline holding the most line ends."""
    ends = lines.select("course_id", F.explode(F.array(F.struct(F.col("x0").alias("x"), F.col("y0").alias("y")), F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")))).alias("e")).select("course_id", "e.*")
    n = containing(ends, outlines).groupBy("course_id", "feature_id").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("course_id").agg(F.max(F.struct("n", (-F.col("feature_id")).alias("_f"))).alias("m")).select("course_id", (-F.col("m._f")).alias("feature_id"), F.col("m.n").alias("ends"))


# ---- green and fairway geometry -----------------------------------------------------------------------

def green_distances(df: DataFrame) -> DataFrame:
    """P-11: front, centre and back of the green along the line to its centre ``ctr``."""
    df = evaluated_once(df.withColumn("_gx", F.col("ctr.x") - F.col("x")).withColumn("_gy", F.col("ctr.y") - F.col("y")))
    df = evaluated_once(df.withColumn("center", F.hypot("_gx", "_gy")))
    away = F.when(F.col("center") > 1e-9, F.col("center"))
    df = evaluated_once(df.withColumn("_dx", F.col("_gx") / away).withColumn("_dy", F.col("_gy") / away))
    df = evaluated_once(df.withColumn("_h", G.ray_span("x", "y", "_dx", "_dy", "ring")))
    front = F.coalesce("_h.lo", F.greatest(F.lit(0.0), F.col("center") - 12))
    back = F.coalesce("_h.hi", F.col("center") + 12)
    return df.withColumn("front", front).withColumn("back", back).drop("_h", "_gx", "_gy", "_dx", "_dy")


def corridor(df: DataFrame) -> DataFrame:
    """P-12: left and right edge of a fairway on the cross-line through the point (y = const)."""
    def x_at(e):
        a, b = e["a"], e["b"]
        return F.when((a["y"] > F.col("y")) != (b["y"] > F.col("y")), a["x"] + (F.col("y") - a["y"]) * (b["x"] - a["x"]) / F.nullif(b["y"] - a["y"], F.lit(0.0)))
    xs = F.filter(F.transform(G.edges("ring"), x_at), lambda v: v.isNotNull())
    return df.withColumn("left_x", F.array_min(xs)).withColumn("right_x", F.array_max(xs))


def fairway_center(df: DataFrame, cap: float = 40.0) -> DataFrame:
    """``center_x``: middle of the crossing span nearest the point (spans pair the sorted crossings in order), moved by at most the cap."""
    def x_at(e):
        a, b = e["a"], e["b"]
        return F.when((a["y"] > F.col("y")) != (b["y"] > F.col("y")), a["x"] + (F.col("y") - a["y"]) * (b["x"] - a["x"]) / F.nullif(b["y"] - a["y"], F.lit(0.0)) - F.col("x"))
    df = evaluated_once(df.withColumn("_xs", F.array_sort(F.filter(F.transform(G.edges("ring"), x_at), lambda v: v.isNotNull()))))
    # every second crossing opens a span that the next one closes
    opens = F.filter("_xs", lambda v, i: i % 2 == 0)
    closes = F.filter("_xs", lambda v, i: i % 2 == 1)
    spans = F.zip_with(opens, closes, lambda a, b: F.struct(
        F.when((a <= 0) & (b >= 0), F.lit(0.0)).otherwise(F.least(F.abs(a), F.abs(b))).alias("g"), ((a + b) / 2).alias("m")))
    df = evaluated_once(df.withColumn("_best", F.array_min(F.filter(spans, lambda v: v["g"] <= cap))))
    move = F.greatest(F.lit(-cap), F.least(F.lit(cap), F.col("_best.m")))
    return df.withColumn("center_x", F.col("x") + F.when(F.col("_best").isNotNull(), move).otherwise(0.0)).drop("_xs", "_best")


def green_position(df: DataFrame, x: str, y: str, fx: str, fy: str) -> DataFrame:
    """P-25: front/middle/back (v) and left/right (h) by sixths of the green's depth and width, seen from (fx, fy).

    ``ring`` and its centroid ``ctr`` are columns of ``df``.
    """
    ln = F.hypot(F.col("ctr.x") - c(fx), F.col("ctr.y") - c(fy))
    df = df.withColumn("_l", F.when(ln < 1e-9, 1.0).otherwise(ln)).withColumn("_gx", F.col("ctr.x")).withColumn("_gy", F.col("ctr.y"))
    df = evaluated_once(df.withColumn("_dx", (F.col("_gx") - c(fx)) / F.col("_l")).withColumn("_dy", (F.col("_gy") - c(fy)) / F.col("_l")))
    al = lambda px, py: (px - F.col("_gx")) * F.col("_dx") + (py - F.col("_gy")) * F.col("_dy")
    la = lambda px, py: (px - F.col("_gx")) * F.col("_dy") - (py - F.col("_gy")) * F.col("_dx")
    df = evaluated_once(df.withColumn("_as", F.transform("ring", lambda p: al(p["x"], p["y"]))).withColumn("_ls", F.transform("ring", lambda p: la(p["x"], p["y"])))
                        .withColumn("_a", al(c(x), c(y))).withColumn("_b", la(c(x), c(y))))
    ta = F.greatest(F.lit(1.5), (F.array_max("_as") - F.array_min("_as")) / 6)
    tl = F.greatest(F.lit(1.5), (F.array_max("_ls") - F.array_min("_ls")) / 6)
    return (df.withColumn("v", F.when(F.col("_a") < -ta, "front").when(F.col("_a") > ta, "back").otherwise("middle"))
            .withColumn("h", F.when(F.col("_b") < -tl, "left").when(F.col("_b") > tl, "right").otherwise("")))


def clamp_inside(df: DataFrame) -> DataFrame:
    """P-27: (x, y) itself if inside the ring, else stepped in from the nearest edge point toward the centre by quarter yards.

    Steps are looked at one after the other, only for the positions that are not inside yet; keys outside that repeat are one row.
    """
    keys = [k for k in df.columns if k not in ("ring", "ctr", "x", "y")]
    at = C.clamped(df, keys, 0.25)
    first = at.filter("NOT _in").groupBy(*keys).agg(F.min(F.when(F.col("_k").isNotNull(), F.struct("_k", "x", "y"))).alias("m"), F.first(F.struct("x", "y")).alias("c"))
    moved = first.select(*keys, F.coalesce("m.x", "c.x").alias("x"), F.coalesce("m.y", "c.y").alias("y"))
    return at.filter("_in").select(*keys, "x", "y").unionByName(moved)


def safest_spot(greens: DataFrame, hazards: DataFrame, boundaries: DataFrame | None = None, step: float = 2.0, near_yds: float = 20.0) -> DataFrame:
    """P-14: the point of a 2-yard grid inside the green farthest from its hole's nearest hazard; ties nearer the centre.

    A course's boundary counts as a hazard of each of its greens, by its outline.  A green without either, or one that
    holds no grid point, gives its centre and no distance.  Hazards join on (course, hole);
    distances are combined map-side per grid point.
    """
    b = G.bbox("ring")
    n = lambda lo, hi: F.sequence(F.lit(0), F.floor((hi - lo) / step).cast("int"))
    name = ["course_id", "hole", "green_id"]
    g = evaluated_once(greens.select("course_id", F.col("f_hole").alias("hole"), F.col("feature_id").alias("green_id"), "ring", G.centroid("ring").alias("_c"), b["x0"].alias("_x0"), b["y0"].alias("_y0"), n(b["x0"], b["x1"]).alias("_i"), n(b["y0"], b["y1"]).alias("_j")))
    p = g.select("*", F.explode("_i").alias("i")).select("*", F.explode("_j").alias("j")).withColumn("x", F.col("_x0") + F.col("i") * step).withColumn("y", F.col("_y0") + F.col("j") * step)
    p = p.filter(G.contains("ring", "x", "y")).select(*name, "x", "y", F.hypot(F.col("x") - F.col("_c.x"), F.col("y") - F.col("_c.y")).alias("dc"))
    h = hazards.select("course_id", F.col("f_hole").alias("hole"), F.col("ring").alias("hring"))
    # a point near a hazard meets the few that its cell keeps, one that is far from all of its hole meets them all
    at = h.select("course_id", "hole", F.col("hring").alias("ring"), F.lit(None).cast("array<array<struct<x:double,y:double>>>").alias("inner"))
    met = _with_nearest(p, at, near_yds, ["hole"], "hole", ["hole"], alone=True)
    close = met.filter("_d IS NOT NULL").select(*p.columns, F.col("_d").alias("d"))
    d = close.unionByName(met.filter("_d IS NULL").select(p.columns).join(_unsent(h), ["course_id", "hole"]).select(*p.columns, G.distance("hring", "x", "y").alias("d")))
    if boundaries is not None:
        out = boundaries.select("course_id", F.col("ring").alias("hring"))
        d = d.unionByName(p.join(out, "course_id").select(*p.columns, G.edge_distance("hring", "x", "y").alias("d")))
    d = d.groupBy(*name, "x", "y", "dc").agg(F.min("d").alias("d"))
    key = F.struct(F.round("d", 6), -F.round("dc", 6), -F.col("y"), -F.col("x"))
    best = d.groupBy(*name).agg(F.max_by(F.struct("x", "y", "d"), key).alias("m"))
    return g.select(*name, "_c").join(best, name, "left").select(*name, F.coalesce("m.x", "_c.x").alias("x"), F.coalesce("m.y", "_c.y").alias("y"), F.col("m.d").alias("d"))


def _watered(points: DataFrame, features: DataFrame) -> DataFrame:
    """Points with ``_code``, which is water's for those in water that are neither in sand nor on the hole's own green, and less in sand or on that green."""
    return C.surfaces(points.withColumn("_bd", F.lit(False)), features.filter("kind IN ('water', 'sand', 'green')"), _rank(), _CODES, anyone=False)


def _wet(points: DataFrame, features: DataFrame, key: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Keys of the points whose surface is water, with the columns ``keep`` of one of them."""
    hit = _watered(points.select(*dict.fromkeys([*key, "course_id", "hole", "x", "y", *keep])), features).filter(F.col("_code") <= PRIORITY["water"])
    wet = hit.groupBy(*key).agg(F.bool_and(F.col("_code") == PRIORITY["water"]).alias("w"), *([F.first(F.struct(*keep)).alias("r")] if keep else [])).filter("w")
    return wet.select(*key, *([F.col(f"r.{k}").alias(k) for k in keep]))


def water_entry(shots: DataFrame, features: DataFrame, key: str, step: float = 2.0) -> DataFrame:
    """P-26: walking back from a landing in water toward the ball every 2 yards, the first point that is not water; else the ball.

    The whole line is walked, and never past the ball: a line shorter than a step has no point on it.  Steps are
    opened only for shots that landed in water.  ``k0`` is the number of the step, null for the ball.
    """
    at = shots.filter(F.col(key).isNotNull()).select(key, "course_id", "hole", F.col("ex").alias("x"), F.col("ey").alias("y"), "sx", "sy")
    wet = _wet(at, features, [key], ["course_id", "hole", "x", "y", "sx", "sy"]).select(
        key, "course_id", "hole", F.col("x").alias("lx"), F.col("y").alias("ly"), "sx", "sy", F.hypot(F.col("x") - F.col("sx"), F.col("y") - F.col("sy")).alias("_l"))
    n = F.floor(F.col("_l") / step).cast("int")
    along = lambda k, a, b: F.col(a) + (F.col(b) - F.col(a)) / F.nullif("_l", F.lit(0.0)) * k * step
    # a shot without steps stays as a row without a step
    walk = wet.withColumn("k", F.explode_outer(F.when(n > 0, F.sequence(F.lit(1), n))))
    walk = walk.withColumn("x", along(F.col("k"), "lx", "sx")).withColumn("y", along(F.col("k"), "ly", "sy"))
    dry = F.min(F.when(F.col("_code") != PRIORITY["water"], F.col("k"))).alias("k0")
    own = _watered(walk, features).groupBy(key).agg(dry, F.first(F.struct("lx", "ly", "sx", "sy", "_l")).alias("r")).select(key, "k0", "r.*")
    return own.select(key, F.coalesce(along(F.col("k0"), "lx", "sx"), F.col("sx").cast("double")).alias("x"),
                      F.coalesce(along(F.col("k0"), "ly", "sy"), F.col("sy").cast("double")).alias("y"), "k0")


def tone(surface_col) -> Column:
    return lookup(c(surface_col), {"fairway": "fairway", "green": "fairway", "tee": "fairway", "rough": "rough"}, "trouble")


def rim(df: DataFrame, n: int = 48) -> DataFrame:
    """P-21: n points on the rim of each ellipse (cx, cy, w, h, tilt)."""
    a = F.radians("tilt")
    t = F.lit(2 * math.pi) * F.col("k") / n
    u, v = F.cos(t) * F.col("w") / 2, F.sin(t) * F.col("h") / 2
    return (df.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
            .withColumn("x", F.col("cx") + u * F.cos(a) - v * F.sin(a)).withColumn("y", F.col("cy") + u * F.sin(a) + v * F.cos(a)))


# ---- votes and nearest samples ------------------------------------------------------------------------

#: Entries of a matrix of distances that is held at once.
BLOCK = 1 << 21


def _within(dx: np.ndarray, dy: np.ndarray, r: float) -> np.ndarray:
    """hypot(dx, dy) <= r; only lengths next to r are measured by hypot."""
    d = dx * dx + dy * dy
    out = d <= r * r * (1 - 1e-12)
    edge = (d <= r * r * (1 + 1e-12)) & ~out
    out[edge] = np.hypot(np.broadcast_to(dx, d.shape)[edge], np.broadcast_to(dy, d.shape)[edge]) <= r
    return out


def _voted(table: pa.Table, r: float, least: int, strict: bool) -> pa.Table:
    """(qx, qy, corrected, votes, latest) of the places of one cell, rows without ``n``, among the corrections round it."""
    asked = table.filter(pc.is_null(table["n"]))
    v = table.filter(pc.is_valid(table["n"]))
    v = v.take(pc.sort_indices(v["t"], null_placement="at_start"))
    qx, qy = (asked[k].to_numpy() for k in ("x", "y"))
    vx, vy, vn = (v[k].to_numpy() for k in ("x", "y", "n"))
    lies = pc.dictionary_encode(v["corrected"].combine_chunks(), null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    place, member, votes = [], [], []
    for lie in np.unique(lies):
        own = np.flatnonzero(lies == lie)
        x, y, n = vx[own], vy[own], vn[own].astype(float)
        step = max(1, BLOCK // len(own))
        for at in range(0, len(qx), step):
            near = _within(qx[at:at + step, None] - x, qy[at:at + step, None] - y, r)
            seen, mate = near.astype(np.float32), np.zeros(near.shape, bool)
            for k in range(0, len(own), step):   # which corrections have another of those in reach within r
                close = _within(x[:, None] - x[k:k + step], y[:, None] - y[k:k + step], r)
                close[np.arange(k, min(k + step, len(own))), np.arange(close.shape[1])] = False
                mate[:, k:k + step] = seen @ close.astype(np.float32) > 0
            mate &= near
            if strict:
                near &= mate | (n >= least)
            total = near @ n
            ok = total >= least
            if not strict:
                ok &= mate.any(1) | (near & (n >= 2)).any(1)
            hit = np.flatnonzero(ok)
            place.append(hit + at)
            member.append(own[near.shape[1] - 1 - near[hit][:, ::-1].argmax(1)])   # the last in order of time
            votes.append(total[hit].astype(np.int64))
    none = np.empty(0, np.int64)
    place, member, votes = (np.concatenate([none, *k]) for k in (place, member, votes))
    asked, v = asked.take(place), v.take(member)
    return pa.table([asked["course_id"], asked["x"], asked["y"], v["corrected"], pa.array(votes), v["t"]], ["course_id", "qx", "qy", "corrected", "votes", "latest"])


def override_vote(fixes: DataFrame, corrections: DataFrame, cfg: Settings = DEFAULTS, strict: bool = False) -> DataFrame:
    """P-15: per place, the corrected lie with the most corrections within 15 m, then the newest.

    Identical positions are counted together first (a fix has a finite grid), so a hot spot is one row per place
    and lie before anything is dealt.  Places are dealt by cells one radius wide, corrections to their own cell and the
    eight round it; pairs of both are counted there in blocks and never written.  By default all corrections in
    reach count once some two of them are within the radius of each other; ``strict`` counts only corrections
    that have such a partner.  Columns: course_id, xm, ym (metres), corrected, t_s.
    """
    r, least, known = cfg.vote_radius_m, cfg.vote_min, "course_id IS NOT NULL AND xm IS NOT NULL AND ym IS NOT NULL"
    x, y = F.col("xm").cast("double").alias("x"), F.col("ym").cast("double").alias("y")
    v = corrections.filter(known).groupBy("course_id", "xm", "ym", "corrected").agg(F.count(F.lit(1)).alias("n"), F.max("t_s").alias("t"))
    v = v.select("course_id", F.explode(G.cover_cells("xm", "ym", "xm", "ym", r, r)).alias("c"), x, y, "corrected", "n", "t").select("course_id", "c.cx", "c.cy", "x", "y", "corrected", "n", "t")
    q = fixes.filter(known).select("course_id", "xm", "ym").distinct().select("course_id", G.cell("xm", r).alias("cx"), G.cell("ym", r).alias("cy"), x, y)
    kind = lambda k: v.schema[k].dataType.simpleString()
    g = q.unionByName(v, allowMissingColumns=True).groupBy("course_id", "cx", "cy").applyInArrow(
        lambda t: _voted(t, r, least, strict), f"course_id {kind('course_id')}, qx double, qy double, corrected {kind('corrected')}, votes long, latest {kind('t')}")
    return g.groupBy("course_id", "qx", "qy").agg(F.max(F.struct("votes", "latest", "corrected")).alias("b")).select("course_id", "qx", "qy", F.col("b.corrected").alias("lie"), F.col("b.votes").alias("votes"))


#: Halvings of the side of a cell that holds one row, were all spread evenly.
DEEPER = 4


def idw_pairs(queries: DataFrame, samples: DataFrame, key: str, k: int = 4, cell: float = 8.0) -> DataFrame:
    """(key, _z, _o, _d): samples among which a query's k nearest are, with their distance.

    Samples are counted in cells of every doubling of ``cell`` up to one that covers them all, and of every halving down to
    a 4**DEEPER-th of the area that a row has if all are spread evenly, so that a block's samples stay few however many
    there are.  Of the samples at one place only the first k by ``ord`` can count.  Each query takes the
    smallest size at which its 3x3 block of cells holds k samples: those lie within 2 * sqrt(2) cells, so the k nearest
    are in the 7x7 block.  Dense places thus look only into small cells and lonely ones into large.  A query farther
    out than the largest block takes all samples of the top cells.  One join finds the size and one the samples, both by sorting, as the driver
    would be sent every size of every sample; ``ord`` breaks distance ties.  With fewer than k samples all of them count; with none there is no row.
    """
    lo = samples.unionByName(queries.select("x", "y"), allowMissingColumns=True).agg(
        *[f(c_) for f in (F.min, F.max) for c_ in ("x", "y")], F.count(F.lit(1))).first()
    if lo[0] is None:
        return queries.crossJoin(samples.select(F.col("z").alias("_z"), F.col("ord").alias("_o"))).select(key, "_z", "_o", F.lit(0.0).alias("_d")).limit(0)
    span = max(lo[2] - lo[0], lo[3] - lo[1], cell)
    top = max(0, math.ceil(math.log2(span / cell)))   # two neighbouring cells of this size cover everything
    low = min(0, math.floor(math.log2(span / cell) - math.log2(lo[4]) / 2) - DEEPER)
    levels = F.sequence(F.lit(low), F.lit(top))
    size = F.lit(float(cell)) * F.pow(F.lit(2.0), F.col("_lv"))
    at = lambda v: F.floor(F.col(v) / size)
    first = samples.withColumn("_r", F.row_number().over(Window.partitionBy("x", "y").orderBy("ord"))).filter(F.col("_r") <= k)
    s = first.select(F.col("x").alias("_sx"), F.col("y").alias("_sy"), F.col("z").alias("_z"), F.col("ord").alias("_o"), F.explode(levels).alias("_lv"))
    s = s.withColumns({"_cx": at("_sx"), "_cy": at("_sy")})
    full = s.groupBy("_lv", "_cx", "_cy").agg(F.count(F.lit(1)).alias("_n"))
    step = lambda r: F.array(*[F.lit(i) for i in range(-r, r + 1)])
    # a few bytes of a query become hundreds of pairs, which tasks merged by bytes would sort in one
    q = queries.select(key, "x", "y").repartition(int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)

    def block(df: DataFrame, r: int) -> DataFrame:
        return (df.withColumn("_i", F.explode(step(r))).withColumn("_j", F.explode(step(r)))
                .withColumns({"_cx": at("x") + F.col("_i"), "_cy": at("y") + F.col("_j")}).drop("_i", "_j"))

    around = block(q.withColumn("_lv", F.explode(levels)), 1).join(_unsent(full), ["_lv", "_cx", "_cy"]).groupBy(key, "_lv").agg(F.sum("_n").alias("_n"))
    chosen = around.groupBy(key).agg(F.coalesce(F.min(F.when(F.col("_n") >= k, F.col("_lv"))), F.lit(top)).alias("_lv"))
    return block(q.join(_unsent(chosen), key), 3).join(_unsent(s), ["_lv", "_cx", "_cy"]).withColumn("_d", F.hypot(F.col("x") - F.col("_sx"), F.col("y") - F.col("_sy"))).select(key, "_z", "_o", "_d")


def idw(queries: DataFrame, samples: DataFrame, key: str, k: int = 4, cell: float = 8.0, snap: float = 1.0) -> DataFrame:
    """P-16: inverse-square mean of the k nearest samples, exact at any density and distance.  Ties and few samples: see ``idw_pairs``."""
    pairs = idw_pairs(queries, samples, key, k, cell)
    best = pairs.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy("_d", "_o"))).filter(F.col("_r") <= k)
    sq = F.nullif(F.col("_d") * F.col("_d"), F.lit(0.0))
    g = best.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min_by("_z", "_r").alias("z1"), F.min("_d").alias("d1"), F.sum(1 / sq).alias("w"), F.sum(F.col("_z") / sq).alias("v"))
    return g.select(key, F.when(F.col("d1") < snap, F.col("z1")).otherwise(F.col("v") / F.col("w")).alias("z"), F.col("n").cast("bigint").alias("used"))


def placed_dots(dots: DataFrame, targets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """P-22: observed finishes put round a target: (keys, course_id, hole, x, y, and the dots' other columns).

    ``dots`` (keys, sx, sy) are offsets right of and short of where a shot was aimed; ``targets`` (keys, course_id, hole,
    ball_x, ball_y, target_x, target_y).  Offsets turn with the line from ball to target; a target on the ball has none.
    """
    t = targets.withColumn("_l", F.hypot(F.col("target_x") - F.col("ball_x"), F.col("target_y") - F.col("ball_y"))).filter(F.col("_l") >= 1e-9)
    t = t.select(*keys, "course_id", "hole", "target_x", "target_y", ((F.col("target_x") - F.col("ball_x")) / F.col("_l")).alias("_fx"), ((F.col("target_y") - F.col("ball_y")) / F.col("_l")).alias("_fy"))
    j = dots.join(t, list(keys))
    return j.select(*keys, "course_id", "hole", *[k for k in dots.columns if k not in (*keys, "sx", "sy")],
                    (F.col("target_x") + F.col("_fy") * F.col("sx") - F.col("_fx") * F.col("sy")).alias("x"), (F.col("target_y") - F.col("_fx") * F.col("sx") - F.col("_fy") * F.col("sy")).alias("y"))


def dot_tones(dots: DataFrame, targets: DataFrame, features: DataFrame, keys: Sequence[str], bounded: DataFrame | None = None) -> DataFrame:
    """P-22: (keys, course_id, hole, tone, n): where a player's shots would finish round each target; every shot counts."""
    s = surface(placed_dots(dots, targets, keys), features, "shot_id", bounded)
    return s.groupBy(*keys, "course_id", "hole", tone("surface").alias("tone")).agg(F.count(F.lit(1)).alias("n"))


def near_tee(points: DataFrame, tees: DataFrame, tee_points: DataFrame, key: str, yds: float) -> DataFrame:
    """P-24: (key, on_tee): within ``yds`` of one of the hole's tee boxes, or of its tee point where no box is mapped.

    ``points``: key, course_id, hole, x, y; ``tees``: features with ``f_hole``; ``tee_points``: course_id, hole, tee_x, tee_y.
    """
    boxes = tees.filter(F.size("ring") >= 3)
    own = boxes.select("course_id", F.col("f_hole").alias("hole"), "ring", "inner")
    hit = _with_nearest(points, own, yds, ["hole"], "hole", ["hole"]).select(key).distinct().withColumn("_hit", F.lit(True))
    mapped = boxes.select("course_id", F.col("f_hole").alias("hole"), F.lit(True).alias("_mapped")).distinct()
    out = points.join(hit, key, "left").join(mapped, ["course_id", "hole"], "left").join(tee_points, ["course_id", "hole"], "left")
    at = F.hypot(F.col("x") - F.col("tee_x"), F.col("y") - F.col("tee_y")) <= yds
    return out.select(key, F.coalesce(F.when(F.col("_mapped"), F.coalesce("_hit", F.lit(False))).otherwise(at), F.lit(False)).alias("on_tee"))


def orphan_greens(greens: DataFrame, assigned: DataFrame) -> DataFrame:
    """J-15: greens (course_id, feature_id) that no hole was given (``green_id`` of ``assign_greens``)."""
    return greens.select("course_id", "feature_id").join(assigned.select(F.col("green_id").alias("feature_id")).filter("feature_id IS NOT NULL").distinct(), "feature_id", "left_anti").select("course_id", "feature_id")
