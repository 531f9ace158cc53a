"""Polygon helpers on ``array<struct<x,y>>`` columns: higher-order functions, no Python per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loftline.functions.numbers import c


def pt(x, y) -> Column:
    return F.struct(c(x).cast("double").alias("x"), c(y).cast("double").alias("y"))


def edges(ring) -> Column:
    """The ring's edges as ``array<struct<a,b>>``; the last vertex joins the first."""
    ring = c(ring)
    shifted = F.concat(F.slice(ring, F.lit(2), F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    return F.arrays_zip(ring.alias("a"), shifted.alias("b"))


def contains(ring, x, y) -> Column:
    """Even-odd ray cast with half-open edges, so a shared edge belongs to one side only."""
    px, py = c(x), c(y)

    # one pass over the vertices, carrying the previous one: no edge array is built per point
    def step(s, q):
        p = s["p"]
        crosses = ((p["y"] > py) != (q["y"] > py)) & (px < (q["x"] - p["x"]) * (py - p["y"]) / F.nullif(q["y"] - p["y"], F.lit(0.0)) + p["x"])
        return F.struct(q.alias("p"), (s["odd"] != F.coalesce(crosses, F.lit(False))).alias("odd"))

    start = F.struct(F.element_at(c(ring), -1).alias("p"), F.lit(False).alias("odd"))
    return F.when(F.size(c(ring)) >= 3, F.aggregate(c(ring), start, step, lambda s: s["odd"])).otherwise(F.lit(False))


def seg_distance(px, py, ax, ay, bx, by) -> Column:
    vx, vy = bx - ax, by - ay
    wx, wy = c(px) - ax, c(py) - ay
    l2 = vx * vx + vy * vy
    t = F.when(l2 == 0, F.lit(0.0)).otherwise(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), (wx * vx + wy * vy) / F.nullif(l2, F.lit(0.0)))))
    return F.hypot(c(px) - (ax + t * vx), c(py) - (ay + t * vy))


def edge_distance(ring, x, y) -> Column:
    """Shortest distance to the outline, whichever side the point is on."""
    return F.array_min(F.transform(
        edges(ring), lambda e: seg_distance(x, y, e["a"]["x"], e["a"]["y"], e["b"]["x"], e["b"]["y"])))


def distance(ring, x, y) -> Column:
    """0 inside, else the distance to the outline."""
    return F.when(contains(ring, x, y), F.lit(0.0)).otherwise(edge_distance(ring, x, y))


def area2(ring) -> Column:
    """Twice the signed area."""
    return F.aggregate(edges(ring), F.lit(0.0), lambda s, e: s + e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"])


def area(ring) -> Column:
    return F.abs(area2(ring)) / 2.0


def centroid(ring) -> Column:
    """Area-weighted centroid, or the vertex mean of a degenerate ring; taken relative to the first vertex."""
    ring = c(ring)
    ox, oy = ring[0]["x"], ring[0]["y"]

    def step(s, e):
        x1, y1 = e["a"]["x"] - ox, e["a"]["y"] - oy
        x2, y2 = e["b"]["x"] - ox, e["b"]["y"] - oy
        f = x1 * y2 - x2 * y1
        return F.struct((s["a"] + f).alias("a"), (s["x"] + (x1 + x2) * f).alias("x"), (s["y"] + (y1 + y2) * f).alias("y"))

    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    n = F.size(ring)
    mean = lambda k: F.aggregate(ring, F.lit(0.0), lambda t, p: t + p[k]) / n

    def middle(s):
        flat = (n < 3) | (F.abs(s["a"]) < 1e-12)
        a = F.nullif(s["a"], F.lit(0.0))
        return F.struct(F.when(flat, mean("x")).otherwise(ox + s["x"] / (3.0 * a)).alias("x"),
                        F.when(flat, mean("y")).otherwise(oy + s["y"] / (3.0 * a)).alias("y"))

    # as the sums' last step, or the optimiser would copy the whole fold into each place that reads it
    return F.aggregate(edges(ring), zero, step, middle)


def ray_span(ax, ay, dx, dy, ring) -> Column:
    """The nearest and farthest distance (``lo``, ``hi``) at which the ray from (ax, ay) along the unit vector (dx, dy) meets the ring; nulls if it does not or the vector is null.

    A ray through a vertex meets at least one of its edges, whatever the rounding.  One pass over the vertices, carrying the previous one.
    """
    ax, ay, dx, dy, ring = c(ax), c(ay), c(dx), c(dy), c(ring)
    none = F.lit(None).cast("double")

    def step(s, q):
        p = s["p"]
        ex, ey, rx, ry = q["x"] - p["x"], q["y"] - p["y"], p["x"] - ax, p["y"] - ay
        den = dx * ey - dy * ex
        u = (rx * dy - ry * dx) / F.nullif(den, F.lit(0.0))
        t = F.when((F.abs(den) >= 1e-12) & (u >= -1e-9) & (u <= 1 + 1e-9), (rx * ey - ry * ex) / F.nullif(den, F.lit(0.0)))
        return F.struct(q.alias("p"), s["h"].alias("h"), t.alias("t"))

    def kept(s, q):   # the hit of the step before is folded in before the next edge
        h = F.when(s["t"] >= 0, F.struct(F.least(s["h"]["lo"], s["t"]).alias("lo"), F.greatest(s["h"]["hi"], s["t"]).alias("hi"))).otherwise(s["h"])
        n = step(s, q)
        return F.struct(n["p"].alias("p"), h.alias("h"), n["t"].alias("t"))

    def last(s):
        return F.struct(F.when(s["t"] >= 0, F.least(s["h"]["lo"], s["t"])).otherwise(s["h"]["lo"]).alias("lo"),
                        F.when(s["t"] >= 0, F.greatest(s["h"]["hi"], s["t"])).otherwise(s["h"]["hi"]).alias("hi"))

    start = F.struct(F.element_at(ring, -1).alias("p"), F.struct(none.alias("lo"), none.alias("hi")).alias("h"), none.alias("t"))
    return F.aggregate(ring, start, kept, last)


def bbox(ring) -> dict[str, Column]:
    ring = c(ring)
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return {"x0": F.array_min(xs), "y0": F.array_min(ys), "x1": F.array_max(xs), "y1": F.array_max(ys)}


def cell(v, size: float) -> Column:
    return F.floor(c(v) / F.lit(float(size)))


def cover_cells(x0, y0, x1, y1, size: float, margin: float = 0.0) -> Column:
    """Every grid cell a box (grown by ``margin``) touches, as ``array<struct<cx,cy>>`` to explode."""
    xs = F.sequence(cell(c(x0) - margin, size), cell(c(x1) + margin, size))
    ys = F.sequence(cell(c(y0) - margin, size), cell(c(y1) + margin, size))
    return F.flatten(F.transform(xs, lambda i: F.transform(ys, lambda j: F.struct(i.alias("cx"), j.alias("cy")))))
