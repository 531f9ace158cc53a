"""The scalar helpers as SQL functions: plain SQL bodies, which the optimiser puts into the query in place."""

from __future__ import annotations

from pyspark.sql import SparkSession

from loftline.settings import EARTH_M, YARDS_PER_METRE

_RING = "ARRAY<STRUCT<x: DOUBLE, y: DOUBLE>>"
#: name -> (parameters, type, body)
FUNCTIONS: dict[str, tuple[str, str, str]] = {
    "half_up": ("v DOUBLE, digits INT", "DOUBLE", "floor(v * pow(10, digits) + 0.5) / pow(10, digits)"),
    "wrap180": ("deg DOUBLE", "DOUBLE", "pmod(deg + 540, 360) - 180"),
    "yards": ("metres DOUBLE", "DOUBLE", f"metres * {YARDS_PER_METRE}D"),
    "haversine_m": ("lat1 DOUBLE, lng1 DOUBLE, lat2 DOUBLE, lng2 DOUBLE", "DOUBLE",
                    f"{2 * EARTH_M}D * asin(least(1D, sqrt(pow(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lng2 - lng1) / 2), 2))))"),
    "bearing_deg": ("lat1 DOUBLE, lng1 DOUBLE, lat2 DOUBLE, lng2 DOUBLE", "DOUBLE",
                    "pmod(degrees(atan2(sin(radians(lng2 - lng1)) * cos(radians(lat2)), cos(radians(lat1)) * sin(radians(lat2)) - sin(radians(lat1)) * cos(radians(lat2)) * cos(radians(lng2 - lng1)))) + 360, 360)"),
    "dest_lat": ("lat DOUBLE, brg DOUBLE, dist_m DOUBLE", "DOUBLE",
                 f"degrees(asin(sin(radians(lat)) * cos(dist_m / {EARTH_M}D) + cos(radians(lat)) * sin(dist_m / {EARTH_M}D) * cos(radians(brg))))"),
    "dest_lng": ("lat DOUBLE, lng DOUBLE, brg DOUBLE, dist_m DOUBLE", "DOUBLE",
                 f"wrap180(lng + degrees(atan2(sin(radians(brg)) * sin(dist_m / {EARTH_M}D) * cos(radians(lat)), cos(dist_m / {EARTH_M}D) - sin(radians(lat)) * sin(radians(dest_lat(lat, brg, dist_m))))))"),
    "ring_area": (f"ring {_RING}", "DOUBLE",
                  "abs(aggregate(sequence(0, size(ring) - 1), 0D, (s, i) -> s + ring[i].x * ring[(i + 1) % size(ring)].y - ring[(i + 1) % size(ring)].x * ring[i].y)) / 2"),
    "ring_contains": (f"ring {_RING}, px DOUBLE, py DOUBLE", "BOOLEAN",
                      "size(ring) >= 3 AND aggregate(sequence(0, size(ring) - 1), false, (odd, i) -> odd <> ((ring[i].y > py) <> (ring[(i + 1) % size(ring)].y > py)"
                      " AND coalesce(px < (ring[(i + 1) % size(ring)].x - ring[i].x) * (py - ring[i].y) / nullif(ring[(i + 1) % size(ring)].y - ring[i].y, 0D) + ring[i].x, false)))"),
}


def register(spark: SparkSession) -> list[str]:
    """Makes the functions known to ``spark.sql`` for this session; returns their names."""
    for name, (params, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS {kind} RETURN {body}")
    return list(FUNCTIONS)
