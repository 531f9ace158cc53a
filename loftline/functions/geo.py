"""Great-circle and local-frame helpers on latitude/longitude columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from loftline.functions.numbers import c, wrap180
from loftline.settings import EARTH_M, YARDS_PER_METRE

RAD = math.pi / 180.0


def haversine_m(lat1, lng1, lat2, lng2) -> Column:
    dlat, dlng = (c(lat2) - c(lat1)) * RAD, (c(lng2) - c(lng1)) * RAD
    h = F.pow(F.sin(dlat / 2), 2) + F.cos(c(lat1) * RAD) * F.cos(c(lat2) * RAD) * F.pow(F.sin(dlng / 2), 2)
    return F.lit(2 * EARTH_M) * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def bearing_deg(lat1, lng1, lat2, lng2) -> Column:
    dl = (c(lng2) - c(lng1)) * RAD
    a, b = c(lat1) * RAD, c(lat2) * RAD
    y = F.sin(dl) * F.cos(b)
    x = F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(dl)
    return F.pmod(F.atan2(y, x) / RAD + 360.0, F.lit(360.0))


def dest_lat(lat, brg, dist_m) -> Column:
    d = c(dist_m) / EARTH_M
    a = c(lat) * RAD
    return F.asin(F.sin(a) * F.cos(d) + F.cos(a) * F.sin(d) * F.cos(c(brg) * RAD)) / RAD


def dest_lng(lat, lng, brg, dist_m) -> Column:
    d = c(dist_m) / EARTH_M
    a = c(lat) * RAD
    b = dest_lat(lat, brg, dist_m) * RAD
    return wrap180(c(lng) + F.atan2(F.sin(c(brg) * RAD) * F.sin(d) * F.cos(a), F.cos(d) - F.sin(a) * F.sin(b)) / RAD)


def to_frame(lat, lng, lat0, lng0, bearing) -> tuple[Column, Column]:
    """Yards right of / up the hole from the origin, with +y along the hole's bearing."""
    k = RAD * EARTH_M * YARDS_PER_METRE
    e = (c(lng) - c(lng0)) * k * F.cos(c(lat0) * RAD)
    n = (c(lat) - c(lat0)) * k
    b = c(bearing) * RAD
    return e * F.cos(b) - n * F.sin(b), e * F.sin(b) + n * F.cos(b)


def from_frame(x, y, lat0, lng0, bearing) -> tuple[Column, Column]:
    """The inverse of ``to_frame``: latitude and longitude."""
    k = RAD * EARTH_M * YARDS_PER_METRE
    b = c(bearing) * RAD
    e = c(x) * F.cos(b) + c(y) * F.sin(b)
    n = c(y) * F.cos(b) - c(x) * F.sin(b)
    return c(lat0) + n / k, c(lng0) + e / (k * F.cos(c(lat0) * RAD))


def tile_x(lng, zoom) -> Column:
    return F.floor((c(lng) + 180.0) / 360.0 * F.pow(F.lit(2.0), c(zoom)))


def tile_y(lat, zoom) -> Column:
    r = c(lat) * RAD
    return F.floor((F.lit(1.0) - F.ln(F.tan(r) + F.lit(1.0) / F.cos(r)) / math.pi) / 2.0 * F.pow(F.lit(2.0), c(zoom)))
