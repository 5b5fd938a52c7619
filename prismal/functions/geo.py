"""Geolocation as column expressions: fixed-grid geostationary views and push-broom scenes. Degrees outside, radians inside."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the geostationary view: metres and radians.
EQUATOR, POLE, ORBIT, ECCENTRICITY = 6378137.0, 6356752.31414, 42164160.0, 0.0818191910435
MERIDIAN, PIXEL, OFFSET = -1.308996939, 5.6e-5, 0.151844
# Fixed values of the push-broom scene: metres a pixel, the middle row, the angle to east and the scene's origin.
STEP_X, STEP_Y, MIDDLE, ANGLE = 0.92167, 12.358, 239.5, math.radians(149.0)
ORIGIN = (-108.21367912062485, 34.714010512782387)
FLATTENING = (EQUATOR / POLE) ** 2


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x)) if isinstance(x, (int, float)) else F.col(x)


def geocentric_lat(phi) -> Column:
    return F.atan(F.tan(_c(phi)) / FLATTENING)


def geocentric_distance(phi_c) -> Column:
    cos = F.cos(_c(phi_c))
    return F.lit(POLE) / F.sqrt(1.0 - ECCENTRICITY**2 * cos * cos)


def satellite_distance(y, x) -> Column:
    """Along a line of sight to the ellipsoid; NaN off the disk, and for angles that look away from it."""
    y, x = _c(y), _c(x)
    sx, cx, sy, cy = F.sin(x), F.cos(x), F.sin(y), F.cos(y)
    a = sx * sx + cx * cx * (cy * cy + FLATTENING * sy * sy)
    half = ORBIT * cx * cy
    return F.when(half > 0, (half - F.sqrt(half * half - a * (ORBIT**2 - EQUATOR**2))) / a).otherwise(F.lit(float("nan")))


def view_from_lat_lon(lat, lon) -> tuple[Column, Column, Column]:
    phi, theta = geocentric_lat(F.radians(_c(lat))), F.radians(_c(lon)) - MERIDIAN
    r = geocentric_distance(phi)
    return F.lit(ORBIT) - r * F.cos(phi) * F.cos(theta), -r * F.cos(phi) * F.sin(theta), r * F.sin(phi)


def view_from_grid(y, x, distance) -> tuple[Column, Column, Column]:
    y, x, d = _c(y), _c(x), _c(distance)
    return d * F.cos(x) * F.cos(y), -d * F.sin(x), d * F.cos(x) * F.sin(y)


def is_visible(lat, lon) -> Column:
    sx, sy, sz = view_from_lat_lon(lat, lon)
    return ORBIT * (ORBIT - sx) > sy * sy + FLATTENING * sz * sz


def index_to_radians(row, col) -> tuple[Column, Column]:
    return OFFSET - _c(row) * PIXEL, _c(col) * PIXEL - OFFSET


def radians_to_index(y, x, scale: float = 1.0) -> tuple[Column, Column]:
    return (OFFSET - _c(y)) / PIXEL / scale, (_c(x) + OFFSET) / PIXEL / scale


def grid_to_geo(x, y) -> tuple[Column, Column]:
    """(lon, lat) of fixed-grid angles; NaN off the disk."""
    sx, sy, sz = view_from_grid(y, x, satellite_distance(y, x))
    lat = F.atan(FLATTENING * sz / F.sqrt((ORBIT - sx) * (ORBIT - sx) + sy * sy))
    return F.degrees(MERIDIAN - F.atan(sy / (ORBIT - sx))), F.degrees(lat)


def geo_to_index(lat, lon, scale: float = 1.0) -> tuple[Column, Column]:
    """(row, col), null where the place isn't visible."""
    sx, sy, sz = view_from_lat_lon(lat, lon)
    y, x = F.atan(sz / sx), F.asin(-sy / F.sqrt(sx * sx + sy * sy + sz * sz))
    seen = is_visible(lat, lon)
    row, col = radians_to_index(y, x, scale)
    return F.when(seen, row), F.when(seen, col)


def in_turn_of(angle, near) -> Column:
    """The angle, by whole turns, that is nearest to another one. A place on the globe doesn't tell how often a view's angles went round."""
    angle, near = _c(angle), _c(near)
    return angle + F.rint((near - angle) / (2 * math.pi)) * (2 * math.pi)


def geo_to_grid(lon, lat) -> tuple[Column, Column]:
    """Fixed-grid angles (x, y) of less than a turn, null where the place isn't visible."""
    sx, sy, sz = view_from_lat_lon(lat, lon)
    seen = is_visible(lat, lon)
    return F.when(seen, F.asin(-sy / F.sqrt(sx * sx + sy * sy + sz * sz))), F.when(seen, F.atan(sz / sx))


def index_to_geo(row, col) -> tuple[Column, Column]:
    """(lat, lon) of a pixel."""
    y, x = index_to_radians(row, col)
    lon, lat = grid_to_geo(x, y)
    return lat, lon


def index_of(lat: float, lon: float, scale: float = 1.0) -> tuple[float, float]:
    """geo_to_index() of one place, on the driver; an invisible place is an error."""
    phi = math.atan(math.tan(math.radians(lat)) / FLATTENING)
    r, theta = POLE / math.sqrt(1 - (ECCENTRICITY * math.cos(phi)) ** 2), math.radians(lon) - MERIDIAN
    sx, sy, sz = ORBIT - r * math.cos(phi) * math.cos(theta), -r * math.cos(phi) * math.sin(theta), r * math.sin(phi)
    if not ORBIT * (ORBIT - sx) > sy * sy + FLATTENING * sz * sz:
        raise ValueError(f"({lat}, {lon}) can't be seen")
    return (OFFSET - math.atan(sz / sx)) / PIXEL / scale, (OFFSET + math.asin(-sy / math.sqrt(sx * sx + sy * sy + sz * sz))) / PIXEL / scale


def scene_xy(ix, iy) -> tuple[Column, Column]:
    """Metres of a push-broom pixel."""
    return STEP_X * _c(ix), STEP_Y * (MIDDLE - _c(iy))


def scene_index(x, y) -> tuple[Column, Column]:
    """The push-broom pixel of scene metres."""
    return _c(x) / STEP_X, MIDDLE - _c(y) / STEP_Y


def rotate(x, y, angle: float) -> tuple[Column, Column]:
    x, y = _c(x), _c(y)
    return x * math.cos(angle) - y * math.sin(angle), x * math.sin(angle) + y * math.cos(angle)
