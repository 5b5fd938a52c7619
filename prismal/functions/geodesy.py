"""Geodesics on the WGS84 ellipsoid (Vincenty), over whole batches in pandas UDFs without state."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .geo import ANGLE, ORIGIN, _c, rotate, scene_xy

A, INVERSE = 6378137.0, 298.257223563
FLAT = 1 / INVERSE
_LON_LAT, _XY = (StructType([StructField(n, DoubleType()) for n in names]) for names in (("lon", "lat"), ("x", "y")))
B = A * (1 - FLAT)


def _series(cos2_alpha):
    u2 = cos2_alpha * (A * A - B * B) / (B * B)
    return 1 + u2 / 16384 * (4096 + u2 * (-768 + u2 * (320 - 175 * u2))), u2 / 1024 * (256 + u2 * (-128 + u2 * (74 - 47 * u2)))


def _delta(k, sin_s, cos_s, cos_2m):
    return k * sin_s * (cos_2m + k / 4 * (cos_s * (2 * cos_2m**2 - 1) - k / 6 * cos_2m * (4 * sin_s**2 - 3) * (4 * cos_2m**2 - 3)))


def direct(lon, lat, azimuth, distance) -> tuple[np.ndarray, np.ndarray]:
    """(lon, lat) reached from a place; degrees clockwise from north, metres."""
    phi, alpha, s = np.radians(lat), np.radians(azimuth), np.asarray(distance, float)
    u1 = np.arctan((1 - FLAT) * np.tan(phi))
    sigma1, sin_a = np.arctan2(np.tan(u1), np.cos(alpha)), np.cos(u1) * np.sin(alpha)
    cos2_a = 1 - sin_a**2
    big, k = _series(cos2_a)
    sigma = start = s / (B * big)
    for _ in range(12):
        cos_2m = np.cos(2 * sigma1 + sigma)
        sigma = start + _delta(k, np.sin(sigma), np.cos(sigma), cos_2m)
    cos_2m = np.cos(2 * sigma1 + sigma)
    t = np.sin(u1) * np.sin(sigma) - np.cos(u1) * np.cos(sigma) * np.cos(alpha)
    out_lat = np.arctan2(np.sin(u1) * np.cos(sigma) + np.cos(u1) * np.sin(sigma) * np.cos(alpha), (1 - FLAT) * np.hypot(sin_a, t))
    lam = np.arctan2(np.sin(sigma) * np.sin(alpha), np.cos(u1) * np.cos(sigma) - np.sin(u1) * np.sin(sigma) * np.cos(alpha))
    c = FLAT / 16 * cos2_a * (4 + FLAT * (4 - 3 * cos2_a))
    turn = lam - (1 - c) * FLAT * sin_a * (sigma + c * np.sin(sigma) * (cos_2m + c * np.cos(sigma) * (2 * cos_2m**2 - 1)))
    return lon + np.degrees(turn), np.degrees(out_lat)


def inverse(lon1, lat1, lon2, lat2) -> tuple[np.ndarray, np.ndarray]:
    """(azimuth, distance) from the first place to the second; 0 for the same place."""
    u1, u2 = np.arctan((1 - FLAT) * np.tan(np.radians(lat1))), np.arctan((1 - FLAT) * np.tan(np.radians(lat2)))
    l = lam = np.radians(np.asarray(lon2, float) - lon1)  # noqa: E741
    for _ in range(60):
        p, q = np.cos(u2) * np.sin(lam), np.cos(u1) * np.sin(u2) - np.sin(u1) * np.cos(u2) * np.cos(lam)
        sin_s, cos_s = np.hypot(p, q), np.sin(u1) * np.sin(u2) + np.cos(u1) * np.cos(u2) * np.cos(lam)
        sigma = np.arctan2(sin_s, cos_s)
        with np.errstate(invalid="ignore", divide="ignore"):
            sin_a = np.where(sin_s == 0, 0.0, np.cos(u1) * np.cos(u2) * np.sin(lam) / np.where(sin_s == 0, 1, sin_s))
            cos2_a = 1 - sin_a**2
            cos_2m = np.where(cos2_a == 0, 0.0, cos_s - 2 * np.sin(u1) * np.sin(u2) / np.where(cos2_a == 0, 1, cos2_a))
        c = FLAT / 16 * cos2_a * (4 + FLAT * (4 - 3 * cos2_a))
        lam = l + (1 - c) * FLAT * sin_a * (sigma + c * sin_s * (cos_2m + c * cos_s * (2 * cos_2m**2 - 1)))
    big, k = _series(cos2_a)
    return np.degrees(np.arctan2(p, q)), B * big * (sigma - _delta(k, sin_s, cos_s, cos_2m))


@F.pandas_udf(_LON_LAT)
def _xy_to_geo(x: pd.Series, y: pd.Series) -> pd.DataFrame:
    lon, lat = direct(*ORIGIN, np.degrees(np.arctan2(x.to_numpy(float), y.to_numpy(float))), np.hypot(x.to_numpy(float), y.to_numpy(float)))
    return pd.DataFrame({"lon": lon, "lat": lat})


@F.pandas_udf(_XY)
def _geo_to_xy(lon: pd.Series, lat: pd.Series) -> pd.DataFrame:
    a, d = inverse(*ORIGIN, lon.to_numpy(float), lat.to_numpy(float))
    return pd.DataFrame({"x": d * np.sin(np.radians(a)), "y": d * np.cos(np.radians(a))})


def xy_to_geo(x, y) -> Column:
    """Struct (lon, lat) of metres east and north of the scene's origin."""
    return _xy_to_geo(_c(x), _c(y))


def geo_to_xy(lon, lat) -> Column:
    return _geo_to_xy(_c(lon), _c(lat))


def scene_to_geo(x, y) -> Column:
    """Struct (lon, lat) of scene metres, which are turned by ANGLE."""
    return xy_to_geo(*rotate(x, y, ANGLE))


def scene_index_to_geo(ix, iy) -> Column:
    return scene_to_geo(*scene_xy(ix, iy))


def geo_to_scene(lon, lat) -> tuple[Column, Column]:
    """(x, y) in scene metres."""
    found = geo_to_xy(lon, lat)
    return rotate(found["x"], found["y"], -ANGLE)
