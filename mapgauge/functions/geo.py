"""Distances on the Earth."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mean radius in km, radius in m, and the WGS-84 ellipsoid.
RADIUS_KM = 6371.0088
RADIUS_M = 6371000.0
WGS84_A, WGS84_F = 6378137.0, 1 / 298.257223563


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _half_chord(lat1, lon1, lat2, lon2) -> Column:
    lat1, lon1, lat2, lon2 = map(_col, (lat1, lon1, lat2, lon2))
    a, b = F.sin(F.radians(lat2 - lat1) / 2), F.sin(F.radians(lon2 - lon1) / 2)
    return a * a + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * b * b


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    """M1."""
    a = _half_chord(lat1, lon1, lat2, lon2)
    return F.lit(RADIUS_KM) * 2 * F.atan2(F.sqrt(a), F.sqrt(F.greatest(F.lit(0.0), 1 - a)))


def haversine_m(lat1, lon1, lat2, lon2) -> Column:
    """M2: another radius and unit than M1."""
    return F.lit(RADIUS_M) * 2 * F.asin(F.sqrt(F.least(F.lit(1.0), _half_chord(lat1, lon1, lat2, lon2))))


def vincenty_km(lat1, lon1, lat2, lon2, rounds: int = 200) -> np.ndarray:
    """M3: length of the geodesic on WGS-84 by the published inverse formula; where that does not converge (nearly
    opposite points) the longest longitude difference that does is taken."""
    a, f = WGS84_A, WGS84_F
    b = a * (1 - f)
    lat1, lon1, lat2, lon2 = (np.radians(np.asarray(x, float)) for x in (lat1, lon1, lat2, lon2))
    u1, u2 = np.arctan((1 - f) * np.tan(lat1)), np.arctan((1 - f) * np.tan(lat2))
    L = (lon2 - lon1 + np.pi) % (2 * np.pi) - np.pi
    lam = L.copy()
    s1, c1, s2, c2 = np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2)
    with np.errstate(invalid="ignore", divide="ignore"):
        for _ in range(rounds):
            sl, cl = np.sin(lam), np.cos(lam)
            ss = np.sqrt((c2 * sl) ** 2 + (c1 * s2 - s1 * c2 * cl) ** 2)
            cs = s1 * s2 + c1 * c2 * cl
            sigma = np.arctan2(ss, cs)
            sa = np.where(ss > 0, c1 * c2 * sl / np.where(ss > 0, ss, 1), 0)
            ca2 = 1 - sa**2
            cm = np.where(ca2 > 1e-15, cs - 2 * s1 * s2 / np.where(ca2 > 1e-15, ca2, 1), 0)
            C = f / 16 * ca2 * (4 + f * (4 - 3 * ca2))
            new = L + (1 - C) * f * sa * (sigma + C * ss * (cm + C * cs * (2 * cm**2 - 1)))
            new = np.clip(new, -np.pi, np.pi)
            done = np.nanmax(np.abs(new - lam), initial=0) < 1e-12
            lam = new
            if done:
                break
        k = ca2 * (a**2 - b**2) / b**2
        A = 1 + k / 16384 * (4096 + k * (-768 + k * (320 - 175 * k)))
        B = k / 1024 * (256 + k * (-128 + k * (74 - 47 * k)))
        d = B * ss * (cm + B / 4 * (cs * (2 * cm**2 - 1) - B / 6 * cm * (4 * ss**2 - 3) * (4 * cm**2 - 3)))
    return b * A * (sigma - d) / 1000


def geodesic_km(lat1, lon1, lat2, lon2) -> Column:
    """M3 as a column, vectorised over Arrow batches; null where any input is null."""

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series(vincenty_km(a, b, c, d))

    return run(*map(_col, (lat1, lon1, lat2, lon2)))
