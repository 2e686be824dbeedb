"""Distances on the sphere, and the climatological variogram."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Radius of the Earth in km that distances are computed with.
EARTH_KM = 6367


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle distance in km of points in degrees."""
    u, v = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((v - u) / 2), 2) + F.cos(u) * F.cos(v) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def haversine_sql(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    h = f"pow(sin((radians({lat2}) - radians({lat1})) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin((radians({lon2}) - radians({lon1})) / 2), 2)"
    return f"(2 * {EARTH_KM} * asin(least(1.0, sqrt({h}))))"


def climatological_variogram(date: Column, hours: Column) -> dict[str, Column]:
    """sill, range (km) and nugget of the spherical variogram of a day after van de Beek et al. 2012.

    Numbers are the published coefficients; the fourth root of both quantities is a yearly cosine whose mean,
    amplitude and phase are powers of the time scale in hours.
    """

    def wave(mean: float, mean_p: float, amplitude: float, amplitude_p: float, phase: float, phase_p: float) -> Column:
        day = F.dayofyear(date).cast("double") - phase * F.pow(hours, F.lit(phase_p))
        return F.pow(mean * F.pow(hours, F.lit(mean_p)) + amplitude * F.pow(hours, F.lit(amplitude_p)) * F.cos(2 * math.pi / 365 * day), F.lit(4.0))

    sill = wave(0.84, -0.25, 0.20, -0.37, 162.0, -0.03)
    return {"sill": sill, "range": wave(15.51, 0.09, 2.06, -0.12, 7.37, 0.22) / 1000, "nugget": 0.1 * sill}
