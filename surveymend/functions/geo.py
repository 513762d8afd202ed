"""Distances, speeds, coordinates and the validation flags made from them; all are column expressions. Nulls stay null
in measures and count as False in flags, except that missing coordinates are bad ones."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Earth's mean radius in km; the country's box (latitude, longitude); speed limits in km/h by mode.
EARTH_KM = 6371.0
LATITUDES, LONGITUDES = (54.5, 57.8), (8.0, 15.2)
WALK, BIKE, CAR = 1, 2, (3, 25)
LIMITS = {"walk": 15.0, "bike": 60.0, "car": 180.0}
#: Ports of the routing servers by profile.
PORTS = {"foot": 5002, "bike": 5001, "car": 5000}


def _false(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle km."""
    p, q = F.radians(lat1), F.radians(lat2)
    a = F.pow(F.sin((q - p) / 2), F.lit(2.0)) + F.cos(p) * F.cos(q) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), F.lit(2.0))
    return F.lit(2 * EARTH_KM) * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def in_bounds(lat: Column, lon: Column) -> Column:
    """Inside the country's box, edges included; missing coordinates are not."""
    return _false(lat.between(*LATITUDES) & lon.between(*LONGITUDES))


def speed(km: Column, minutes: Column) -> Column:
    """km/h; null at no minutes."""
    return F.try_divide(km.cast("double"), minutes.cast("double") / F.lit(60.0))


def limit_of(mode: Column) -> Column:
    """The speed limit of a mode; null for modes that have none."""
    return F.when(mode == WALK, LIMITS["walk"]).when(mode == BIKE, LIMITS["bike"]).when(mode.between(*CAR), LIMITS["car"])


def speed_bad(km: Column, minutes: Column, mode: Column) -> Column:
    return _false(speed(km, minutes) > limit_of(mode))


def zero_distance(geo_km: Column, reported_km: Column) -> Column:
    """No way between the ends, but more than a kilometre reported."""
    return _false((geo_km < 0.005) & (reported_km > 1))


def guarded_speed(km: Column, minutes: Column) -> Column:
    """km/h; 9999 where minutes aren't positive, null where they are missing."""
    return F.when(minutes <= 0, F.lit(9999.0)).otherwise(km / minutes * 60)


def limit_or_car(mode: Column) -> Column:
    return F.when(mode == WALK, LIMITS["walk"]).when(mode == BIKE, LIMITS["bike"]).otherwise(F.lit(LIMITS["car"]))


def realistic(kmh: Column, mode: Column) -> Column:
    return _false((kmh > 0) & (kmh <= limit_or_car(mode)))


def impossible(kmh: Column, mode: Column) -> Column:
    """Not the complement of realistic: a missing speed is neither."""
    return _false(kmh > limit_or_car(mode))


def valid_speed(kmh: Column, closed: bool = True) -> Column:
    """A speed in [1, 130], or in (0, 130) where not closed."""
    return _false(kmh.between(1, 130) if closed else (kmh > 0) & (kmh < 130))


def profile(mode: Column) -> Column:
    """Routing profile of a mode given as a number or as text; null where there is none. Fractions are cut off."""
    m = mode.try_cast("double").cast("int")
    return F.when(m == WALK, "foot").when(m == BIKE, "bike").when(m.between(*CAR), "car")


def utm_to_latlon(east: Column, north: Column, zone: int = 32) -> tuple[Column, Column]:
    """Latitude and longitude (degrees) of northern-hemisphere UTM metres, by the third-order Krüger series on WGS84."""
    a, f = 6378137.0, 1 / 298.257223563
    n = f / (2 - f)
    radius = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    beta = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480)
    delta = (2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15)
    xi, eta = north / F.lit(0.9996 * radius), (east - 500000) / F.lit(0.9996 * radius)
    x = xi - sum((F.lit(b) * F.sin(2 * (j + 1) * xi) * F.cosh(2 * (j + 1) * eta) for j, b in enumerate(beta)), F.lit(0.0))
    y = eta - sum((F.lit(b) * F.cos(2 * (j + 1) * xi) * F.sinh(2 * (j + 1) * eta) for j, b in enumerate(beta)), F.lit(0.0))
    chi = F.asin(F.sin(x) / F.cosh(y))
    lat = chi + sum((F.lit(d) * F.sin(2 * (j + 1) * chi) for j, d in enumerate(delta)), F.lit(0.0))
    return F.degrees(lat), F.lit(float(6 * zone - 183)) + F.degrees(F.atan2(F.sinh(y), F.cos(x)))


def latlon_to_utm(lat: float, lon: float, zone: int = 32) -> tuple[float, float]:
    """The forward series in plain Python, for tests of the inverse."""
    a, f = 6378137.0, 1 / 298.257223563
    n = f / (2 - f)
    radius = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    e = 2 * math.sqrt(n) / (1 + n)
    s = math.sin(math.radians(lat))
    t = math.sinh(math.atanh(s) - e * math.atanh(e * s))
    dl = math.radians(lon - (6 * zone - 183))
    xi, eta = math.atan2(t, math.cos(dl)), math.atanh(math.sin(dl) / math.sqrt(1 + t * t))
    x = xi + sum(k * math.sin(2 * (j + 1) * xi) * math.cosh(2 * (j + 1) * eta) for j, k in enumerate(alpha))
    y = eta + sum(k * math.cos(2 * (j + 1) * xi) * math.sinh(2 * (j + 1) * eta) for j, k in enumerate(alpha))
    return 500000 + 0.9996 * radius * y, 0.9996 * radius * x
