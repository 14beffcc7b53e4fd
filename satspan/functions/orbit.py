"""Orbital motion and look angles as column expressions (km, s, radians)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Gravity, radius, oblateness and ellipsoid of the Earth.
MU = 398600.4418
RE = 6378.137
J2 = 1.08262668e-3
E2 = 6.69437999014e-3
TAU = 2 * math.pi


def two_pi(x: Column) -> Column:
    """Angle in [0, 2 pi)."""
    return F.pmod(x, F.lit(TAU))


def mean_motion(a: Column) -> Column:
    return F.sqrt(F.lit(MU) / (a * a * a))


def secular_rates(a: Column, ecc: Column, inc: Column, j2: float = J2) -> tuple[Column, Column, Column]:
    """Rates of node, perigee and mean anomaly; ``j2=0`` gives two-body motion."""
    n = mean_motion(a)
    f = F.pow(F.lit(RE) / (a * (1 - ecc * ecc)), F.lit(2.0)) * j2
    c, s = F.cos(inc), F.sin(inc)
    return (
        -1.5 * n * f * c,
        0.75 * n * f * (5 * c * c - 1),
        n * (1 + 1.5 * f * F.sqrt(1 - ecc * ecc) * (1 - 1.5 * s * s)),
    )


def eccentric_anomaly(mean: Column, ecc: Column, steps: int = 8) -> Column:
    """Kepler's equation by a fixed number of Newton steps from E = M."""
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(steps)), mean, lambda e, _: e - (e - ecc * F.sin(e) - mean) / (1 - ecc * F.cos(e))
    )


def true_from_eccentric(e: Column, ecc: Column) -> Column:
    return 2 * F.atan2(F.sqrt(1 + ecc) * F.sin(e / 2), F.sqrt(1 - ecc) * F.cos(e / 2))


def mean_from_true(nu: Column, ecc: Column) -> Column:
    e = 2 * F.atan2(F.sqrt(1 - ecc) * F.sin(nu / 2), F.sqrt(1 + ecc) * F.cos(nu / 2))
    return two_pi(e - ecc * F.sin(e))


def gmst(julian_day: Column) -> Column:
    """Mean sidereal time (IAU 1982 polynomial), radians."""
    t = (julian_day - 2451545.0) / 36525.0
    seconds = 67310.54841 + (876600.0 * 3600 + 8640184.812866) * t + 0.093104 * t * t - 6.2e-6 * t * t * t
    return F.radians(F.pmod(seconds, F.lit(86400.0)) / 240.0)


def eci_position(a: Column, ecc: Column, inc: Column, node: Column, perigee: Column, mean: Column) -> tuple[Column, Column, Column]:
    """Inertial position; circular orbits skip the iteration."""
    nu = F.when(ecc == 0, mean).otherwise(true_from_eccentric(eccentric_anomaly(mean, ecc), ecc))
    r = a * (1 - ecc * ecc) / (1 + ecc * F.cos(nu))
    u = perigee + nu
    cu, su, cn, sn = F.cos(u), F.sin(u), F.cos(node), F.sin(node)
    return r * (cn * cu - sn * su * F.cos(inc)), r * (sn * cu + cn * su * F.cos(inc)), r * su * F.sin(inc)


def to_earth_fixed(x: Column, y: Column, angle: Column) -> tuple[Column, Column]:
    return F.cos(angle) * x + F.sin(angle) * y, F.cos(angle) * y - F.sin(angle) * x


def ground_position(lat_deg: Column, lon_deg: Column, height_km: Column | float = 0.0) -> tuple[Column, Column, Column]:
    lat, lon = F.radians(lat_deg), F.radians(lon_deg)
    h = F.lit(height_km) if isinstance(height_km, float) else height_km
    n = RE / F.sqrt(1 - E2 * F.sin(lat) * F.sin(lat))
    return (n + h) * F.cos(lat) * F.cos(lon), (n + h) * F.cos(lat) * F.sin(lon), (n * (1 - E2) + h) * F.sin(lat)


def local_axes(lat_deg: Column, lon_deg: Column) -> dict[str, tuple[Column, Column, Column]]:
    """East, north and up unit vectors of the geodetic normal."""
    lat, lon = F.radians(lat_deg), F.radians(lon_deg)
    zero = F.lit(0.0)
    return {
        "east": (-F.sin(lon), F.cos(lon), zero),
        "north": (-F.sin(lat) * F.cos(lon), -F.sin(lat) * F.sin(lon), F.cos(lat)),
        "up": (F.cos(lat) * F.cos(lon), F.cos(lat) * F.sin(lon), F.sin(lat)),
    }


def clipped_asin_deg(x: Column) -> Column:
    return F.degrees(F.asin(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), x))))


def cap_half_angle_deg(altitude_km: float, mask_deg: float) -> float:
    """Half angle of the ground cap that sees a satellite above the mask."""
    mask = math.radians(mask_deg)
    return 90 - mask_deg - math.degrees(math.asin(RE / (RE + altitude_km) * math.cos(mask)))


def cap_half_angle_of(radius_km: Column, mask_deg: float) -> Column:
    """The same for a column of distances from the Earth's centre."""
    return F.lit(90.0 - mask_deg) - F.degrees(F.asin(F.least(F.lit(1.0), F.lit(RE * math.cos(math.radians(mask_deg))) / radius_km)))


def bisection_steps(span_s: float, tolerance_s: float) -> int:
    """Halvings that bring a bracket of ``span_s`` within the tolerance."""
    return max(1, math.ceil(math.log2(max(span_s / tolerance_s, 1.0))))


def refine(low: Column, high: Column, value, threshold: Column, span_s: float, tolerance_s: float) -> Column:
    """The crossing within the tolerance; an error where there is no sign change."""
    found = bisect(low, high, value, threshold, bisection_steps(span_s, tolerance_s))
    return F.when(found.isNotNull(), found).otherwise(F.raise_error(F.lit("no crossing between the ends")).cast("double"))


def bisect(low: Column, high: Column, value, threshold: Column, steps: int) -> Column:
    """The crossing of ``value`` (a function of a column) by halving ``steps``
    times; null where the ends do not differ in sign."""
    above = lambda t: value(t) >= threshold
    start = F.struct(low.alias("low"), high.alias("high"))
    end = F.aggregate(
        F.sequence(F.lit(1), F.lit(steps)),
        start,
        lambda s, _: F.when(
            above((s["low"] + s["high"]) / 2) == above(low),
            F.struct(((s["low"] + s["high"]) / 2).alias("low"), s["high"].alias("high")),
        ).otherwise(F.struct(s["low"].alias("low"), ((s["low"] + s["high"]) / 2).alias("high"))),
    )
    return F.when(above(low) != above(high), (end["low"] + end["high"]) / 2)
