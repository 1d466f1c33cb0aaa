"""Distances on a sphere and the national-grid projection."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

EARTH_RADIUS_KM = 6371.0


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in kilometres."""
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    a = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def chord_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Straight-line distance through the sphere, monotone in the great circle."""
    def axes(lat: Column, lon: Column) -> tuple[Column, Column, Column]:
        phi, lam = F.radians(lat), F.radians(lon)
        return F.cos(phi) * F.cos(lam), F.cos(phi) * F.sin(lam), F.sin(phi)

    squares = [(p - q) * (p - q) for p, q in zip(axes(lat1, lon1), axes(lat2, lon2))]
    return F.lit(EARTH_RADIUS_KM) * F.sqrt(squares[0] + squares[1] + squares[2])


def latitude_reach(radius_km: float) -> float:
    """Degrees of latitude that ``radius_km`` spans."""
    return math.degrees(radius_km / EARTH_RADIUS_KM)


def longitude_reach(lat: Column, radius_km: Column) -> Column:
    """Largest longitude difference of any point within ``radius_km`` of ``lat``.

    180 when the circle holds a pole.
    """
    angle = radius_km / F.lit(EARTH_RADIUS_KM)
    ratio = F.sin(angle) / F.cos(F.radians(lat))
    holds_pole = (ratio >= 1.0) | (angle >= math.pi / 2)
    return F.when(holds_pole, F.lit(180.0)).otherwise(F.degrees(F.asin(F.least(ratio, F.lit(1.0)))))


# Airy 1830 and GRS80 ellipsoids, national grid projection and the
# published seven-parameter datum shift.
AIRY_A, AIRY_B = 6377563.396, 6356256.909
GRS80_A, GRS80_B = 6378137.0, 6356752.3141
GRID_SCALE, GRID_E0, GRID_N0 = 0.9996012717, 400000.0, -100000.0
GRID_LAT0, GRID_LON0 = math.radians(49.0), math.radians(-2.0)
SHIFT_M = (446.448, -125.157, 542.060)
SHIFT_PPM = -20.4894e-6
SHIFT_ROTATION = tuple(math.radians(s / 3600.0) for s in (0.1502, 0.2470, 0.8421))
GRID_MAX_EASTING, GRID_MAX_NORTHING = 700000.0, 1300000.0
_NORTHING_STEPS = 12
_LATITUDE_STEPS = 10


def _repeat(steps: int, start: Column, step) -> Column:
    """``step`` applied ``steps`` times."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, lambda x, _: step(x))


def _meridian_arc(phi: Column) -> Column:
    n = (AIRY_A - AIRY_B) / (AIRY_A + AIRY_B)
    series = (
        1 + n + 1.25 * n**2 + 1.25 * n**3,
        3 * n + 3 * n**2 + 2.625 * n**3,
        1.875 * (n**2 + n**3),
        35.0 / 24.0 * n**3,
    )
    diff, total = phi - GRID_LAT0, phi + GRID_LAT0
    arc = series[0] * diff
    for k, sign in ((1, -1.0), (2, 1.0), (3, -1.0)):
        arc = arc + sign * series[k] * F.sin(k * diff) * F.cos(k * total)
    return AIRY_B * GRID_SCALE * arc


def _squared_eccentricity(a: float, b: float) -> float:
    return 1 - (b / a) ** 2


def _airy_angles(easting: Column, phi: Column, nu: Column, rho: Column) -> tuple[Column, Column]:
    """Latitude and longitude on the Airy ellipsoid from the foot point latitude ``phi``."""
    tan, d = F.tan(phi), (easting - GRID_E0) / nu
    t2, eta2 = tan * tan, nu / rho - 1

    def power(k: int) -> Column:
        return F.pow(d, F.lit(float(k)))

    lat = phi - tan * nu / rho * (
        power(2) / 2
        - power(4) / 24 * (5 + 3 * t2 + eta2 - 9 * t2 * eta2)
        + power(6) / 720 * (61 + 90 * t2 + 45 * t2 * t2)
    )
    lon = GRID_LON0 + 1 / F.cos(phi) * (
        d
        - power(3) / 6 * (nu / rho + 2 * t2)
        + power(5) / 120 * (5 + 28 * t2 + 24 * t2 * t2)
        - power(7) / 5040 * (61 + 662 * t2 + 1320 * t2 * t2 + 720 * t2 * t2 * t2)
    )
    return lat, lon


def reproject(df: DataFrame, easting: str = "easting", northing: str = "northing") -> DataFrame:
    """Add ``lat`` and ``lon`` (degrees, six places) from grid columns and drop the rows off the grid.

    Column expressions throughout: iterations run a fixed number of steps inside an
    expression, and every stage is a projection that the next one reads several times.
    """
    east, north = F.col(easting).cast("double"), F.col(northing).cast("double")
    inside = (east >= 0) & (east <= GRID_MAX_EASTING) & (north >= 0) & (north <= GRID_MAX_NORTHING)
    rows = df.where(inside).withColumn("_grid_phi", _repeat(
        _NORTHING_STEPS, F.lit(GRID_LAT0), lambda phi: phi + (north - GRID_N0 - _meridian_arc(phi)) / (AIRY_A * GRID_SCALE)))

    airy = _squared_eccentricity(AIRY_A, AIRY_B)
    curve = 1 - airy * F.pow(F.sin("_grid_phi"), F.lit(2.0))
    rows = rows.withColumns({"_grid_nu": AIRY_A * GRID_SCALE / F.sqrt(curve), "_grid_rho": AIRY_A * GRID_SCALE * (1 - airy) / (curve * F.sqrt(curve))})
    lat, lon = _airy_angles(east, F.col("_grid_phi"), F.col("_grid_nu"), F.col("_grid_rho"))
    rows = rows.withColumns({"_grid_lat": lat, "_grid_lon": lon})

    lat, lon = F.col("_grid_lat"), F.col("_grid_lon")
    nu = AIRY_A / F.sqrt(1 - airy * F.pow(F.sin(lat), F.lit(2.0)))
    rows = rows.withColumns({"_grid_x": nu * F.cos(lat) * F.cos(lon), "_grid_y": nu * F.cos(lat) * F.sin(lon), "_grid_z": nu * (1 - airy) * F.sin(lat)})

    x, y, z = (F.col(f"_grid_{axis}") for axis in "xyz")
    rx, ry, rz = SHIFT_ROTATION
    scale = 1 + SHIFT_PPM
    rows = rows.withColumns({
        "_grid_x": SHIFT_M[0] + scale * x - rz * y + ry * z,
        "_grid_y": SHIFT_M[1] + rz * x + scale * y - rx * z,
        "_grid_z": SHIFT_M[2] - ry * x + rx * y + scale * z,
    })

    wgs = _squared_eccentricity(GRS80_A, GRS80_B)
    flat = F.hypot(x, y)
    phi = _repeat(_LATITUDE_STEPS, F.atan2(z, flat * (1 - wgs)), lambda p: F.atan2(
        z + wgs * GRS80_A / F.sqrt(1 - wgs * F.pow(F.sin(p), F.lit(2.0))) * F.sin(p), flat))
    placed = rows.withColumns({"lat": F.bround(F.degrees(phi), 6), "lon": F.bround(F.degrees(F.atan2(y, x)), 6)})
    return placed.drop(*[f"_grid_{c}" for c in ("phi", "nu", "rho", "lat", "lon", "x", "y", "z")])
