"""WGS84 geodetic <-> local East/North/Up, velocity and grid columns.

Everything here is a native ``Column`` expression, so it stays inside
whole-stage codegen and needs no Python worker.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: WGS84 ellipsoid -----------------------------------------
WGS84_A = 6378137.0
WGS84_F = 1.0 / 298.257223563
WGS84_B = WGS84_A * (1 - WGS84_F)
WGS84_E2 = WGS84_F * (2 - WGS84_F)
WGS84_EP2 = (WGS84_A * WGS84_A - WGS84_B * WGS84_B) / (WGS84_B * WGS84_B)
# Distance from the polar axis below which longitude is taken as 0.
POLAR_AXIS_EPS_M = 1e-9

Origin = Sequence[float] | Sequence[Column]


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def ecef(lat_deg, lon_deg, alt_m):
    """Earth-centred coordinates (x, y, z) of geodetic columns; null alt is 0."""
    lat = F.radians(_c(lat_deg))
    lon = F.radians(_c(lon_deg))
    alt = F.coalesce(_c(alt_m), F.lit(0.0))
    s = F.sin(lat)
    radius = F.lit(WGS84_A) / F.sqrt(F.lit(1.0) - F.lit(WGS84_E2) * s * s)
    x = (radius + alt) * F.cos(lat) * F.cos(lon)
    y = (radius + alt) * F.cos(lat) * F.sin(lon)
    z = (radius * F.lit(1 - WGS84_E2) + alt) * s
    return x, y, z


def _ecef_py(lat_deg: float, lon_deg: float, alt_m: float):
    lat, lon = math.radians(lat_deg), math.radians(lon_deg)
    s = math.sin(lat)
    radius = WGS84_A / math.sqrt(1 - WGS84_E2 * s * s)
    return ((radius + alt_m) * math.cos(lat) * math.cos(lon),
            (radius + alt_m) * math.cos(lat) * math.sin(lon),
            (radius * (1 - WGS84_E2) + alt_m) * s)


def _origin_terms(origin: Origin):
    """(x0, y0, z0, sin_lat, cos_lat, sin_lon, cos_lon) for a literal or per-row origin."""
    lat0, lon0, alt0 = origin
    if all(not isinstance(v, Column) for v in origin):
        for v, lo, hi in ((lat0, -90, 90), (lon0, -180, 180)):
            if not (math.isfinite(v) and lo <= v <= hi):
                raise ValueError("invalid origin")
        x0, y0, z0 = _ecef_py(lat0, lon0, alt0 or 0.0)
        la, lo_ = math.radians(lat0), math.radians(lon0)
        return tuple(F.lit(v) for v in (x0, y0, z0, math.sin(la), math.cos(la),
                                         math.sin(lo_), math.cos(lo_)))
    x0, y0, z0 = ecef(lat0, lon0, alt0)
    la, lo_ = F.radians(_c(lat0)), F.radians(_c(lon0))
    return x0, y0, z0, F.sin(la), F.cos(la), F.sin(lo_), F.cos(lo_)


def to_enu(lat_deg, lon_deg, alt_m, origin: Origin) -> Column:
    """B1: struct<east_m, north_m, up_m> of a point relative to ``origin``."""
    x0, y0, z0, slat, clat, slon, clon = _origin_terms(origin)
    x, y, z = ecef(lat_deg, lon_deg, alt_m)
    dx, dy, dz = x - x0, y - y0, z - z0
    return F.struct(
        (-slon * dx + clon * dy).alias("east_m"),
        (-slat * clon * dx - slat * slon * dy + clat * dz).alias("north_m"),
        (clat * clon * dx + clat * slon * dy + slat * dz).alias("up_m"),
    )


def to_geodetic(east_m, north_m, up_m, origin: Origin) -> Column:
    """B2: struct<lat_deg, lon_deg, alt_m> of a local ENU point (closed form)."""
    x0, y0, z0, slat, clat, slon, clon = _origin_terms(origin)
    e, n, u = _c(east_m), _c(north_m), _c(up_m)
    x = x0 - slon * e - slat * clon * n + clat * clon * u
    y = y0 + clon * e - slat * slon * n + clat * slon * u
    z = z0 + clat * n + slat * u
    horizontal = F.hypot(x, y)
    theta = F.atan2(z * F.lit(WGS84_A), horizontal * F.lit(WGS84_B))
    st, ct = F.sin(theta), F.cos(theta)
    lat = F.atan2(z + F.lit(WGS84_EP2 * WGS84_B) * st * st * st,
                  horizontal - F.lit(WGS84_E2 * WGS84_A) * ct * ct * ct)
    sl = F.sin(lat)
    radius = F.lit(WGS84_A) / F.sqrt(F.lit(1.0) - F.lit(WGS84_E2) * sl * sl)
    polar = horizontal < F.lit(POLAR_AXIS_EPS_M)
    return F.struct(
        F.when(polar, F.when(z < 0, F.lit(-90.0)).otherwise(F.lit(90.0)))
        .otherwise(F.degrees(lat)).alias("lat_deg"),
        F.when(polar, F.lit(0.0)).otherwise(F.degrees(F.atan2(y, x))).alias("lon_deg"),
        F.when(polar, F.abs(z) - F.lit(WGS84_B))
        .otherwise(horizontal / F.cos(lat) - radius).alias("alt_m"),
    )


def velocity_components(speed_mps, heading_deg) -> Column:
    """struct<ve_mps, vn_mps>; both zero unless speed and heading are known."""
    s, h = _c(speed_mps), _c(heading_deg)
    known = s.isNotNull() & h.isNotNull()
    rad = F.radians(h)
    return F.struct(
        F.when(known, s * F.sin(rad)).otherwise(F.lit(0.0)).alias("ve_mps"),
        F.when(known, s * F.cos(rad)).otherwise(F.lit(0.0)).alias("vn_mps"),
    )


def ground_speed(ve_mps, vn_mps) -> Column:
    """Horizontal speed of a track."""
    return F.hypot(_c(ve_mps), _c(vn_mps))


def grid_index(value_deg, grid_deg: float) -> Column:
    """Cell index of one coordinate: value / grid rounded half-up, in decimal."""
    if not (math.isfinite(grid_deg) and 0 < grid_deg <= 1):
        raise ValueError("grid_deg must be in (0, 1]")
    dec = "decimal(24,15)"
    q = _c(value_deg).cast(dec) / F.lit(str(grid_deg)).cast(dec)
    return F.round(q, 0).cast("long")


def grid_cell(lat_deg, lon_deg, grid_deg: float) -> Column:
    """struct<cell_lat, cell_lon> (integer indexes) of a grid of ``grid_deg``."""
    return F.struct(grid_index(lat_deg, grid_deg).alias("cell_lat"),
                    grid_index(lon_deg, grid_deg).alias("cell_lon"))
