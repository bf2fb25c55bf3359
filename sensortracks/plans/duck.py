"""SQL text for DuckDB oracles: the same formulas written a second time."""

from __future__ import annotations

import math

from sensortracks.functions import geo
from sensortracks.sources.testdata import ORIGIN, duck_detections_cte


def lit(x: float) -> str:
    return f"({float(x)!r})::DOUBLE"


def origin_terms(origin=ORIGIN):
    x0, y0, z0 = geo._ecef_py(*origin)
    la, lo = math.radians(origin[0]), math.radians(origin[1])
    return [lit(v) for v in (x0, y0, z0, math.sin(la), math.cos(la), math.sin(lo), math.cos(lo))]


def ecef(lat: str, lon: str, alt: str) -> tuple[str, str, str]:
    la, lo, al = f"radians({lat})", f"radians({lon})", f"coalesce({alt}, 0.0::DOUBLE)"
    s = f"sin({la})"
    radius = f"({lit(geo.WGS84_A)} / sqrt(1.0::DOUBLE - {lit(geo.WGS84_E2)} * {s} * {s}))"
    return (f"(({radius} + {al}) * cos({la}) * cos({lo}))",
            f"(({radius} + {al}) * cos({la}) * sin({lo}))",
            f"(({radius} * {lit(1 - geo.WGS84_E2)} + {al}) * {s})")


def enu(lat: str, lon: str, alt: str, origin=ORIGIN) -> tuple[str, str, str]:
    x0, y0, z0, slat, clat, slon, clon = origin_terms(origin)
    x, y, z = ecef(lat, lon, alt)
    dx, dy, dz = f"({x} - {x0})", f"({y} - {y0})", f"({z} - {z0})"
    return (f"(-{slon} * {dx} + {clon} * {dy})",
            f"(-{slat} * {clon} * {dx} - {slat} * {slon} * {dy} + {clat} * {dz})",
            f"({clat} * {clon} * {dx} + {clat} * {slon} * {dy} + {slat} * {dz})")


def geodetic(e: str, n: str, u: str, origin=ORIGIN) -> tuple[str, str, str]:
    x0, y0, z0, slat, clat, slon, clon = origin_terms(origin)
    x = f"({x0} - {slon} * {e} - {slat} * {clon} * {n} + {clat} * {clon} * {u})"
    y = f"({y0} + {clon} * {e} - {slat} * {slon} * {n} + {clat} * {slon} * {u})"
    z = f"({z0} + {clat} * {n} + {slat} * {u})"
    h = f"sqrt({x} * {x} + {y} * {y})"
    th = f"atan2({z} * {lit(geo.WGS84_A)}, {h} * {lit(geo.WGS84_B)})"
    lat = (f"atan2({z} + {lit(geo.WGS84_EP2 * geo.WGS84_B)} * sin({th}) * sin({th}) * sin({th}), "
           f"{h} - {lit(geo.WGS84_E2 * geo.WGS84_A)} * cos({th}) * cos({th}) * cos({th}))")
    radius = f"({lit(geo.WGS84_A)} / sqrt(1.0::DOUBLE - {lit(geo.WGS84_E2)} * sin({lat}) * sin({lat})))"
    return (f"degrees({lat})", f"degrees(atan2({y}, {x}))", f"({h} / cos({lat}) - {radius})")


def with_det(body: str, extra_ctes: str = "") -> str:
    ctes = duck_detections_cte("det")
    if extra_ctes:
        ctes += ",\n" + extra_ctes
    return f"WITH {ctes}\n{body}"


def tick_us(ts: str, step_us: int) -> str:
    """Window end in epoch micros (floor also before 1970)."""
    return f"((epoch_us({ts}) - ((epoch_us({ts}) % {step_us}) + {step_us}) % {step_us}) + {step_us})"


def attr_entries() -> str:
    """Sorted attribute entries of a mapped event row, as a DuckDB list of structs."""
    return ("CASE WHEN icao24 IS NOT NULL THEN [{'key': 'icao24', 'value': icao24}, "
            "{'key': 'k', 'value': attr_k}] ELSE [{'key': 'k', 'value': attr_k}] END")


CANONICAL_DESC = ("observed_at DESC, source_type DESC, source_id DESC, lat_deg DESC, lon_deg DESC, "
                  "alt_m DESC NULLS LAST, speed_mps DESC NULLS LAST, heading_deg DESC NULLS LAST, "
                  "sigma_m DESC, received_at DESC, attr_entries DESC")
CANONICAL_ASC = ("observed_at, source_type, source_id, lat_deg, lon_deg, alt_m NULLS FIRST, "
                 "speed_mps NULLS FIRST, heading_deg NULLS FIRST, sigma_m, received_at, attr_entries")


def rnd(expr: str, digits: int = 3) -> str:
    return f"(round({expr}, {digits}) + 0.0)"
