"""Fixture builders shared by the tests (detections placed by east metres)."""

from __future__ import annotations

import datetime as dt

import pandas as pd

from sensortracks.functions.geo import WGS84_A
from sensortracks.operators.tracker_core import RegionTracker
from sensortracks.schema import FusionConfig
from sensortracks.streaming.stateful import tick_measurements

START = dt.datetime(2026, 1, 2, 3, 4, 5, tzinfo=dt.timezone.utc)
START_US = int(START.timestamp() * 1_000_000)


def det(source_id, source_type, t_us, east, speed=1.0, heading=90.0, sigma=5.0, attrs=None):
    attrs = attrs or {}
    key = "\u0000".join(f"{k}\u0001{v}" for k, v in sorted(attrs.items()))
    ident = None
    for k in ("groundTruth", "groundTruthId", "icao24", "mmsi"):
        if attrs.get(k, "").strip():
            ident = f"{k}={attrs[k]}"
            break
    known = speed is not None and heading is not None
    import math
    return {"identity": ident, "source_id": source_id, "source_type": source_type, "observed_us": t_us,
            "received_us": t_us + 20_000, "lat_deg": 0.0, "lon_deg": east / WGS84_A, "alt_m": 0.0,
            "speed_mps": speed, "heading_deg": heading, "sigma_m": sigma, "attributes": attrs, "attr_key": key,
            "e": float(east), "n": 0.0,
            "ve0": speed * math.sin(math.radians(heading)) if known else 0.0,
            "vn0": speed * math.cos(math.radians(heading)) if known else 0.0}


def step(tracker: RegionTracker, tick_us: int, dets: list[dict]):
    sources = tick_measurements(pd.DataFrame(dets)) if dets else []
    snap, contrib, _ = tracker.step(tick_us, sources)
    return [{"local_id": int(snap["local_id"][i]), "status": ["TENTATIVE", "CONFIRMED", "COASTING", "DROPPED"][
        int(snap["status"][i])], "hits": int(snap["hits"][i]), "misses": int(snap["misses"][i]),
        "e": float(snap["e"][i]), "last_obs_us": int(snap["last_obs_us"][i]),
        "contributors": [rec for _, rec in contrib[i]]} for i in range(len(snap["local_id"]))]


def cfg(h, w, d, gate=9.21, accel=1.0):
    return FusionConfig(h, w, d, gate, accel)
