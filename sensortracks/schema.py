"""Schemas, statuses and fixed values shared by all operators."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

DETECTION_FIELDS = [
    T.StructField("source_id", T.StringType(), False),
    T.StructField("source_type", T.StringType(), False),
    T.StructField("observed_at", T.TimestampType(), False),
    T.StructField("received_at", T.TimestampType(), False),
    T.StructField("lat_deg", T.DoubleType(), False),
    T.StructField("lon_deg", T.DoubleType(), False),
    T.StructField("alt_m", T.DoubleType(), True),
    T.StructField("speed_mps", T.DoubleType(), True),
    T.StructField("heading_deg", T.DoubleType(), True),
    T.StructField("sigma_m", T.DoubleType(), False),
    T.StructField("attributes", T.MapType(T.StringType(), T.StringType(), False), False),
]
DETECTION_SCHEMA = T.StructType(DETECTION_FIELDS)
DETECTION_COLUMNS = [f.name for f in DETECTION_FIELDS]

# Same fields, all nullable: the shape of raw rows before validation.
RAW_DETECTION_SCHEMA = T.StructType(
    [T.StructField(f.name, f.dataType, True) for f in DETECTION_FIELDS]
)

TRACK_HISTORY_FIELDS = [
    T.StructField("session_id", T.StringType(), True),
    T.StructField("track_id", T.LongType(), False),
    T.StructField("status", T.StringType(), False),
    T.StructField("state_at", T.TimestampType(), False),
    T.StructField("last_observed_at", T.TimestampType(), False),
    T.StructField("lat_deg", T.DoubleType(), False),
    T.StructField("lon_deg", T.DoubleType(), False),
    T.StructField("alt_m", T.DoubleType(), True),
    T.StructField("ve_mps", T.DoubleType(), False),
    T.StructField("vn_mps", T.DoubleType(), False),
    T.StructField("hit_count", T.IntegerType(), False),
    T.StructField("consecutive_misses", T.IntegerType(), False),
    T.StructField("contributors", T.ArrayType(DETECTION_SCHEMA), False),
]

# --- fixed values (must equal the reference's for equal results) ---------
# Track statuses.
TENTATIVE, CONFIRMED, COASTING, DROPPED = "TENTATIVE", "CONFIRMED", "COASTING", "DROPPED"
# Attribute keys that name the object inside a source, in priority order.
IDENTITY_KEYS = ("groundTruth", "groundTruthId", "icao24", "mmsi")
# Source types produced by the feeds.
ADSB, AIS, RADAR, WEATHER = "ADSB", "AIS", "RADAR", "WEATHER"
# Initial velocity variance of a new track, (m/s)^2.
INITIAL_VELOCITY_VARIANCE = 400.0
# Smallest allowed variance after an update.
MIN_VARIANCE = 1e-9
# Knots to metres per second.
KNOTS_TO_MPS = 0.514444
# AIS "speed not available" threshold, knots (values >= are unknown).
AIS_SPEED_UNKNOWN_KNOTS = 102.3
# Radar frame header: magic number and version.
RADAR_MAGIC = 0x54465231
RADAR_VERSION = 1
# Replay CSV header and its fixed source.
REPLAY_CSV_HEADER = "observedAt,latDeg,lonDeg,altMeters,speedMps,headingDeg,icao24"
REPLAY_SOURCE_ID, REPLAY_SIGMA_M = "opensky-replay", 10.0
# A source is shown degraded after this long without a message.
SILENT_AFTER_SECONDS = 30


@dataclass(frozen=True)
class FusionConfig:
    """Tracker parameters: m-of-n confirmation, drop after misses, gate, noise."""

    confirmation_hits: int = 3
    confirmation_window: int = 5
    drop_after_misses: int = 5
    gate: float = 9.21
    accel_sigma: float = 2.0

    def __post_init__(self):
        if self.confirmation_hits < 1 or self.confirmation_window < self.confirmation_hits:
            raise ValueError("invalid confirmation window")
        if self.drop_after_misses < 1 or not (self.gate > 0) or not (self.accel_sigma > 0):
            raise ValueError("invalid fusion configuration")

    @property
    def horizon(self) -> int:
        """Empty ticks after which any unhit track is certainly dropped."""
        return max(self.drop_after_misses, self.confirmation_window)
