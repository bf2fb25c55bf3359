"""Aircraft (A2) and ship (A3) position feeds: raw JSON text -> detections.

JSON is parsed once into Spark's VARIANT type (``try_parse_json``); every field
is read with ``try_variant_get`` and typed with ``schema_of_variant``, so a
numeric string is not taken for a number, exactly as the feeds require.
Unparseable documents become rejected rows instead of failing the job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensortracks.schema import ADSB, AIS, AIS_SPEED_UNKNOWN_KNOTS, KNOTS_TO_MPS

_NUMERIC = r"^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL.*)$"
_INTEGRAL = r"^(TINYINT|SMALLINT|INT|BIGINT|DECIMAL\(\d+,0\))$"


def vtype(v: Column) -> Column:
    return F.schema_of_variant(v)


def is_number(v: Column) -> Column:
    return v.isNotNull() & vtype(v).rlike(_NUMERIC)


def number(v: Column) -> Column:
    """The value as a double when it is a JSON number, else null."""
    return F.when(is_number(v), F.try_variant_get(v, "$", "double"))


def java_trim(c: Column) -> Column:
    """Trim like Java ``String.trim``: every char <= U+0020 at both ends."""
    return F.regexp_replace(c, r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def text(v: Column) -> Column:
    """Trimmed text of a non-null JSON value (numbers as their text), null when empty."""
    raw = F.when(v.isNotNull() & (vtype(v) != "VOID"), F.try_variant_get(v, "$", "string"))
    t = java_trim(raw)
    return F.when(t != "", t)


def attributes(*pairs: tuple[str, Column]) -> Column:
    entries = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in pairs])
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))


def _el(state: Column, i: int) -> Column:
    return F.try_variant_get(state, f"$[{i}]", "variant")


def read_adsb_states(raw: DataFrame, source_id: str, sigma_m: float, payload: str = "payload",
                     received: str = "received_at") -> tuple[DataFrame, DataFrame]:
    """A2: explode ``states`` rows of aircraft state-vector documents.

    Returns (detections, rejected documents).  A state is skipped when it is not
    an array, has fewer than 14 items or lacks numeric in-range lon [5] / lat [6].
    time = [3] else [4] (whole seconds) else receivedAt; alt = [13] else [7];
    speed [9] null when negative; heading [10] null outside [0, 360], 360 -> 0;
    icao24 / callsign / originCountry trimmed, omitted when empty.  Other input
    columns are carried along.
    """
    extra = [c for c in raw.columns if c not in (payload,)]
    parsed = raw.withColumn("_v", F.try_parse_json(F.col(payload)))
    rejected = parsed.filter(F.col("_v").isNull()).drop("_v").withColumn(
        "reason", F.lit("invalid aircraft JSON"))
    states = F.try_variant_get(F.col("_v"), "$.states", "array<variant>")
    rows = (parsed.filter(F.col("_v").isNotNull())
            .select(*extra, F.posexplode(F.coalesce(states, F.array().cast("array<variant>")))
                    .alias("state_index", "_s")))
    s = F.col("_s")
    size = F.size(F.try_variant_get(s, "$", "array<variant>"))
    lon, lat = number(_el(s, 5)), number(_el(s, 6))
    keep = (vtype(s).startswith("ARRAY") & (size >= 14) & lon.between(-180, 180) & lat.between(-90, 90))

    def seconds(v):
        return F.when(is_number(v), F.timestamp_seconds(F.try_variant_get(v, "$", "double").cast("long")))

    heading = number(_el(s, 10))
    speed = number(_el(s, 9))
    out = rows.filter(keep).select(
        *[c for c in extra if c != received], "state_index",
        F.lit(source_id).alias("source_id"), F.lit(ADSB).alias("source_type"),
        F.coalesce(seconds(_el(s, 3)), seconds(_el(s, 4)), F.col(received)).alias("observed_at"),
        F.col(received).alias("received_at"),
        lat.alias("lat_deg"), lon.alias("lon_deg"),
        F.coalesce(number(_el(s, 13)), number(_el(s, 7))).alias("alt_m"),
        F.when(speed >= 0, speed).alias("speed_mps"),
        F.when((heading >= 0) & (heading <= 360), F.when(heading == 360, F.lit(0.0)).otherwise(heading))
        .alias("heading_deg"),
        F.lit(float(sigma_m)).alias("sigma_m"),
        attributes(("icao24", text(_el(s, 0))), ("callsign", text(_el(s, 1))),
                   ("originCountry", text(_el(s, 2)))).alias("attributes"))
    return out, rejected


def read_ais_reports(raw: DataFrame, source_id: str, sigma_m: float, payload: str = "payload",
                     received: str = "received_at") -> tuple[DataFrame, DataFrame]:
    """A3: ship position reports (one JSON message per row) -> detections.

    Only ``MessageType = PositionReport``; metadata under ``MetaData`` or
    ``Metadata``; lat/lon from the report else the metadata, out-of-range
    (sentinels 91 / 181) dropped; mmsi from MMSI else UserID; time from an ISO
    ``time_utc`` else receivedAt; speed = Sog knots in [0, 102.3) -> m/s;
    heading = TrueHeading else Cog, only in [0, 360); no altitude.
    """
    extra = [c for c in raw.columns if c not in (payload,)]
    v = F.try_parse_json(F.col(payload))
    parsed = raw.withColumn("_v", v)
    rejected = parsed.filter(F.col("_v").isNull()).drop("_v").withColumn("reason", F.lit("invalid ship JSON"))
    g = lambda path: F.try_variant_get(F.col("_v"), path, "variant")
    has_upper = g("$.MetaData").isNotNull()
    meta = lambda name: F.when(has_upper, g(f"$.MetaData.{name}")).otherwise(g(f"$.Metadata.{name}"))
    pos = lambda name: g(f"$.Message.PositionReport.{name}")
    lat = F.coalesce(number(pos("Latitude")), number(meta("Latitude")))
    lon = F.coalesce(number(pos("Longitude")), number(meta("Longitude")))
    msg_type = F.when(g("$.MessageType").isNotNull(), F.try_variant_get(F.col("_v"), "$.MessageType", "string"))
    sog = number(pos("Sog"))

    def heading(x):
        return F.when((x >= 0) & (x < 360), x)

    time_utc = F.when(vtype(meta("time_utc")) == "STRING", F.try_variant_get(meta("time_utc"), "$", "string"))
    iso = F.try_to_timestamp(time_utc, F.lit("yyyy-MM-dd'T'HH:mm:ss[.SSSSSSSSS]XXX"))
    out = (parsed.filter(F.col("_v").isNotNull() & (msg_type == "PositionReport")
                         & lat.between(-90, 90) & lon.between(-180, 180))
           .select(*[c for c in extra if c != received],
                   F.lit(source_id).alias("source_id"), F.lit(AIS).alias("source_type"),
                   F.coalesce(iso, F.col(received)).alias("observed_at"), F.col(received).alias("received_at"),
                   lat.alias("lat_deg"), lon.alias("lon_deg"), F.lit(None).cast("double").alias("alt_m"),
                   F.when((sog >= 0) & (sog < AIS_SPEED_UNKNOWN_KNOTS), sog * F.lit(KNOTS_TO_MPS)).alias("speed_mps"),
                   F.coalesce(heading(number(pos("TrueHeading"))), heading(number(pos("Cog")))).alias("heading_deg"),
                   F.lit(float(sigma_m)).alias("sigma_m"),
                   attributes(("mmsi", F.coalesce(text(meta("MMSI")), text(pos("UserID")))),
                              ("shipName", text(meta("ShipName")))).alias("attributes")))
    return out, rejected
