"""The driver's synthetic ``events`` table seen as sensor detections.

One formula set, written twice: as DataFrame code for Spark and as SQL text for
DuckDB, so every registered query can be checked against an oracle.

  source_type = event_type, source_id = event_type || '-feed'
  observed_at = ts, received_at = ts + 20 ms * (event_id % 7)
  lat = 43.65 + (user_id % 15 - 7) * 0.02 + (value % 10 - 5) * 0.0001
  lon = -79.38 + (user_id % 10 - 5) * 0.03 + (value % 7 - 3) * 0.0001
  alt = null when user_id % 4 = 0 else 1000 + user_id
  speed = value % 60, heading = event_id % 360 (null when event_id % 5 = 0)
  sigma = 10 + 10 * (user_id % 5)
  attributes = {icao24: user_id (absent when user_id % 11 = 0), k: props.k}
  delivery: topic 'events', partition event_id % 4, offset event_id // 4,
            rows with event_id % 17 = 0 delivered twice, the copy 250 ms later
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensortracks.schema import DETECTION_COLUMNS
from sensortracks.session import configure

ORIGIN = (43.65, -79.38, 0.0)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def events_as_detections(spark: SparkSession, sf_dir: str,
                         keep_event_columns: bool = False) -> DataFrame:
    configure(spark)
    ev = read_table(spark, sf_dir, "events")
    uid, eid, val = F.col("user_id"), F.col("event_id"), F.col("value")
    observed = F.col("ts").cast("timestamp")
    icao = F.when(uid % 11 != 0, uid.cast("string"))
    k = F.get_json_object("props", "$.k")
    attrs = F.when(icao.isNull(), F.create_map(F.lit("k"), k)).otherwise(
        F.create_map(F.lit("icao24"), icao, F.lit("k"), k))
    out = ev.select(
        eid.alias("event_id"),
        uid.alias("user_id"),
        F.concat(F.col("event_type"), F.lit("-feed")).alias("source_id"),
        F.col("event_type").alias("source_type"),
        observed.alias("observed_at"),
        F.timestamp_micros(F.unix_micros(observed) + (eid % 7) * 20000).alias("received_at"),
        (F.lit(43.65) + ((uid % 15) - 7).cast("double") * F.lit(0.02)
         + ((val % 10) - 5) * F.lit(0.0001)).alias("lat_deg"),
        (F.lit(-79.38) + ((uid % 10) - 5).cast("double") * F.lit(0.03)
         + ((val % 7) - 3) * F.lit(0.0001)).alias("lon_deg"),
        F.when(uid % 4 != 0, (uid + 1000).cast("double")).alias("alt_m"),
        (val % 60).alias("speed_mps"),
        F.when(eid % 5 != 0, (eid % 360).cast("double")).alias("heading_deg"),
        (F.lit(10.0) + (uid % 5).cast("double") * 10).alias("sigma_m"),
        attrs.alias("attributes"),
        F.lit("events").alias("topic"),
        (eid % 4).cast("int").alias("partition"),
        F.floor(eid / 4).cast("long").alias("offset"),
        F.col("event_type"),
        val.alias("value"),
    )
    if keep_event_columns:
        return out
    return out.select("event_id", *DETECTION_COLUMNS)


def events_as_deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delivered records: every detection once, every 17th twice (250 ms later)."""
    d = events_as_detections(spark, sf_dir, keep_event_columns=True)
    late = F.when(F.col("event_id") % 17 == 0, F.array(F.lit(5000), F.lit(255000))).otherwise(F.array(F.lit(5000)))
    return d.withColumn("_late", F.explode(late)).withColumn(
        "arrived_at", F.timestamp_micros(F.unix_micros("received_at") + F.col("_late"))).drop("_late")


# --- the same mapping for DuckDB -------------------------------------------
DUCK_DETECTIONS = """
  SELECT event_id, user_id,
         event_type || '-feed' AS source_id,
         event_type AS source_type,
         ts AS observed_at,
         make_timestamp(epoch_us(ts) + (event_id % 7) * 20000) AS received_at,
         43.65::DOUBLE + ((user_id % 15) - 7)::DOUBLE * 0.02::DOUBLE
           + ((value % 10) - 5) * 0.0001::DOUBLE AS lat_deg,
         -79.38::DOUBLE + ((user_id % 10) - 5)::DOUBLE * 0.03::DOUBLE
           + ((value % 7) - 3) * 0.0001::DOUBLE AS lon_deg,
         CASE WHEN user_id % 4 <> 0 THEN (user_id + 1000)::DOUBLE END AS alt_m,
         value % 60 AS speed_mps,
         CASE WHEN event_id % 5 <> 0 THEN (event_id % 360)::DOUBLE END AS heading_deg,
         10.0::DOUBLE + (user_id % 5)::DOUBLE * 10 AS sigma_m,
         CASE WHEN user_id % 11 <> 0 THEN user_id::VARCHAR END AS icao24,
         json_extract_string(props, '$.k') AS attr_k,
         'events' AS topic,
         (event_id % 4) AS "partition",
         (event_id // 4) AS "offset",
         value
  FROM events
"""


def duck_detections_cte(name: str = "det") -> str:
    return f"{name} AS ({DUCK_DETECTIONS})"


FLEET_STEP_US = 1_000_000


def events_as_fleet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections of vehicles that keep to areas of their own, a hundred reports a second.

      user u: an area of 0.5 x 0.75 degrees by (u % 40, u // 40 % 40); report e: second e // 100,
      a quarter into it; place in the area by value, speed value % 5, other fields as above
    """
    configure(spark)
    ev = read_table(spark, sf_dir, "events")
    uid, eid, val = F.col("user_id"), F.col("event_id"), F.col("value")
    observed = F.timestamp_micros(F.floor(eid / 100) * FLEET_STEP_US + 1_700_000_000_250_000)
    return ev.select(
        eid.alias("event_id"), uid.alias("user_id"), F.lit("fleet-feed").alias("source_id"),
        F.lit("fleet").alias("source_type"), observed.alias("observed_at"),
        F.timestamp_micros(F.unix_micros(observed) + (eid % 7) * 20000).alias("received_at"),
        (F.lit(33.65) + (uid % 40).cast("double") * F.lit(0.5) + (val % 10) * F.lit(0.00001)).alias("lat_deg"),
        (F.lit(-94.38) + (F.floor(uid / 40) % 40).cast("double") * F.lit(0.75) + (val % 7) * F.lit(0.00001)).alias("lon_deg"),
        F.lit(None).cast("double").alias("alt_m"), (val % 5).alias("speed_mps"),
        (eid % 360).cast("double").alias("heading_deg"), (F.lit(10.0) + (uid % 5).cast("double") * 10).alias("sigma_m"),
        F.create_map(F.lit("icao24"), uid.cast("string")).alias("attributes")).select("event_id", *DETECTION_COLUMNS)


DUCK_FLEET = """fleet AS (
  SELECT event_id, user_id, 'fleet-feed' AS source_id, 'fleet' AS source_type,
         make_timestamp((event_id // 100) * 1000000 + 1700000000250000) AS observed_at,
         make_timestamp((event_id // 100) * 1000000 + 1700000000250000 + (event_id % 7) * 20000) AS received_at,
         33.65::DOUBLE + (user_id % 40)::DOUBLE * 0.5::DOUBLE + (value % 10) * 0.00001::DOUBLE AS lat_deg,
         -94.38::DOUBLE + ((user_id // 40) % 40)::DOUBLE * 0.75::DOUBLE + (value % 7) * 0.00001::DOUBLE AS lon_deg,
         NULL::DOUBLE AS alt_m, value % 5 AS speed_mps, (event_id % 360)::DOUBLE AS heading_deg,
         10.0::DOUBLE + (user_id % 5)::DOUBLE * 10 AS sigma_m, 0 AS attr_entries
  FROM events)"""


def events_as_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A track-history table derived from events (input of the track-table operators).

    One row per (user, hourly tick) with at least one detection:
    track_id = user_id, contributors = that tick's coalesced detections sorted
    by source, position and velocity of the first contributor, session by
    ten-day block, status from (user_id + hour) % 10.
    """
    from sensortracks.functions import geo
    from sensortracks.functions.order import sort_structs
    from sensortracks.operators.ticks import assign_tick, coalesce_detections

    d = coalesce_detections(assign_tick(events_as_detections(spark, sf_dir, keep_event_columns=True), "1 hour"))
    p = geo.to_enu(F.col("lat_deg"), F.col("lon_deg"), F.col("alt_m"), ORIGIN)
    v = geo.velocity_components(F.col("speed_mps"), F.col("heading_deg"))
    d = d.select("*", p.east_m.alias("e"), p.north_m.alias("n"), v.ve_mps.alias("ve"), v.vn_mps.alias("vn"))
    contributor = F.struct("source_type", "source_id", "observed_at", "received_at", "lat_deg", "lon_deg",
                           "alt_m", "speed_mps", "heading_deg", "sigma_m", "attributes", "event_id")
    g = d.groupBy(F.col("user_id").alias("track_id"), F.col("tick").alias("state_at")).agg(
        F.min(F.struct("source_type", "source_id", "e", "n", "ve", "vn")).alias("_f"),
        F.max("observed_at").alias("last_observed_at"),
        F.count(F.lit(1)).alias("_c"),
        sort_structs(F.collect_list(contributor), "source_type", "source_id").alias("contributors"))
    hour = F.floor(F.unix_micros("state_at") / F.lit(3_600_000_000)).cast("long")
    k = (F.col("track_id") + hour) % 10
    status = (F.when(k <= 5, "CONFIRMED").when(k <= 7, "COASTING").when(k == 8, "TENTATIVE")
              .otherwise("DROPPED"))
    return g.select(
        F.concat(F.lit("s"), F.floor((F.dayofmonth("state_at") - 1) / 10).cast("string")).alias("session_id"),
        "track_id", status.alias("status"), "state_at", "last_observed_at",
        F.col("_f.e").alias("east_m"), F.col("_f.n").alias("north_m"),
        F.col("_f.ve").alias("ve_mps"), F.col("_f.vn").alias("vn_mps"),
        (F.col("_c") + F.col("track_id") % 3).cast("int").alias("hit_count"),
        F.when(k.between(6, 7), hour % 4).otherwise(0).cast("int").alias("consecutive_misses"),
        "contributors")


def events_as_stage_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stage-event log derived from delivered events (input of the health operators)."""
    dl = events_as_deliveries(spark, sf_dir)
    eid, et = F.col("event_id"), F.col("event_type")
    first = F.unix_micros("arrived_at") == F.unix_micros("received_at") + 5000
    none = F.lit(None).cast("timestamp")

    def event(stage, ok, at, received=none, source=None):
        return F.struct(
            (F.lit(source) if source else F.col("source_id")).alias("source_id"),
            (F.lit(source) if source else F.col("source_type")).alias("source_type"),
            F.lit(stage).alias("stage"), ok.alias("ok"), at.alias("at"), received.alias("received_at"))

    def plus(ms):
        return F.timestamp_micros(F.unix_micros("received_at") + ms * 1000)

    yes, arrived = F.lit(True), F.col("arrived_at")
    error = et == "error"
    events = F.array_compact(F.array(
        F.when(first, event("adapter", ~(error & (eid % 3 == 0)), F.col("received_at"))),
        F.when(first, event("publish", ~(error & (eid % 3 == 1)), plus(1))),
        event("consume", yes, arrived, F.col("received_at")),
        F.when(~first, event("redeliver", yes, arrived)),
        F.when(first & (eid % 23 == 0), event("late", yes, plus(600_000))),
        F.when(first & (eid % 5 == 0), event("enrichment", eid % 50 != 0, plus(2), source="WEATHER")),
        F.when(first & error & (eid % 97 == 0), event("circuit", yes, plus(3)))))
    return dl.select(F.explode(events).alias("s")).select("s.*")


DUCK_HISTORY = """
  co1h AS (SELECT * FROM (
        SELECT *, row_number() OVER (PARTITION BY tick_us, source_type, source_id, icao24
                                     ORDER BY {desc}) AS rn
        FROM (SELECT *, {tick} AS tick_us, {entries} AS attr_entries FROM det))
      WHERE icao24 IS NULL OR rn = 1),
  hist AS (
    SELECT 's' || ((day(make_timestamp(tick_us)) - 1) // 10)::VARCHAR AS session_id,
           user_id AS track_id,
           CASE WHEN (user_id + tick_us // 3600000000) % 10 <= 5 THEN 'CONFIRMED'
                WHEN (user_id + tick_us // 3600000000) % 10 <= 7 THEN 'COASTING'
                WHEN (user_id + tick_us // 3600000000) % 10 = 8 THEN 'TENTATIVE' ELSE 'DROPPED' END AS status,
           tick_us AS state_us, max(epoch_us(observed_at)) AS last_observed_us,
           (min(struct_pack(a := source_type, b := source_id, e := {e}, n := {n}))).e AS east_m,
           (min(struct_pack(a := source_type, b := source_id, e := {e}, n := {n}))).n AS north_m,
           max(alt_m) AS alt_m,
           count(*) + user_id % 3 AS hit_count,
           min(source_type) AS least_type,
           count(DISTINCT source_type) AS n_types
    FROM co1h GROUP BY user_id, tick_us)"""
