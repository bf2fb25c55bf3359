"""Registered queries for sources, geo columns and event-time operators (A, B, C)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensortracks.functions import geo
from sensortracks.functions.order import identity
from sensortracks.operators.ticks import (
    assign_tick, classify_outcomes, coalesce_detections, dedup_deliveries, order_detections)
from sensortracks.operators.validate import validate_detections
from sensortracks.plans import duck
from sensortracks.plans.registry import r, register, us
from sensortracks.sources.testdata import (
    ORIGIN, events_as_deliveries, events_as_detections, read_table)
from sensortracks.session import configure

TRACK_TICK = "6 hours"
TRACK_TICK_US = 6 * 3600 * 1_000_000


def raw_event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events mapped with rule-breaking formulas: input for the validator."""
    configure(spark)
    ev = read_table(spark, sf_dir, "events")
    eid, uid, val = F.col("event_id"), F.col("user_id"), F.col("value")
    return ev.select(
        eid.alias("event_id"),
        F.when(eid % 13 == 0, F.lit(" ")).otherwise(F.concat(F.col("event_type"), F.lit("-feed")))
        .alias("source_id"),
        F.col("event_type").alias("source_type"),
        F.when(eid % 29 != 0, F.col("ts").cast("timestamp")).alias("observed_at"),
        F.col("ts").cast("timestamp").alias("received_at"),
        ((val % 200) - 100).alias("lat_deg"),
        ((val * 3) % 400 - 200).alias("lon_deg"),
        F.when(uid % 3 == 0, F.lit(float("nan"))).when(uid % 3 == 1, uid.cast("double"))
        .alias("alt_m"),
        (val % 60 - 10).alias("speed_mps"),
        F.when(eid % 5 != 0, (eid % 400).cast("double")).alias("heading_deg"),
        ((uid % 7) * 5).cast("double").alias("sigma_m"),
        F.create_map(F.lit("k"), F.when(eid % 31 != 0, F.get_json_object("props", "$.k"))).alias("attributes"),
    )


_RULES_SQL = [
  ("source_id IS NULL OR NOT regexp_matches(source_id, '\\S')", 'source_id_blank'),
  ("source_type IS NULL OR NOT regexp_matches(source_type, '\\S')", 'source_type_blank'),
  ("observed_at IS NULL", 'observed_at_null'),
  ("received_at IS NULL", 'received_at_null'),
  ("NOT (lat_deg >= -90 AND lat_deg <= 90)", 'lat_outside'),
  ("NOT (lon_deg >= -180 AND lon_deg <= 180)", 'lon_outside'),
  ("alt_m IS NOT NULL AND isnan(alt_m)", 'alt_not_finite'),
  ("speed_mps IS NOT NULL AND NOT (speed_mps >= 0)", 'speed_not_positive'),
  ("heading_deg IS NOT NULL AND NOT (heading_deg >= 0 AND heading_deg < 360)", 'heading_outside'),
  ("NOT (sigma_m > 0)", 'sigma_not_positive'),
  ("attribute_k IS NULL", 'attribute_null'),
]
_RAW_SQL = """raw AS (
  SELECT event_id,
         CASE WHEN event_id % 13 = 0 THEN ' ' ELSE event_type || '-feed' END AS source_id,
         event_type AS source_type,
         CASE WHEN event_id % 29 <> 0 THEN ts END AS observed_at,
         ts AS received_at,
         (value % 200) - 100 AS lat_deg,
         (value * 3) % 400 - 200 AS lon_deg,
         CASE WHEN user_id % 3 = 0 THEN 'NaN'::DOUBLE WHEN user_id % 3 = 1 THEN user_id::DOUBLE END AS alt_m,
         value % 60 - 10 AS speed_mps,
         CASE WHEN event_id % 5 <> 0 THEN (event_id % 400)::DOUBLE END AS heading_deg,
         ((user_id % 7) * 5)::DOUBLE AS sigma_m,
         CASE WHEN event_id % 31 <> 0 THEN json_extract_string(props, '$.k') END AS attribute_k
  FROM events)"""
_N_SQL = " + ".join(f"(CASE WHEN {c} THEN 1 ELSE 0 END)" for c, _ in _RULES_SQL)
_MSG_SQL = ", ".join(f"CASE WHEN {c} THEN '{m}' END" for c, m in _RULES_SQL)


@register("validate_detections", duck.with_det(f"""
SELECT event_id, n_reasons = 0 AS is_valid, n_reasons, reasons FROM (
  SELECT event_id, ({_N_SQL})::BIGINT AS n_reasons, concat_ws('|', {_MSG_SQL}) AS reasons FROM raw)""",
    _RAW_SQL))
def q_validate(spark, sf_dir):
    raw = raw_event_rows(spark, sf_dir)
    valid, rejected = validate_detections(raw)
    ok = valid.select("event_id", F.lit(True).alias("is_valid"), F.lit(0).cast("long").alias("n_reasons"),
                      F.lit("").alias("reasons"))
    bad = rejected.select("event_id", F.lit(False).alias("is_valid"),
                          F.size("reasons").cast("long").alias("n_reasons"),
                          F.array_join("reasons", "|").alias("reasons"))
    return ok.unionByName(bad)


@register("assign_tick", duck.with_det(f"""
SELECT event_id, epoch_us(observed_at) AS observed_us,
       {duck.tick_us('observed_at', 1_000_000)} AS tick_us,
       {duck.tick_us('observed_at', 3_600_000_000)} AS hour_tick_us
FROM det"""))
def q_assign_tick(spark, sf_dir):
    d = assign_tick(events_as_detections(spark, sf_dir), "1 second")
    d = assign_tick(d, "1 hour", out="hour_tick")
    return d.select("event_id", us("observed_at").alias("observed_us"), us("tick").alias("tick_us"),
                    us("hour_tick").alias("hour_tick_us"))


DUCK_DELIVERIES = """deliv AS (
  SELECT *, make_timestamp(epoch_us(received_at) + 5000) AS arrived_at FROM det
  UNION ALL
  SELECT *, make_timestamp(epoch_us(received_at) + 255000) AS arrived_at FROM det WHERE event_id % 17 = 0)"""


@register("dedup_deliveries", duck.with_det("""
SELECT topic, "partition"::BIGINT AS "partition", "offset", event_id, epoch_us(arrived_at) AS arrived_us
FROM (SELECT *, row_number() OVER (PARTITION BY topic, "partition", "offset" ORDER BY arrived_at) AS rn
      FROM deliv) WHERE rn = 1""", DUCK_DELIVERIES))
def q_dedup(spark, sf_dir):
    first, _ = dedup_deliveries(events_as_deliveries(spark, sf_dir))
    return first.select("topic", F.col("partition").cast("long").alias("partition"), "offset",
                        "event_id", us("arrived_at").alias("arrived_us"))


@register("redelivery_counts", duck.with_det("""
SELECT source_type, source_id, sum(c - 1)::BIGINT AS redelivered FROM (
  SELECT source_type, source_id, count(*) AS c FROM deliv GROUP BY topic, "partition", "offset", source_type, source_id
) WHERE c > 1 GROUP BY source_type, source_id""", DUCK_DELIVERIES))
def q_redelivery(spark, sf_dir):
    _, again = dedup_deliveries(events_as_deliveries(spark, sf_dir))
    return again.groupBy("source_type", "source_id").agg(
        F.sum("redelivered").cast("long").alias("redelivered"))


def outcome_input(spark, sf_dir) -> DataFrame:
    """De-duplicated deliveries with every 23rd record arriving ten minutes late."""
    first, _ = dedup_deliveries(events_as_deliveries(spark, sf_dir))
    late = F.timestamp_micros(F.unix_micros("arrived_at") + F.lit(600_000_000))
    first = first.withColumn("arrived_at", F.when(F.col("event_id") % 23 == 0, late)
                             .otherwise(F.col("arrived_at")))
    return assign_tick(first, "1 second")


def outcome_as_of(spark, sf_dir):
    return F.timestamp_micros(F.unix_micros(F.lit("2024-01-30 12:00:00").cast("timestamp")))


DUCK_OUTCOMES = DUCK_DELIVERIES + f""",
firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY topic, "partition", "offset" ORDER BY arrived_at) AS rn
           FROM deliv) WHERE rn = 1),
g AS (SELECT event_id, received_at,
        CASE WHEN event_id % 23 = 0 THEN make_timestamp(epoch_us(arrived_at) + 600000000) ELSE arrived_at END AS arrived_at,
        make_timestamp({duck.tick_us("observed_at", 1_000_000)}) AS tick FROM firsts),
f AS (SELECT event_id, tick, received_at,
        (greatest(epoch_us(arrived_at), epoch_us(tick) + 2000000) + 499999) // 500000 AS flush_no FROM g),
outcomes AS (
  SELECT a.event_id, a.flush_no, epoch_us(a.tick) AS tick_us, epoch_us(a.received_at) AS received_us,
    CASE WHEN a.flush_no * 500000 > epoch_us(TIMESTAMP '2024-01-30 12:00:00') THEN 'PENDING'
         WHEN EXISTS (SELECT 1 FROM f b WHERE b.flush_no < a.flush_no AND b.tick >= a.tick) THEN 'LATE'
         ELSE 'FUSED' END AS outcome
  FROM f a)"""


@register("classify_outcomes", duck.with_det("SELECT event_id, flush_no, tick_us, outcome FROM outcomes", DUCK_OUTCOMES))
def q_outcomes(spark, sf_dir):
    df = outcome_input(spark, sf_dir)
    out = classify_outcomes(df, as_of="2024-01-30 12:00:00", lateness="2 seconds", flush="500 ms")
    return out.select("event_id", "flush_no", us("tick").alias("tick_us"), "outcome")


@register("coalesce_detections", duck.with_det(f"""
SELECT tick_us, source_type, source_id, event_id,
       CASE WHEN icao24 IS NOT NULL THEN 'icao24=' || icao24 END AS identity
FROM (SELECT *, row_number() OVER (PARTITION BY tick_us, source_type, source_id, icao24
                                   ORDER BY {duck.CANONICAL_DESC}) AS rn
      FROM (SELECT *, {duck.tick_us('observed_at', TRACK_TICK_US)} AS tick_us,
                   {duck.attr_entries()} AS attr_entries FROM det))
WHERE icao24 IS NULL OR rn = 1"""))
def q_coalesce(spark, sf_dir):
    d = assign_tick(events_as_detections(spark, sf_dir), TRACK_TICK)
    c = coalesce_detections(d)
    return c.select(us("tick").alias("tick_us"), "source_type", "source_id", "event_id",
                    identity().alias("identity"))


@register("order_detections", duck.with_det(f"""
SELECT event_id, row_number() OVER (ORDER BY {duck.CANONICAL_ASC}) AS ordinal
FROM (SELECT *, {duck.attr_entries()} AS attr_entries FROM det)"""))
def q_order(spark, sf_dir):
    return order_detections(events_as_detections(spark, sf_dir), "ordinal").select("event_id", "ordinal")


_E, _N, _U = duck.enu("lat_deg", "lon_deg", "alt_m")


@register("to_enu", duck.with_det(f"""
SELECT event_id, {duck.rnd(_E)} AS east_m, {duck.rnd(_N)} AS north_m, {duck.rnd(_U)} AS up_m FROM det"""))
def q_to_enu(spark, sf_dir):
    d = events_as_detections(spark, sf_dir)
    p = geo.to_enu(F.col("lat_deg"), F.col("lon_deg"), F.col("alt_m"), ORIGIN)
    return d.select("event_id", r(p.east_m).alias("east_m"), r(p.north_m).alias("north_m"),
                    r(p.up_m).alias("up_m"))


_LAT, _LON, _ALT = duck.geodetic("e", "n", "u")


@register("to_geodetic", duck.with_det(f"""
SELECT event_id, {duck.rnd(_LAT, 7)} AS lat_deg, {duck.rnd(_LON, 7)} AS lon_deg, {duck.rnd(_ALT)} AS alt_m
FROM (SELECT event_id, {_E} AS e, {_N} AS n, {_U} AS u FROM det)"""))
def q_to_geodetic(spark, sf_dir):
    d = events_as_detections(spark, sf_dir)
    p = geo.to_enu(F.col("lat_deg"), F.col("lon_deg"), F.col("alt_m"), ORIGIN)
    d = d.select("event_id", p.alias("p"))
    g = geo.to_geodetic(F.col("p.east_m"), F.col("p.north_m"), F.col("p.up_m"), ORIGIN)
    return d.select("event_id", r(g.lat_deg, 7).alias("lat_deg"), r(g.lon_deg, 7).alias("lon_deg"),
                    r(g.alt_m).alias("alt_m"))


@register("velocity_components", duck.with_det(f"""
SELECT event_id,
  {duck.rnd("CASE WHEN speed_mps IS NOT NULL AND heading_deg IS NOT NULL THEN speed_mps * sin(radians(heading_deg)) ELSE 0.0 END", 6)} AS ve_mps,
  {duck.rnd("CASE WHEN speed_mps IS NOT NULL AND heading_deg IS NOT NULL THEN speed_mps * cos(radians(heading_deg)) ELSE 0.0 END", 6)} AS vn_mps,
  {duck.rnd("CASE WHEN speed_mps IS NOT NULL AND heading_deg IS NOT NULL THEN sqrt(pow(speed_mps * sin(radians(heading_deg)), 2) + pow(speed_mps * cos(radians(heading_deg)), 2)) ELSE 0.0 END", 6)} AS ground_speed_mps
FROM det"""))
def q_velocity(spark, sf_dir):
    d = events_as_detections(spark, sf_dir)
    v = geo.velocity_components(F.col("speed_mps"), F.col("heading_deg"))
    d = d.select("event_id", v.alias("v"))
    return d.select("event_id", r("v.ve_mps", 6).alias("ve_mps"), r("v.vn_mps", 6).alias("vn_mps"),
                    r(geo.ground_speed(F.col("v.ve_mps"), F.col("v.vn_mps")), 6).alias("ground_speed_mps"))


@register("grid_cell", duck.with_det("""
SELECT event_id,
  round(lat_deg::DECIMAL(24,15) * 10, 0)::BIGINT AS cell_lat, round(lon_deg::DECIMAL(24,15) * 10, 0)::BIGINT AS cell_lon,
  round(lat_deg::DECIMAL(24,15) * 20, 0)::BIGINT AS fine_lat, round(lon_deg::DECIMAL(24,15) * 20, 0)::BIGINT AS fine_lon
FROM det"""))
def q_grid(spark, sf_dir):
    d = events_as_detections(spark, sf_dir)
    c = geo.grid_cell(F.col("lat_deg"), F.col("lon_deg"), 0.1)
    f = geo.grid_cell(F.col("lat_deg"), F.col("lon_deg"), 0.05)
    return d.select("event_id", c.cell_lat.alias("cell_lat"), c.cell_lon.alias("cell_lon"),
                    f.cell_lat.alias("fine_lat"), f.cell_lon.alias("fine_lon"))
