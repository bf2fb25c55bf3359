"""Registered queries for feeds, formats and weather.

Raw inputs (JSON documents, CSV and JSON files, radar frames, weather
responses) are derived by Spark from the ``events`` table, then read back by
the operators; the oracles compute the expected rows from ``events`` directly.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sensortracks.functions import geo
from sensortracks.operators.common import interval_us
from sensortracks.operators.weather import enrich_weather, parse_weather, plan_weather_lookups
from sensortracks.plans import duck
from sensortracks.plans.registry import r, register, us
from sensortracks.session import checkpoint_dir
from sensortracks.sources.feeds import read_adsb_states, read_ais_reports
from sensortracks.sources.formats import (
    decode_radar_frames, encode_frames, read_detections, read_replay_csv, to_keyed_json)
from sensortracks.sources.merge import bbox_filter, union_sources
from sensortracks.sources.testdata import events_as_detections


def _num(c):
    return F.col(c).cast("string") if isinstance(c, str) else c.cast("string")


def _q(c):
    return F.concat(F.lit('"'), c, F.lit('"'))


def adsb_documents(spark, sf_dir):
    d = events_as_detections(spark, sf_dir, keep_event_columns=True)
    eid, uid = F.col("event_id"), F.col("user_id")
    secs = F.floor(F.unix_micros("observed_at") / F.lit(1_000_000)).cast("long")
    icao = F.when(uid % 11 != 0, _q(F.lower(F.hex(uid)))).otherwise(F.lit("null"))
    hdg = (F.when(eid % 23 == 0, F.lit("360")).when(eid % 31 == 0, F.lit("361.0"))
           .otherwise(F.coalesce(_num("heading_deg"), F.lit("null"))))
    state = F.concat_ws(",", icao, _q(F.concat(F.lit("  CS"), uid.cast("string"), F.lit(" "))), _q(F.col("event_type")),
                        F.when(eid % 3 == 0, F.lit("null")).otherwise(secs.cast("string")),
                        (secs + 1).cast("string"),
                        F.when(eid % 17 == 0, _q(_num("lon_deg"))).otherwise(_num("lon_deg")),
                        F.when(eid % 13 == 0, F.lit("95.5")).otherwise(_num("lat_deg")),
                        (uid + 1000).cast("string"), F.lit("false"),
                        F.when(eid % 29 == 0, F.lit("-1.5")).otherwise(_num("speed_mps")), hdg,
                        F.lit("null"), F.lit("null"),
                        F.when(uid % 4 == 0, F.lit("null")).otherwise((uid + 1005).cast("string")),
                        _q(F.lit("1200")), F.lit("false"), F.lit("0"))
    states = F.concat(F.lit("["), state, F.lit("]"),
                      F.when(eid % 7 == 0, F.lit(', ["abc", "short", 1]')).otherwise(F.lit("")))
    doc = F.when(eid % 97 == 0, F.lit('{"states": [')).otherwise(F.concat(F.lit('{"states": ['), states, F.lit("]}")))
    return d.select("event_id", doc.alias("payload"), "received_at")


@register("read_adsb_states", duck.with_det("""
SELECT event_id, 0::INTEGER AS state_index,
       CASE WHEN event_id % 3 <> 0 THEN floor(epoch_us(observed_at) / 1000000)::BIGINT * 1000000
            ELSE (floor(epoch_us(observed_at) / 1000000)::BIGINT + 1) * 1000000 END AS observed_us,
       lat_deg, lon_deg,
       CASE WHEN user_id % 4 = 0 THEN (user_id + 1000)::DOUBLE ELSE (user_id + 1005)::DOUBLE END AS alt_m,
       CASE WHEN event_id % 29 = 0 THEN NULL ELSE speed_mps END AS speed_mps,
       CASE WHEN event_id % 23 = 0 THEN 0.0 WHEN event_id % 31 = 0 THEN NULL ELSE heading_deg END AS heading_deg,
       CASE WHEN user_id % 11 <> 0 THEN lower(hex(user_id)) END AS icao24,
       'CS' || user_id::VARCHAR AS callsign, source_type AS origin_country
FROM det WHERE event_id % 97 <> 0 AND event_id % 13 <> 0 AND event_id % 17 <> 0"""))
def q_adsb(spark, sf_dir):
    det, _ = read_adsb_states(adsb_documents(spark, sf_dir), "opensky", 10.0)
    return det.select("event_id", "state_index", us("observed_at").alias("observed_us"), "lat_deg", "lon_deg",
                      "alt_m", "speed_mps", "heading_deg", F.col("attributes")["icao24"].alias("icao24"),
                      F.col("attributes")["callsign"].alias("callsign"),
                      F.col("attributes")["originCountry"].alias("origin_country"))


def ais_messages(spark, sf_dir):
    d = events_as_detections(spark, sf_dir, keep_event_columns=True)
    eid, uid = F.col("event_id"), F.col("user_id")
    iso = F.date_format("observed_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    odd = F.concat(F.date_format("observed_at", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit(" +0000 UTC"))
    meta = F.concat(
        F.lit('{"MMSI": '), F.when(uid % 11 == 0, F.lit("null")).otherwise((uid + 200000000).cast("string")),
        F.lit(', "ShipName": " SHIP '), uid.cast("string"), F.lit(' ", "time_utc": '),
        _q(F.when(eid % 3 == 0, odd).otherwise(iso)),
        F.lit(', "Latitude": '), _num("lat_deg"), F.lit(', "Longitude": '), _num("lon_deg"), F.lit("}"))
    sog = F.when(eid % 29 == 0, F.lit("102.3")).otherwise(_num(F.col("value") % 30))
    true_hdg = F.when(eid % 5 == 0, F.lit("511")).otherwise(_num("heading_deg"))
    report = F.concat(
        F.lit('{"Latitude": '), F.when(eid % 13 == 0, F.lit("91")).otherwise(_num("lat_deg")),
        F.lit(', "Longitude": '), _num("lon_deg"), F.lit(', "Sog": '), sog,
        F.lit(', "Cog": '), (eid % 360).cast("string"), F.lit(', "TrueHeading": '), true_hdg,
        F.lit(', "UserID": '), (uid + 300000000).cast("string"), F.lit("}"))
    kind = F.when(eid % 19 == 0, F.lit("ShipStaticData")).otherwise(F.lit("PositionReport"))
    meta_key = F.when(eid % 2 == 0, F.lit("MetaData")).otherwise(F.lit("Metadata"))
    doc = F.concat(F.lit('{"MessageType": '), _q(kind), F.lit(", "), _q(meta_key), F.lit(": "), meta,
                   F.lit(', "Message": {"PositionReport": '), report, F.lit("}}"))
    doc = F.when(eid % 97 == 0, F.lit("{not json")).otherwise(doc)
    return d.select("event_id", doc.alias("payload"), "received_at")


@register("read_ais_reports", duck.with_det("""
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN epoch_us(received_at) ELSE epoch_us(observed_at) END AS observed_us,
       lat_deg, lon_deg,
       CASE WHEN event_id % 29 = 0 THEN NULL ELSE round((value % 30) * 0.514444, 9) + 0.0 END AS speed_mps,
       CASE WHEN event_id % 5 = 0 THEN (event_id % 360)::DOUBLE ELSE heading_deg END AS heading_deg,
       CASE WHEN user_id % 11 = 0 THEN (user_id + 300000000)::VARCHAR ELSE (user_id + 200000000)::VARCHAR END AS mmsi,
       'SHIP ' || user_id::VARCHAR AS ship_name
FROM det WHERE event_id % 97 <> 0 AND event_id % 19 <> 0 AND event_id % 13 <> 0"""))
def q_ais(spark, sf_dir):
    det, _ = read_ais_reports(ais_messages(spark, sf_dir), "aisstream", 25.0)
    return det.select("event_id", us("observed_at").alias("observed_us"), "lat_deg", "lon_deg",
                      r("speed_mps", 9).alias("speed_mps"), "heading_deg",
                      F.col("attributes")["mmsi"].alias("mmsi"), F.col("attributes")["shipName"].alias("ship_name"))


@register("decode_radar_frames", duck.with_det("""
SELECT event_id,
       CASE WHEN event_id % 23 = 0 THEN 'frame_missing' WHEN event_id % 13 = 0 THEN 'magic_unknown'
            WHEN event_id % 17 = 0 THEN 'version_unknown' WHEN event_id % 19 = 0 THEN 'length_mismatch'
            WHEN event_id % 11 = 0 THEN 'source_foreign' WHEN event_id % 29 = 0 THEN 'target_missing'
            WHEN event_id % 31 = 0 THEN 'lat_outside,sigma_not_positive' END AS reason,
       CASE WHEN ok THEN (epoch_us(observed_at) // 1000) * 1000 END AS observed_us,
       CASE WHEN ok THEN lat_deg END AS lat_deg, CASE WHEN ok THEN lon_deg END AS lon_deg,
       CASE WHEN ok THEN coalesce(alt_m, 0.0) END AS alt_m, CASE WHEN ok THEN speed_mps END AS speed_mps,
       CASE WHEN ok THEN coalesce(heading_deg, 0.0) END AS heading_deg, CASE WHEN ok THEN sigma_m END AS sigma_m,
       CASE WHEN ok THEN 'target-' || user_id::VARCHAR END AS ground_truth_id
FROM (SELECT *, NOT (event_id % 23 = 0 OR event_id % 13 = 0 OR event_id % 17 = 0 OR event_id % 19 = 0
                     OR event_id % 11 = 0 OR event_id % 29 = 0 OR event_id % 31 = 0) AS ok FROM det)"""))
def q_radar(spark, sf_dir):
    d = events_as_detections(spark, sf_dir, keep_event_columns=True)
    eid = F.col("event_id")
    src = F.when(eid % 11 == 0, F.lit("radar-west")).otherwise(F.lit("radar-east"))
    frames = encode_frames(d.select(
        "event_id", "received_at", src.alias("source_id"),
        F.when(eid % 29 == 0, F.lit("  ")).otherwise(
            F.concat(F.lit("target-"), F.col("user_id").cast("string"))).alias("ground_truth_id"),
        F.floor(F.unix_micros("observed_at") / 1000).cast("long").alias("observed_ms"),
        F.when(eid % 31 == 0, F.lit(143.0)).otherwise(F.col("lat_deg")).alias("lat_deg"),
        "lon_deg", F.coalesce("alt_m", F.lit(0.0)).alias("alt_m"),
        "speed_mps", F.coalesce("heading_deg", F.lit(0.0)).alias("heading_deg"),
        F.when(eid % 31 == 0, F.lit(0.0)).otherwise(F.col("sigma_m")).alias("sigma_m")))
    # lost and corrupted frames: no payload, flipped magic, wrong version, truncated
    p = F.col("payload")
    bad = (F.when(eid % 23 == 0, F.lit(None).cast("binary"))
           .when(eid % 13 == 0, F.concat(F.unhex(F.lit("00")), F.substring(p, 2, 1 << 20)))
           .when(eid % 17 == 0, F.concat(F.substring(p, 1, 4), F.unhex(F.lit("02")), F.substring(p, 6, 1 << 20)))
           .when(eid % 19 == 0, F.substring(p, 1, 40)).otherwise(p))
    frames = frames.withColumn("payload", bad).select("event_id", "payload", "received_at")
    det, rejected = decode_radar_frames(frames, "radar-east")
    out = det.select("event_id", us("observed_at").alias("observed_us"), "lat_deg", "lon_deg", "alt_m", "speed_mps",
                     "heading_deg", "sigma_m", F.col("attributes")["groundTruthId"].alias("ground_truth_id"))
    return out.unionByName(rejected.select("event_id", "reason"), allowMissingColumns=True)


@register("read_replay_csv", duck.with_det("""
SELECT 'opensky-replay' AS source_id, (epoch_us(observed_at) // 1000000) * 1000000 AS observed_us,
       round(lat_deg, 6) + 0.0 AS lat_deg, round(lon_deg, 6) + 0.0 AS lon_deg,
       coalesce(alt_m, 0.0) AS alt_m, speed_mps, coalesce(heading_deg, 0.0) AS heading_deg,
       lower(hex(user_id)) AS icao24
FROM det"""))
def q_replay_csv(spark, sf_dir):
    d = events_as_detections(spark, sf_dir, keep_event_columns=True)
    path = f"{checkpoint_dir(spark).rstrip('/')}/replay-{uuid.uuid4().hex}"
    # every part file starts with the header
    d.select(
        F.date_format("observed_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("observedAt"),
        F.round("lat_deg", 6).alias("latDeg"), F.round("lon_deg", 6).alias("lonDeg"),
        F.coalesce("alt_m", F.lit(0.0)).alias("altMeters"), F.col("speed_mps").alias("speedMps"),
        F.coalesce("heading_deg", F.lit(0.0)).alias("headingDeg"),
        F.lower(F.hex("user_id")).alias("icao24")).write.option("header", True).csv(path)
    det = read_replay_csv(spark, path)
    return det.select("source_id", us("observed_at").alias("observed_us"), r("lat_deg", 6).alias("lat_deg"),
                      r("lon_deg", 6).alias("lon_deg"), "alt_m", "speed_mps", "heading_deg",
                      F.col("attributes")["icao24"].alias("icao24"))


@register("read_detections", duck.with_det("""
SELECT source_id, source_type, epoch_us(observed_at) AS observed_us, epoch_us(received_at) AS received_us,
       lat_deg, lon_deg, alt_m, speed_mps, heading_deg, sigma_m, icao24
FROM det"""))
def q_read_detections(spark, sf_dir):
    d = events_as_detections(spark, sf_dir, keep_event_columns=True)
    path = f"{checkpoint_dir(spark).rstrip('/')}/detections-{uuid.uuid4().hex}"
    # half the rows carry ISO text, half epoch seconds (both are accepted)
    epoch = F.format_string("%d.%06d", F.floor(F.unix_micros("observed_at") / 1_000_000),
                            F.pmod(F.unix_micros("observed_at"), F.lit(1_000_000)))
    iso = F.date_format("observed_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    out = d.select(F.to_json(F.struct(
        F.col("source_id").alias("sourceId"), F.col("source_type").alias("sourceType"),
        F.when(F.col("event_id") % 2 == 0, iso).otherwise(epoch).alias("observedAt"),
        F.date_format("received_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("receivedAt"),
        F.col("lat_deg").alias("latDeg"), F.col("lon_deg").alias("lonDeg"), F.col("alt_m").alias("altMeters"),
        F.col("speed_mps").alias("speedMps"), F.col("heading_deg").alias("headingDeg"),
        F.col("sigma_m").alias("positionSigmaMeters"), F.col("attributes").alias("attributes"))).alias("value"))
    out.write.text(path)
    back = read_detections(spark, path)
    return back.select("source_id", "source_type", us("observed_at").alias("observed_us"),
                       us("received_at").alias("received_us"), "lat_deg", "lon_deg", "alt_m", "speed_mps",
                       "heading_deg", "sigma_m", F.col("attributes")["icao24"].alias("icao24"))


@register("union_sources", duck.with_det("""
SELECT source_type, source_id, count(*) FILTER (WHERE ok) AS accepted, count(*) FILTER (WHERE NOT ok) AS refused
FROM (SELECT source_type, source_id, CASE WHEN source_type IN ('view', 'click') THEN source_type = 'view' ELSE true END AS ok
      FROM det) GROUP BY ALL"""))
def q_union(spark, sf_dir):
    d = events_as_detections(spark, sf_dir)
    replay = d.filter(F.col("source_type").isin("view", "click"))  # declared as view-feed only
    others = d.filter(~F.col("source_type").isin("view", "click"))
    ok, refused = union_sources([(replay, ("view-feed", "view")), (others, None)])
    a = ok.groupBy("source_type", "source_id").agg(F.count(F.lit(1)).alias("accepted"))
    b = refused.groupBy("source_type", "source_id").agg(F.count(F.lit(1)).alias("refused"))
    return a.join(b, ["source_type", "source_id"], "full").select(
        "source_type", "source_id", F.coalesce("accepted", F.lit(0)).alias("accepted"),
        F.coalesce("refused", F.lit(0)).alias("refused"))


_BOXES = [(43.60, -79.45, 43.70, -79.35), (43.80, -79.20, 43.75, -79.28)]


@register("bbox_filter", duck.with_det("""
SELECT event_id FROM det
WHERE (lat_deg BETWEEN 43.60 AND 43.70 AND lon_deg BETWEEN -79.45 AND -79.35)
   OR (lat_deg BETWEEN 43.75 AND 43.80 AND lon_deg BETWEEN -79.28 AND -79.20)"""))
def q_bbox(spark, sf_dir):
    return bbox_filter(events_as_detections(spark, sf_dir), _BOXES).select("event_id")


@register("to_keyed_json", duck.with_det("""
SELECT event_id, source_type || ':' || source_id AS key, lat_deg, sigma_m, icao24 FROM det"""))
def q_keyed(spark, sf_dir):
    k = to_keyed_json(events_as_detections(spark, sf_dir), "event_id")
    return k.select("event_id", "key",
                    F.get_json_object("value", "$.latDeg").cast("double").alias("lat_deg"),
                    F.get_json_object("value", "$.positionSigmaMeters").cast("double").alias("sigma_m"),
                    F.get_json_object("value", "$.attributes.icao24").alias("icao24"))


WEATHER_TTL = "45 minutes"


def weather_table(spark, sf_dir):
    """One weather response per (0.1 degree cell, hour) with detections in it."""
    d = events_as_detections(spark, sf_dir, keep_event_columns=True)
    c = geo.grid_cell(F.col("lat_deg"), F.col("lon_deg"), 0.1)
    hour = F.floor(F.unix_micros("received_at") / F.lit(3_600_000_000)).cast("long")
    g = d.groupBy(c.cell_lat.alias("cell_lat"), c.cell_lon.alias("cell_lon"), hour.alias("hour")).agg(
        F.min("value").alias("v"), F.min("event_id").alias("eid"))
    fetched = F.timestamp_micros(F.col("hour") * 3_600_000_000 + F.pmod(F.col("eid") * 7919, F.lit(1800)) * 1_000_000)
    code = F.when(F.col("eid") % 5 == 0, F.lit("3.0")).otherwise((F.col("eid") % 4).cast("string"))
    doc = F.concat(F.lit('{"current": {"temperature_2m": '), ((F.col("v") % 40) - 10).cast("string"),
                   F.lit(', "wind_speed_10m": '), (F.col("eid") % 50).cast("string"),
                   F.lit(', "wind_direction_10m": '), (F.col("eid") % 360).cast("string"),
                   F.lit(', "weather_code": '), code, F.lit("}}"))
    doc = F.when(F.col("eid") % 37 == 0, F.lit('{"error": true}')).otherwise(doc)
    return g.select("cell_lat", "cell_lon", "hour", "eid", fetched.alias("fetched_at"), doc.alias("payload"))


_DUCK_WEATHER = """wx AS (
  SELECT *, make_timestamp(hour * 3600000000 + ((eid * 7919) % 1800) * 1000000) AS fetched_at FROM (
    SELECT cell_lat, cell_lon, hour, min(value) AS v, min(event_id) AS eid
    FROM (SELECT *, round(lat_deg::DECIMAL(24,15) * 10, 0)::BIGINT AS cell_lat,
                 round(lon_deg::DECIMAL(24,15) * 10, 0)::BIGINT AS cell_lon,
                 epoch_us(received_at) // 3600000000 AS hour FROM det)
    GROUP BY cell_lat, cell_lon, hour))"""


@register("parse_weather", duck.with_det("""
SELECT cell_lat, cell_lon, hour, (v % 40) - 10 AS temperature_c, round((eid % 50) * (1 / 3.6), 9) + 0.0 AS wind_mps,
       (eid % 360)::DOUBLE AS wind_dir_deg, CASE WHEN eid % 5 = 0 THEN NULL ELSE (eid % 4)::VARCHAR END AS code
FROM wx WHERE eid % 37 <> 0""", _DUCK_WEATHER))
def q_parse_weather(spark, sf_dir):
    parsed, _ = parse_weather(weather_table(spark, sf_dir))
    w = F.col("weather")
    return parsed.select("cell_lat", "cell_lon", "hour",
                         w["weather.temperatureC"].cast("double").alias("temperature_c"),
                         r(w["weather.windSpeedMps"].cast("double"), 9).alias("wind_mps"),
                         w["weather.windDirectionDeg"].cast("double").alias("wind_dir_deg"),
                         w["weather.code"].alias("code"))


@register("enrich_weather", duck.with_det(f"""
SELECT d.event_id,
       CASE WHEN w.fetched_at IS NOT NULL AND epoch_us(d.received_at) < epoch_us(w.fetched_at) + {interval_us(WEATHER_TTL)}
            THEN (w.v % 40) - 10 END AS temperature_c,
       CASE WHEN w.fetched_at IS NOT NULL AND epoch_us(d.received_at) < epoch_us(w.fetched_at) + {interval_us(WEATHER_TTL)}
            THEN epoch_us(w.fetched_at) END AS fetched_us
FROM (SELECT *, round(lat_deg::DECIMAL(24,15) * 10, 0)::BIGINT AS cell_lat,
             round(lon_deg::DECIMAL(24,15) * 10, 0)::BIGINT AS cell_lon FROM det) d
ASOF LEFT JOIN (SELECT * FROM wx WHERE eid % 37 <> 0) w
  ON d.cell_lat = w.cell_lat AND d.cell_lon = w.cell_lon AND d.received_at >= w.fetched_at""", _DUCK_WEATHER))
def q_enrich(spark, sf_dir):
    parsed, _ = parse_weather(weather_table(spark, sf_dir))
    wx = parsed.select("cell_lat", "cell_lon", "fetched_at",
                       F.map_concat("weather", F.create_map(F.lit("weather.fetchedUs"),
                                                            F.unix_micros("fetched_at").cast("string")))
                       .alias("weather"))
    d = events_as_detections(spark, sf_dir)
    e = enrich_weather(d, wx, WEATHER_TTL, 0.1)
    a = F.col("attributes")
    return e.select("event_id", a["weather.temperatureC"].cast("double").alias("temperature_c"),
                    a["weather.fetchedUs"].cast("long").alias("fetched_us"))


@register("plan_weather_lookups", "WITH RECURSIVE " + duck.with_det(f"""
SELECT f.cell_lat, f.cell_lon, f.t AS fetch_us, count(*) AS requests_served
FROM fetches f JOIN req r ON r.cell_lat = f.cell_lat AND r.cell_lon = f.cell_lon
  AND r.t >= f.t AND r.t < f.t + {interval_us('10 minutes')}
WHERE f.t IS NOT NULL GROUP BY ALL""", f"""req AS (
  SELECT round(lat_deg::DECIMAL(24,15) * 10, 0)::BIGINT AS cell_lat, round(lon_deg::DECIMAL(24,15) * 10, 0)::BIGINT AS cell_lon,
         epoch_us(received_at) AS t FROM det),
fetches AS (
  SELECT cell_lat, cell_lon, min(t) AS t FROM req GROUP BY ALL
  UNION ALL
  SELECT f.cell_lat, f.cell_lon,
         (SELECT min(r.t) FROM req r WHERE r.cell_lat = f.cell_lat AND r.cell_lon = f.cell_lon
            AND r.t >= f.t + {interval_us('10 minutes')})
  FROM fetches f WHERE f.t IS NOT NULL)""")[len("WITH "):])
def q_plan_lookups(spark, sf_dir):
    p = plan_weather_lookups(events_as_detections(spark, sf_dir), "10 minutes", 0.1)
    return p.select("cell_lat", "cell_lon", us("fetch_at").alias("fetch_us"), "requests_served")
