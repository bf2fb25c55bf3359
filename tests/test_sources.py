"""Feeds, formats, geo and validation on small inputs with known results."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from sensortracks.functions import geo
from sensortracks.operators.validate import validate_detections
from sensortracks.operators.weather import enrich_weather, parse_weather
from sensortracks.schema import RAW_DETECTION_SCHEMA
from sensortracks.sources.feeds import read_adsb_states, read_ais_reports
from sensortracks.sources.formats import decode_radar_frames, encode_frame, read_replay_csv

T0 = dt.datetime(2026, 1, 2, 3, 4, 5, tzinfo=dt.timezone.utc)


def test_enu_goldens(spark):
    df = spark.createDataFrame([(0.0, 0.001, 0.0), (0.001, 0.0, 0.0)], "lat double, lon double, alt double")
    p = geo.to_enu(F.col("lat"), F.col("lon"), F.col("alt"), (0.0, 0.0, 0.0))
    rows = df.select(p.east_m.alias("e"), p.north_m.alias("n")).collect()
    assert abs(rows[0]["e"] - 111.319) < 0.01
    assert abs(rows[1]["n"] - 110.574) < 0.01
    back = spark.createDataFrame([(43.6532, -79.3832, 76.5)], "lat double, lon double, alt double")
    o = (43.65, -79.38, 10.0)
    e = geo.to_enu(F.col("lat"), F.col("lon"), F.col("alt"), o)
    b = back.select(e.alias("p")).select(geo.to_geodetic(F.col("p.east_m"), F.col("p.north_m"),
                                                         F.col("p.up_m"), o).alias("g")).first()["g"]
    assert abs(b["lat_deg"] - 43.6532) < 1e-9 and abs(b["lon_deg"] + 79.3832) < 1e-9 and abs(b["alt_m"] - 76.5) < 1e-4


def test_grid_cell_decimal(spark):
    df = spark.createDataFrame([(43.65, -79.38), (43.651, -79.381), (-79.35, 0.0)], "a double, b double")
    c = df.select(geo.grid_cell(F.col("a"), F.col("b"), 0.1).alias("c")).collect()
    assert c[0]["c"] == c[1]["c"]
    assert c[2]["c"]["cell_lat"] == -794


def test_validation_rules(spark):
    good = ("radar", "RADAR", T0, T0, 43.0, -79.0, None, 1.0, 10.0, 5.0, {})
    bad = [dict(enumerate(good)) for _ in range(7)]
    bad[0][4] = 90.1
    bad[1][5] = -180.1
    bad[2][9] = 0.0
    bad[3][0] = "  "
    bad[4][2] = None
    bad[5][7] = -1.0
    bad[6][8] = 360.0
    rows = [good] + [tuple(b[i] for i in range(11)) for b in bad]
    df = spark.createDataFrame(rows, RAW_DETECTION_SCHEMA)
    valid, rejected = validate_detections(df)
    assert valid.count() == 1
    reasons = sorted(r["reasons"][0] for r in rejected.collect())
    assert reasons == sorted(["lat_outside", "lon_outside", "sigma_not_positive",
                              "source_id_blank", "observed_at_null", "speed_not_positive",
                              "heading_outside"])


def test_adsb_states(spark):
    state = ["4b1f0d", "SWX77  ", "Iceland", 1772600000, 1772600004, 12.5, -33.25, 3300.0, False, 210.5, 12.0,
             None, None, 3412.5, "0041", False, 0]
    south_of_the_pole = [*state[:6], -90.5, *state[7:]]
    doc = {"states": [state, south_of_the_pole, ["4b1f0e", *[None] * 13]]}
    raw = spark.createDataFrame([(json.dumps(doc), T0), ("{not json", T0)], "payload string, received_at timestamp")
    det, rejected = read_adsb_states(raw, "opensky", 10.0)
    rows = det.collect()
    assert len(rows) == 1 and rejected.count() == 1
    r = rows[0]
    assert r["alt_m"] == 3412.5 and r["attributes"]["callsign"] == "SWX77" and r["attributes"]["icao24"] == "4b1f0d"
    assert (r["lat_deg"], r["lon_deg"], r["speed_mps"], r["heading_deg"]) == (-33.25, 12.5, 210.5, 12.0)
    assert r["observed_at"] == dt.datetime.fromtimestamp(1772600000, dt.timezone.utc).replace(tzinfo=None)
    nostates = spark.createDataFrame([('{"time": 1}', T0)], "payload string, received_at timestamp")
    assert read_adsb_states(nostates, "opensky", 10.0)[0].count() == 0


def test_ais_reports(spark):
    good = {"MessageType": "PositionReport",
            "MetaData": {"MMSI": 257000111, "ShipName": "  NORDLYS", "time_utc": "2026-05-06T07:08:09Z"},
            "Message": {"PositionReport": {"Latitude": -12.25, "Longitude": 44.5, "Sog": 20.0, "Cog": 15.0,
                                           "TrueHeading": 17.0}}}
    sentinel = {"MessageType": "PositionReport", "MetaData": {"MMSI": 2},
                "Message": {"PositionReport": {"Latitude": 91, "Longitude": 181, "Sog": 3.0}}}
    raw = spark.createDataFrame([(json.dumps(good), T0), (json.dumps(sentinel), T0)],
                                "payload string, received_at timestamp")
    rows = read_ais_reports(raw, "aisstream", 25.0)[0].collect()
    assert len(rows) == 1
    r = rows[0]
    assert abs(r["speed_mps"] - 20 * 1852 / 3600) < 0.001 and r["heading_deg"] == 17.0 and r["alt_m"] is None
    assert r["attributes"] == {"mmsi": "257000111", "shipName": "NORDLYS"}


def test_radar_frames(spark):
    at = int(T0.timestamp() * 1000)
    good = encode_frame("north-3", "boat-é", at, -12.5, 130.25, 40.0, 7.75, 359.5, 3.0)
    frames = {
        None: good, "frame_missing": None, "frame_truncated": good[:5], "magic_unknown": b"\x00" + good[1:],
        "version_unknown": good[:4] + b"\x09" + good[5:], "length_mismatch": good + b"\x00",
        "text_not_utf8": good.replace("é".encode(), b"\xff\xfe"),
        "source_foreign": encode_frame("south-1", "boat", at, 0, 0, 0, 0, 0, 1),
        "target_missing": encode_frame("north-3", " ", at, 0, 0, 0, 0, 0, 1),
        "lat_outside,speed_not_positive": encode_frame("north-3", "boat", at, 143, 0, 0, -5, 0, 1)}
    raw = spark.createDataFrame([(r, None if f is None else bytearray(f), T0) for r, f in frames.items()],
                                "want string, payload binary, received_at timestamp")
    det, rejected = decode_radar_frames(raw, "north-3")
    rows = det.collect()
    assert len(rows) == 1 and rejected.count() == len(frames) - 1
    assert all(r["want"] == r["reason"] for r in rejected.collect())
    r = rows[0]
    assert (r["lat_deg"], r["lon_deg"], r["alt_m"], r["speed_mps"], r["heading_deg"], r["sigma_m"]) == (
        -12.5, 130.25, 40.0, 7.75, 359.5, 3.0)
    assert r["attributes"] == {"groundTruthId": "boat-é"} and r["observed_at"] == T0.replace(tzinfo=None)


def test_replay_csv(spark, tmp_path):
    p = tmp_path / "replay.csv"
    p.write_text("observedAt,latDeg,lonDeg,altMeters,speedMps,headingDeg,icao24\n"
                 "2026-04-01T10:00:00Z,-12.5,44.25,310,55,182,beef01\n\n"
                 "2026-04-01T10:00:03Z,-12.5015,44.2499,305.5,54,181.5,beef01\n")
    rows = read_replay_csv(spark, str(p)).collect()
    assert len(rows) == 2 and rows[0]["source_id"] == "opensky-replay" and rows[0]["sigma_m"] == 10.0
    bad = tmp_path / "bad.csv"
    bad.write_text("at,height\n2026-04-01T10:00:00Z,310\n")
    with pytest.raises(ValueError):
        read_replay_csv(spark, str(bad))
    blank = tmp_path / "blank.csv"
    blank.write_text("observedAt,latDeg,lonDeg,altMeters,speedMps,headingDeg,icao24\n"
                     "2026-04-01T10:00:00Z,-12.5,44.25,310,55,182, \n")
    with pytest.raises(Exception):
        read_replay_csv(spark, str(blank)).collect()


def test_weather(spark):
    raw = spark.createDataFrame([(json.dumps({"current": {"temperature_2m": -4.25, "wind_speed_10m": 36,
                                                          "wind_direction_10m": 90, "weather_code": 61}}),),
                                 ('{"hourly": {}}',)], "payload string")
    parsed, rejected = parse_weather(raw)
    w = parsed.first()["weather"]
    assert w["weather.temperatureC"] == "-4.25" and w["weather.windSpeedMps"] == "10.0" and w["weather.code"] == "61"
    assert rejected.count() == 1
    wx = parsed.select(F.lit(437).cast("long").alias("cell_lat"), F.lit(-794).cast("long").alias("cell_lon"),
                       F.lit(T0).alias("fetched_at"), "weather")
    dets = spark.createDataFrame(
        [("a", "ADSB", T0, T0 + dt.timedelta(minutes=m), 43.65, -79.38, None, None, None, 5.0, {"icao24": "x"})
         for m in (0, 9, 10)], RAW_DETECTION_SCHEMA)
    out = enrich_weather(dets, wx, "10 minutes", 0.1).orderBy("received_at").collect()
    assert [r["attributes"].get("weather.temperatureC") for r in out] == ["-4.25", "-4.25", None]
    assert out[0]["attributes"]["icao24"] == "x"
