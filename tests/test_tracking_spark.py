"""Tracker-level properties on Spark: lifecycle windows vs a fold, outcomes vs a
simulation, region split vs one run, streaming vs batch, shuffled input."""

import random
import tempfile

import pandas as pd
from pyspark.sql import functions as F

from conftest import SF_SMALL
from sensortracks.operators.lifecycle import track_lifecycle
from sensortracks.operators.regions import build_tracks_by_region
from sensortracks.operators.ticks import classify_outcomes
from sensortracks.operators.tracker import ONE_REGION, build_tracks
from sensortracks.schema import FusionConfig
from sensortracks.sources.testdata import events_as_detections


def _fold(hits, cfg):
    """Plain per-row state machine (the test's own reading of the rules)."""
    out, status = [], None
    window, count, misses = [], 0, 0
    for i, h in enumerate(hits):
        if i == 0:
            status, window, count, misses = ("CONFIRMED" if cfg.confirmation_hits == 1 else "TENTATIVE"), [1], 1, 0
        else:
            window = (window + [h])[-cfg.confirmation_window:]
            in_w = sum(window)
            if h:
                count += 1
                misses = 0
                if status == "COASTING" or (status == "TENTATIVE" and in_w >= cfg.confirmation_hits):
                    status = "CONFIRMED"
            else:
                misses += 1
                if status == "TENTATIVE":
                    if len(window) == cfg.confirmation_window and in_w < cfg.confirmation_hits:
                        status = "DROPPED"
                elif misses >= cfg.drop_after_misses:
                    status = "DROPPED"
                else:
                    status = "COASTING"
        out.append((status, count, misses))
        if status == "DROPPED":
            break
    return out


def test_lifecycle_windows_match_fold(spark):
    rng = random.Random(3)
    for cfg in (FusionConfig(), FusionConfig(2, 3, 3), FusionConfig(1, 1, 2), FusionConfig(3, 6, 2)):
        rows, expect = [], {}
        for t in range(60):
            hits = [1] + [int(rng.random() < 0.55) for _ in range(rng.randint(0, 14))]
            rows += [(t, i, bool(h)) for i, h in enumerate(hits)]
            expect[t] = _fold(hits, cfg)
        df = spark.createDataFrame(rows, "track_id long, tick long, hit boolean")
        got = {}
        for r in track_lifecycle(df, cfg).orderBy("track_id", "tick").collect():
            got.setdefault(r["track_id"], []).append((r["status"], r["hit_count"], r["consecutive_misses"]))
        assert got == expect


def _simulate(records, lateness, flush, as_of):
    """Event simulation of the flush loop: fixed grid, ticks in order, LATE when not after the last."""
    out, last, pending = {}, None, list(records)
    t = 0
    while pending and t <= as_of:
        ready = sorted({r[1] for r in pending if r[2] <= t and r[1] + lateness <= t})
        for tick in ready:
            late = last is not None and tick <= last
            for r in [r for r in pending if r[1] == tick and r[2] <= t]:
                out[r[0]] = "LATE" if late else "FUSED"
            pending = [r for r in pending if not (r[1] == tick and r[2] <= t)]
            if not late:
                last = tick
        t += flush
    for r in pending:
        out[r[0]] = "PENDING"
    return out


def test_outcomes_match_simulation(spark):
    rng = random.Random(11)
    recs = []
    for i in range(300):
        tick = rng.randint(1, 40) * 1000
        recs.append((i, tick, tick - rng.randint(0, 900) + rng.choice([0, 0, 0, rng.randint(0, 9000)])))
    expect = _simulate(recs, 2000, 500, 30000)
    df = spark.createDataFrame([(i, t, a) for i, t, a in recs], "id long, t long, a long").select(
        "id", F.timestamp_millis("t").alias("tick"), F.timestamp_millis("a").alias("arrived_at"))
    got = classify_outcomes(df, as_of=F.timestamp_millis(F.lit(30000)), lateness="2 seconds", flush="500 ms")
    assert {r["id"]: r["outcome"] for r in got.collect()} == expect


def _key(df):
    return sorted((r["track_id"], r["state_at"], r["status"], round(r["east_m"], 6), r["hit_count"])
                  for r in df.select("track_id", "state_at", "status", "east_m", "hit_count").collect())


def test_region_split_equals_one_run(spark):
    d = events_as_detections(spark, SF_SMALL).filter(F.col("observed_at") < "2024-01-08")
    one = _key(build_tracks(d, "1 minute", region=ONE_REGION))
    split = _key(build_tracks_by_region(d, "1 minute", cell_m=3000.0))
    assert one == split and len(one) > 0


def test_fleet_runs_in_many_regions(spark):
    from sensortracks.sources.testdata import events_as_fleet

    d = events_as_fleet(spark, "/root/testdata/sf0.01").filter(F.col("observed_at") < F.timestamp_seconds(F.lit(1_700_000_030)))
    split = build_tracks(d, "1 second")
    assert _key(split) == _key(build_tracks(d, "1 second", region=ONE_REGION))
    assert split.select("region").distinct().count() > 50


def test_space_time_split_breaks_at_gaps(spark):
    from sensortracks.operators.regions import split_space_time

    rows = [(1, 0.0, 0.0), (3, 50.0, 0.0), (9, 0.0, 0.0), (20, 0.0, 0.0), (3, 5000.0, 0.0), (25, 150.0, 0.0)]
    df = spark.createDataFrame(rows, "tick_ord long, e double, n double")
    got = {(r["tick_ord"], r["e"]): r["region"] for r in split_space_time(df, 100.0, 5).collect()}
    assert got[1, 0.0] == got[3, 50.0] and got[20, 0.0] == got[25, 150.0]
    assert len(set(got.values())) == 4


def test_shuffled_input_same_tracks(spark):
    d = events_as_detections(spark, SF_SMALL).filter(F.col("observed_at") < "2024-01-08")
    a = _key(build_tracks(d, "1 minute", region=ONE_REGION))
    b = _key(build_tracks(d.repartition(7).orderBy(F.rand(5)), "1 minute", region=ONE_REGION))
    assert a == b


def test_stream_equals_batch(spark):
    from sensortracks.sources.formats import stream_detections
    from sensortracks.streaming.stateful import stream_tracks

    d = events_as_detections(spark, SF_SMALL).filter(F.col("observed_at") < "2024-01-08")
    base = tempfile.mkdtemp(prefix="st-test-")
    rows = d.select(
        F.col("source_id").alias("sourceId"), F.col("source_type").alias("sourceType"),
        F.date_format("observed_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("observedAt"),
        F.date_format("received_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("receivedAt"),
        F.col("lat_deg").alias("latDeg"), F.col("lon_deg").alias("lonDeg"), F.col("alt_m").alias("altMeters"),
        F.col("speed_mps").alias("speedMps"), F.col("heading_deg").alias("headingDeg"),
        F.col("sigma_m").alias("positionSigmaMeters"), "attributes", "observed_at")
    cut = "2024-01-05"
    rows.filter(F.col("observed_at") < cut).drop("observed_at").write.json(base + "/in/a")
    rows.filter(F.col("observed_at") >= cut).drop("observed_at").write.json(base + "/in/b")
    stream = stream_detections(spark, base + "/in/*", max_files_per_trigger=1)
    final_file = F.input_file_name().contains("/in/b/")
    stream = stream.withColumn("final", F.lit(False))
    q = (stream_tracks(stream, "1 minute", "2 seconds").writeStream.format("parquet")
         .option("path", base + "/out").option("checkpointLocation", base + "/ck")
         .trigger(availableNow=True).start())
    q.awaitTermination(600)
    got = spark.read.parquet(base + "/out")
    batch = build_tracks(d, "1 minute", region=ONE_REGION)
    # everything but the still-open last tick is identical
    last = batch.agg(F.max("state_at")).first()[0]
    assert _key(got.filter(F.col("state_at") < last)) == _key(batch.filter(F.col("state_at") < last))
    del final_file


def test_stream_survives_restart(spark):
    """Stop the stream after the first half of the files, restart it on the same
    checkpoint with the rest: the result equals one batch run."""
    from sensortracks.sources.formats import stream_detections
    from sensortracks.streaming.stateful import stream_tracks

    d = events_as_detections(spark, SF_SMALL).filter(F.col("observed_at") < "2024-01-06")
    base = tempfile.mkdtemp(prefix="st-restart-")
    rows = d.select(
        F.col("source_id").alias("sourceId"), F.col("source_type").alias("sourceType"),
        F.date_format("observed_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("observedAt"),
        F.date_format("received_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("receivedAt"),
        F.col("lat_deg").alias("latDeg"), F.col("lon_deg").alias("lonDeg"), F.col("alt_m").alias("altMeters"),
        F.col("speed_mps").alias("speedMps"), F.col("heading_deg").alias("headingDeg"),
        F.col("sigma_m").alias("positionSigmaMeters"), "attributes", "observed_at")
    cut = "2024-01-03"

    def run():
        s = stream_detections(spark, base + "/in/*").withColumn("final", F.lit(False))
        q = (stream_tracks(s, "1 minute", "2 seconds").writeStream.format("parquet")
             .option("path", base + "/out").option("checkpointLocation", base + "/ck")
             .trigger(availableNow=True).start())
        q.awaitTermination(600)

    rows.filter(F.col("observed_at") < cut).drop("observed_at").write.json(base + "/in/a")
    run()
    first = spark.read.parquet(base + "/out").count()
    rows.filter(F.col("observed_at") >= cut).drop("observed_at").write.json(base + "/in/b")
    run()
    got = spark.read.parquet(base + "/out")
    batch = build_tracks(d, "1 minute", region=ONE_REGION)
    last = batch.agg(F.max("state_at")).first()[0]
    assert 0 < first < got.count()
    assert _key(got.filter(F.col("state_at") < last)) == _key(batch.filter(F.col("state_at") < last))


def test_assignment_equals_whole_groups(spark):
    """Splitting into components gives the matching that solving each tick whole gives."""
    import numpy as np

    from sensortracks.operators.assignment import solve_assignment
    from sensortracks.operators.associate import assign_pairs, gate_pairs
    from sensortracks.plans.tracking import gate_inputs

    tracks, dets = gate_inputs(spark, SF_SMALL)
    pairs = gate_pairs(tracks, dets, 9.21).cache()
    got = assign_pairs(pairs, ("tick_us",), 9.21).toPandas()
    want = []
    for tick, own in pairs.toPandas().groupby("tick_us"):
        m = own.pivot(index="track_id", columns="det_id", values="cost").fillna(np.inf).to_numpy()
        a = solve_assignment(m, 9.21)
        cost = sum(m[i, j] for i, j in enumerate(a) if j >= 0)
        want.append((tick, int((a >= 0).sum()), round(float(cost), 6)))
    have = got.groupby("tick_us")["cost"].agg(["count", "sum"]).reset_index()
    assert sorted(want) == sorted((t, int(n), round(float(c), 6)) for t, n, c in have.itertuples(index=False))
    assert not got.duplicated(["tick_us", "track_id"]).any() and not got.duplicated(["tick_us", "det_id"]).any()


def test_components_of_long_paths(spark):
    """A path of 1,000 nodes in random order, and one of 150, are one component each."""
    import random

    from sensortracks.operators.graph import connected_components

    nodes = list(range(1151))
    random.Random(2).shuffle(nodes)
    edges = [(nodes[i], nodes[i + 1]) for i in range(1150) if i != 999]
    got = {r["node"]: r["label"] for r in connected_components(
        spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert {got[x] for x in nodes[:1000]} == {min(nodes[:1000])}
    assert {got[x] for x in nodes[1000:]} == {min(nodes[1000:])}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0
