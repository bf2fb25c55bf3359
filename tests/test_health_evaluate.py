"""Latency sketches against exact percentiles; acceptance limits and the waiver; the rule on null attributes."""

import numpy as np
from pyspark.sql import functions as F

from sensortracks.operators import evaluate, health
from sensortracks.operators.validate import validate_detections
from sensortracks.plans.ingest import raw_event_rows


def stage_rows(spark, ms, hours):
    rows = spark.createDataFrame([("A", "a", int(h), float(x)) for h, x in zip(hours, ms, strict=True)],
                                 "source_type string, source_id string, h int, ms double")
    received = F.timestamp_micros(F.col("h") * F.lit(3_600_000_000))
    return rows.select("source_type", "source_id", F.lit("consume").alias("stage"), F.lit(True).alias("ok"),
                       received.alias("received_at"),
                       F.timestamp_micros(F.unix_micros(received) + (F.col("ms") * 1000).cast("long")).alias("at"))


def rank_gap(values, got, q):
    """How far the share of values up to ``got`` is from q; 0 where ties at it reach across."""
    low, high = (values < got).mean(), (values <= got).mean()
    return max(0.0, low - q, q - high)


def test_sketches_roll_up_within_their_bound(spark):
    rng = np.random.default_rng(7)
    ms, hours = np.round(rng.lognormal(4, 1.5, 20_000), 3), rng.integers(0, 30, 20_000)
    stages = stage_rows(spark, ms, hours)
    hourly = health.latency_sketches(stages).cache()
    assert hourly.count() == 30
    direct = health.latency_sketches(stages, every="365 days")
    for sketches in (health.merged_sketches(hourly, health.SOURCE), direct):
        row = health.sketch_quantiles(sketches).first()
        assert row["samples"] == len(ms)
        for q, name in ((0.5, "p50"), (0.95, "p95"), (0.99, "p99")):
            assert rank_gap(ms, row[name], q) <= 0.0165
    exact = health.source_latency(stages).first()
    assert rank_gap(ms, exact["p95"], 0.95) == 0
    daily = health.merged_sketches(hourly.withColumn("day", F.to_date("period")), [*health.SOURCE, "day"])
    both = health.sketch_quantiles(health.merged_sketches(daily, health.SOURCE)).first()
    assert both["samples"] == len(ms) and rank_gap(ms, both["p50"], 0.5) <= 0.0165
    hourly.unpersist()


def test_sketches_leave_out_negatives_and_keep_small_groups(spark):
    stages = stage_rows(spark, [5.0, -3.0, 7.0], [0, 0, 1])
    out = health.sketch_quantiles(health.latency_sketches(stages)).orderBy("period").collect()
    assert [(r["samples"], r["p50"], r["p99"]) for r in out] == [(1, 5.0, 5.0), (1, 7.0, 7.0)]
    assert health.latency_sketches(stages.limit(0)).count() == 0


def verdict(spark, values, **limits):
    names = ("delivery_ratio", "p99_ms", "reduction_percent", "impure_tracks", "missing_truths", "fragmented_truths",
             "receiver_errors")
    report = spark.createDataFrame([values], ", ".join(f"{n} double" for n in names))
    row = evaluate.acceptance(report, **limits).first()
    return row["passed"], [tuple(f) for f in row["failures"]]


def test_acceptance_limits_and_waiver(spark):
    good = (1.0, 900.0, 50.0, 0.0, 0.0, 0.0, 0.0)
    limits = {"max_p99_ms": 900, "min_reduction_percent": 50}
    assert verdict(spark, good, **limits) == (True, [])
    assert verdict(spark, (1.0, 900.5, 49.0, 0.0, 0.0, 0.0, 0.0), **limits) == (
        False, [("reduction_percent", 49.0, 50.0), ("p99_ms", 900.5, 900.0)])
    assert verdict(spark, (1.0, None, None, 0.0, 0.0, 0.0, 0.0), **limits) == (
        False, [("reduction_percent", None, 50.0), ("p99_ms", None, 900.0)])
    split = (1.0, None, None, 0.0, 0.0, 2.0, 0.0)
    assert verdict(spark, split) == (False, [("fragmented_truths", 2.0, 0.0)])
    assert verdict(spark, split, allow_fragmentation=True) == (True, [])
    assert verdict(spark, (0.9, None, None, 1.0, 3.0, 0.0, 4.0)) == (False, [
        ("receiver_errors", 4.0, 0.0), ("impure_tracks", 1.0, 0.0), ("missing_truths", 3.0, 0.0),
        ("delivery_ratio", 0.9, 1.0)])


def test_null_attribute_values_are_rejected(spark):
    raw = raw_event_rows(spark, "/root/testdata/sf0.001")
    _, rejected = validate_detections(raw)
    with_null = raw.filter(F.col("attributes")["k"].isNull())
    assert with_null.count() > 0
    found = rejected.filter(F.array_contains("reasons", "attribute_null"))
    assert {r[0] for r in found.select("event_id").collect()} == {r[0] for r in with_null.select("event_id").collect()}
