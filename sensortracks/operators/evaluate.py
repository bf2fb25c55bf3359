"""Run evaluation against ground truth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensortracks.functions.order import canonical_key


def credit_observations(detections: DataFrame, contributor_ids: DataFrame, truth: str = "truth",
                        det_id: str = "det_id", tick: str = "tick") -> DataFrame:
    """detections credited as delivered.

    Detections are grouped by (source_type, source_id, truth, tick); the greatest
    in canonical order represents its group; when the representative shows up
    as a track contributor (``contributor_ids``: one ``det_id`` column), every
    member of its group is credited.
    """
    group = ["source_type", "source_id", truth, tick]
    reps = detections.groupBy(*group).agg(
        F.max(F.struct(canonical_key().alias("_k"), F.col(det_id).alias("_id")))["_id"].alias("_rep"))
    seen = contributor_ids.select(F.col(det_id).alias("_rep")).distinct()
    credited = reps.join(seen, "_rep", "left_semi").drop("_rep")
    return detections.join(credited, group, "left_semi")


def delivery_report(inputs: DataFrame, credited: DataFrame, time_col: str = "received_at") -> DataFrame:
    """F8: delivery ratio, sample count and producer throughput (one row)."""
    a = inputs.agg(F.count(F.lit(1)).alias("input_messages"),
                   ((F.unix_micros(F.max(time_col)) - F.unix_micros(F.min(time_col))) / F.lit(1e6))
                   .alias("production_seconds"))
    a = a.withColumn("latency_samples", credited.select(F.count(F.lit(1))).scalar())
    return a.select(
        "input_messages", "latency_samples",
        F.round(F.col("latency_samples") / F.col("input_messages"), 4).alias("delivery_ratio"),
        F.round(F.col("input_messages") / F.greatest(F.col("production_seconds"), F.lit(1e-9)), 3)
        .alias("throughput_per_second"))


def duplicate_reduction(track_truths: DataFrame, truths: DataFrame, source_types: DataFrame) -> DataFrame:
    """max(0, 1 - fused tracks / (truth objects x source types)) x 100 (one row)."""
    out = (track_truths.agg(F.count_distinct("track_id").alias("fused_tracks"))
           .withColumn("truth_objects", truths.select(F.count_distinct("truth")).scalar())
           .withColumn("source_types", source_types.select(F.count_distinct("source_type")).scalar()))
    per_source = F.col("truth_objects") * F.col("source_types")
    red = F.when(per_source > 0, F.greatest(F.lit(0.0), 1 - F.col("fused_tracks") / per_source) * 100)
    return out.select("truth_objects", per_source.alias("source_specific_tracks"), "fused_tracks",
                      F.round(red, 3).alias("reduction_percent"))


def truth_integrity(track_truths: DataFrame, truths: DataFrame) -> DataFrame:
    """impure tracks (> 1 truth), missing truths (no track), fragmented truths (> 1 track)."""
    impure = (track_truths.groupBy("track_id").agg(F.count_distinct("truth").alias("_n"))
              .agg(F.count_if(F.col("_n") > 1).alias("impure_tracks")))
    per_truth = track_truths.groupBy("truth").agg(F.count_distinct("track_id").alias("_t"))
    all_truths = truths.select("truth").unionByName(track_truths.select("truth")).distinct()
    joined = all_truths.join(per_truth, "truth", "left")
    return impure.select(
        "impure_tracks",
        joined.select(F.count_if(F.col("_t").isNull())).scalar().alias("missing_truths"),
        joined.select(F.count_if(F.col("_t") > 1)).scalar().alias("fragmented_truths"))


def acceptance(report: DataFrame, min_delivery_ratio: float = 1.0, max_p99_ms: float | None = None,
               min_reduction_percent: float | None = None, allow_fragmentation: bool = False) -> DataFrame:
    """``passed`` and the failed checks of a one-row report, each with its value and limit.

    Report columns: delivery_ratio, p99_ms, reduction_percent, impure_tracks,
    missing_truths, fragmented_truths, receiver_errors.  ``failures`` is an array of
    struct(check, value, limit); a value that is missing where a limit is set fails.
    """
    below, above = (lambda v, x: v < x), (lambda v, x: v > x)
    checks = [("receiver_errors", above, 0), ("impure_tracks", above, 0), ("missing_truths", above, 0)]
    if not allow_fragmentation:
        checks.append(("fragmented_truths", above, 0))
    checks.append(("delivery_ratio", below, min_delivery_ratio))
    if min_reduction_percent is not None:
        checks.append(("reduction_percent", below, min_reduction_percent))
    if max_p99_ms is not None:
        checks.append(("p99_ms", above, max_p99_ms))
    found = []
    for name, out, limit in checks:
        value = F.col(name).cast("double")
        found.append(F.when(value.isNull() | out(value, F.lit(float(limit))), F.struct(
            F.lit(name).alias("check"), value.alias("value"), F.lit(float(limit)).alias("limit"))))
    failures = F.array_compact(F.array(*found))
    return report.withColumn("failures", failures).withColumn("passed", F.size("failures") == 0)
