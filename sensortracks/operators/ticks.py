"""Event time, delivery and de-duplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensortracks.functions.order import ORDER_COLUMNS, canonical_key, canonical_order, identity
from sensortracks.operators.common import ceil_div, floor_to, interval_us, micros, running_max_before, with_ordinal
from sensortracks.schema import DETECTION_COLUMNS


def tick_of(observed_at, interval) -> Column:
    """End of the tumbling window holding ``observed_at``; a boundary opens the next."""
    step = interval_us(interval)
    return F.timestamp_micros(floor_to(micros(observed_at), step) + F.lit(step))


def assign_tick(df: DataFrame, interval, col: str = "observed_at",
                out: str = "tick") -> DataFrame:
    """Add the tick column."""
    return df.withColumn(out, tick_of(F.col(col), interval))


def dedup_deliveries(df: DataFrame, key=("topic", "partition", "offset"),
                     arrival: str = "arrived_at") -> tuple[DataFrame, DataFrame]:
    """(first copy of every delivery id, per-id redelivery counts).

    The first copy is the earliest arrival (ties: canonical order). It is found by
    an aggregation with map-side partial aggregation, so a delivery id repeated a
    huge number of times never lands whole in one task.
    """
    key = list(key)
    # the ordering key holds the detection's own fields; only the others ride along
    payload = [c for c in df.columns if c not in (*key, *ORDER_COLUMNS, "attributes")]
    best = F.min(F.struct(F.col(arrival).alias("_arr"), canonical_key().alias("_ord"),
                          *[F.col(c) for c in payload]))
    agg = df.groupBy(*key).agg(best.alias("_first"), F.count(F.lit(1)).alias("_copies"))
    first = agg.select(*key, *[F.col("_first." + c).alias(c) for c in payload],
                       *[F.col("_first._ord." + c).alias(c) for c in ORDER_COLUMNS if c not in key],
                       F.map_from_entries("_first._ord.attr_entries").alias("attributes"))
    first = first.select(*df.columns)
    redelivered = (agg.filter(F.col("_copies") > 1)
                   .select(*key, F.col("_first._ord.source_type").alias("source_type"),
                           F.col("_first._ord.source_id").alias("source_id"),
                           (F.col("_copies") - 1).alias("redelivered")))
    return first, redelivered


def dedup_stream(df: DataFrame, delay: str, key=("topic", "partition", "offset"),
                 arrival: str = "arrived_at") -> DataFrame:
    """C2 for streams: the first copy of every delivery id that the stream meets, across micro-batches and restarts.

    ``delay`` bounds how long after the first copy another may arrive (in time of ``arrival``);
    ids are forgotten after it, so state holds the ids of that span only.  Rows that are
    themselves older than the latest arrival by more than ``delay`` are dropped by the watermark.
    """
    return df.withWatermark(arrival, delay).dropDuplicatesWithinWatermark(list(key))


def classify_outcomes(df: DataFrame, as_of, lateness, flush, grid_start=None,
                      tick: str = "tick", arrival: str = "arrived_at") -> DataFrame:
    """PENDING / FUSED / LATE of every (de-duplicated) delivered record.

    A tick is processed by the first flush at or after both its arrival and
    tick + lateness; flushes run on a fixed grid (``grid_start`` + k * ``flush``).
    A record is LATE when an equal or later tick was committed by an earlier flush,
    PENDING when its flush is after ``as_of``.  Only one row per flush takes part
    in the scan; the result is joined back on the flush number.
    """
    late_us, flush_us = interval_us(lateness), interval_us(flush)
    start_us = 0 if grid_start is None else F.unix_micros(F.lit(grid_start).cast("timestamp"))
    ready = F.greatest(micros(arrival), micros(tick) + F.lit(late_us)) - F.lit(start_us)
    flush_no = ceil_div(ready, flush_us)
    with_flush = df.withColumn("flush_no", flush_no).withColumn("_tick_us", micros(tick))
    per_flush = with_flush.groupBy("flush_no").agg(F.max("_tick_us").alias("_flush_max"))
    per_flush = running_max_before(per_flush, "flush_no", "_flush_max", "_committed_before")
    as_of_us = F.unix_micros(F.lit(as_of).cast("timestamp")) if not isinstance(as_of, Column) \
        else F.unix_micros(as_of)
    flush_at = F.lit(start_us) + F.col("flush_no") * F.lit(flush_us)
    out = with_flush.join(per_flush.select("flush_no", "_committed_before"), "flush_no", "left")
    outcome = (F.when(flush_at > as_of_us, F.lit("PENDING"))
               .when(F.col("_tick_us") <= F.col("_committed_before"), F.lit("LATE"))
               .otherwise(F.lit("FUSED")))
    return (out.withColumn("outcome", outcome)
            .withColumn("flushed_at", F.timestamp_micros(flush_at))
            .drop("_tick_us", "_committed_before"))


def coalesce_detections(df: DataFrame, tick: str = "tick") -> DataFrame:
    """C4: per (tick, source, identity) keep the greatest row in canonical order.

    Rows without an identity all stay.  The greatest row is a ``max`` over a
    struct that orders like the canonical order, so the shuffle carries partial
    aggregates, not every duplicate.
    """
    keyed = df.withColumn("_identity", identity())
    extra = [c for c in df.columns if c not in DETECTION_COLUMNS and c != tick]
    loose = keyed.filter(F.col("_identity").isNull()).drop("_identity")
    # the ordering key holds the detection's own fields; only the others ride along
    best = F.max(F.struct(canonical_key().alias("_ord"), *[F.col(c) for c in extra]))
    kept = (keyed.filter(F.col("_identity").isNotNull())
            .groupBy(tick, "source_type", "source_id", "_identity")
            .agg(best.alias("_b"))
            .select(tick, *[F.col("_b." + c).alias(c) for c in extra],
                    *[F.col("_b._ord." + c).alias(c) for c in ORDER_COLUMNS],
                    F.map_from_entries("_b._ord.attr_entries").alias("attributes")))
    return loose.unionByName(kept.select(*loose.columns))


def order_detections(df: DataFrame, ordinal: str | None = None) -> DataFrame:
    """The deterministic total order of detections (a range-partitioned sort).

    ``ordinal`` names a column for each row's place in it, from 1 (see ``with_ordinal``).
    """
    return with_ordinal(df, canonical_order(), ordinal) if ordinal else df.orderBy(*canonical_order())
