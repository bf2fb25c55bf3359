"""Source health and latency.

Input is a stage-event log: ``source_id, source_type, stage, ok, at`` (plus
``received_at`` on consume rows).  Stages: adapter, publish, consume,
redeliver, late, enrichment, circuit.  An ok event at adapter / publish /
enrichment clears that stage's failure; an error at any stage sets it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sensortracks.operators.common import floor_to, interval_us
from sensortracks.schema import SILENT_AFTER_SECONDS

BLOCK = 1000.0  # width of a block of values when ranks are counted

CLEARING_STAGES = ("adapter", "publish", "enrichment")
# ok events that do not create a source entry on their own (a recovery)
RECOVERY_ONLY = ("enrichment",)
SOURCE = ["source_type", "source_id"]


def _creates_source() -> Column:
    return ~F.col("ok") | ~F.col("stage").isin(*RECOVERY_ONLY)


def degraded_sources(stages: DataFrame) -> DataFrame:
    """per source, degraded while any stage's latest set/clear event is an error."""
    relevant = stages.filter(~F.col("ok") | F.col("stage").isin(*CLEARING_STAGES))
    per_stage = relevant.groupBy(*SOURCE, "stage").agg(
        F.max_by(~F.col("ok"), F.struct("at", (~F.col("ok")).alias("_err"))).alias("_failing"))
    out = per_stage.groupBy(*SOURCE).agg(F.bool_or("_failing").alias("degraded"))
    known = stages.filter(_creates_source()).select(*SOURCE).distinct()
    return known.join(out, SOURCE, "left").select(*SOURCE, F.coalesce("degraded", F.lit(False)).alias("degraded"))


def source_health(stages: DataFrame, as_of) -> DataFrame:
    """seven counters, last message time, message rate and degraded flag per source."""
    st, ok = F.col("stage"), F.col("ok")
    as_of_col = as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp")
    agg = stages.filter(_creates_source()).groupBy(*SOURCE).agg(
        F.count_if((st == "adapter") & ok).alias("adapter_received"),
        F.count_if((st == "publish") & ok).alias("published"),
        F.count_if((st == "consume") & ok).alias("consumed"),
        F.count_if((st == "redeliver") & ok).alias("redelivered"),
        F.count_if((st == "late") & ok).alias("late"),
        F.count_if(~ok).alias("errors"),
        F.count_if((st == "circuit") & ok).alias("circuit_transitions"),
        F.max(F.when((st == "consume") & ok, F.col("at"))).alias("last_message_at"),
        F.min("at").alias("started_at"))
    secs = (F.unix_micros(as_of_col) - F.unix_micros("started_at")) / F.lit(1e6)
    out = agg.withColumn("message_rate", F.col("consumed") / F.greatest(F.lit(1.0), secs))
    return out.join(degraded_sources(stages), SOURCE, "left")


def source_state(health: DataFrame, now) -> DataFrame:
    """waiting (no message yet) / degraded (silent > 30 s or degraded) / healthy."""
    now_col = now if isinstance(now, Column) else F.lit(now).cast("timestamp")
    silent = (F.unix_micros(now_col) - F.unix_micros("last_message_at")) > F.lit(SILENT_AFTER_SECONDS * 1_000_000)
    state = (F.when(F.col("last_message_at").isNull(), F.lit("waiting"))
             .when(silent | F.col("degraded"), F.lit("degraded")).otherwise(F.lit("healthy")))
    return health.withColumn("state", state)


def nearest_rank(df: DataFrame, value: str, group: list[str] | None = None,
                 quantiles=(0.5, 0.95, 0.99)) -> DataFrame:
    """nearest-rank percentiles (the value at place ceil(q n)) and max, by counting.

    Values are counted, the counts summed by blocks of ``BLOCK``; a running sum over
    the blocks finds the block that holds each rank, and only that block's values
    are looked at.  Nothing ever holds all values of a group.
    """
    keys = group or ["_all"]
    rows = df.filter(F.col(value).isNotNull())
    rows = rows if group else rows.withColumn("_all", F.lit(0))
    counts = rows.groupBy(*keys, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n")).withColumn(
        "_b", F.floor(F.col("_v") / BLOCK))
    totals = counts.groupBy(*keys).agg(F.sum("_n").alias("samples"), F.max("_v").alias("max"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    blocks = counts.groupBy(*keys, "_b").agg(F.sum("_n").alias("_bn")).withColumn(
        "_before", F.coalesce(F.sum("_bn").over(before), F.lit(0)))
    ranks = totals.select(*keys, F.explode(F.array(*[F.struct(
        F.lit(q).alias("q"), F.greatest(F.lit(1), F.ceil(F.lit(q) * F.col("samples") - 1e-9)).alias("k"))
        for q in quantiles])).alias("r")).select(*keys, "r.q", "r.k")
    holds = ranks.join(blocks, keys).filter((F.col("_before") < F.col("k")) & (F.col("k") <= F.col("_before") + F.col("_bn")))
    upto = Window.partitionBy(*keys, "q").orderBy("_v")
    found = counts.join(holds.select(*keys, "_b", "q", "k", "_before"), [*keys, "_b"]).withColumn(
        "_upto", F.col("_before") + F.sum("_n").over(upto)).filter(F.col("_upto") >= F.col("k"))
    values = found.groupBy(*keys).agg(*[
        F.min(F.when(F.col("q") == q, F.col("_v"))).alias("p" + f"{q * 100:g}".replace(".", "_")) for q in quantiles])
    return values.join(totals, keys).select(*group if group else [], *values.columns[len(keys):], "max", "samples")


def source_latency(stages: DataFrame, quantiles=(0.5, 0.95, 0.99)) -> DataFrame:
    """consumedAt - receivedAt per source in ms (negatives left out)."""
    ok = stages.filter((F.col("stage") == "consume") & F.col("ok"))
    ms = (F.unix_micros("at") - F.unix_micros("received_at")) / F.lit(1000.0)
    return nearest_rank(ok.select(*SOURCE, ms.alias("latency_ms")).filter("latency_ms >= 0"),
                        "latency_ms", SOURCE, quantiles)


def latency_histogram(stages: DataFrame, per_octave: int = 4) -> DataFrame:
    """consumed messages per source and latency bucket (negatives left out).

    Buckets grow by the ``per_octave``-th root of two; ``upper_ms`` is a bucket's
    upper bound (0 for latencies of 0), inclusive.
    """
    ok = stages.filter((F.col("stage") == "consume") & F.col("ok"))
    ms = (F.unix_micros("at") - F.unix_micros("received_at")) / F.lit(1000.0)
    # rounded, so that a latency on a bound is not moved by the last bit of its logarithm
    step = F.ceil(F.round(F.log2("ms") * per_octave, 9))
    upper = F.when(F.col("ms") == 0, F.lit(0.0)).otherwise(F.pow(F.lit(2.0), step / per_octave))
    return (ok.select(*SOURCE, ms.alias("ms")).filter("ms >= 0").withColumn("upper_ms", upper)
            .groupBy(*SOURCE, "upper_ms").agg(F.count(F.lit(1)).alias("messages")))


def latency_sketches(stages: DataFrame, every="1 hour", k: int = 200) -> DataFrame:
    """F4 as a mergeable distribution: one quantile sketch per source and period of ``received_at``.

    (source_type, source_id, period, sketch): KLL sketches of consumedAt - receivedAt in ms (negatives left out), a
    few kilobytes each however many messages.  ``k`` sets the rank error, about 1.65 % at 200.  They are
    aggregated map-side, and ``merged_sketches`` rolls them up to any coarser group without the messages.
    """
    ok = stages.filter((F.col("stage") == "consume") & F.col("ok"))
    ms = (F.unix_micros("at") - F.unix_micros("received_at")) / F.lit(1000.0)
    period = F.timestamp_micros(floor_to(F.unix_micros("received_at"), interval_us(every)))
    return (ok.select(*SOURCE, period.alias("period"), ms.alias("ms")).filter("ms >= 0")
            .groupBy(*SOURCE, "period").agg(F.kll_sketch_agg_double("ms", k).alias("sketch")))


def merged_sketches(sketches: DataFrame, group: list[str], k: int = 200) -> DataFrame:
    """``group`` and the sketch of all values below it; merging keeps the error bound of ``k``."""
    return sketches.groupBy(*group).agg(F.kll_merge_agg_double("sketch", k).alias("sketch"))


def sketch_quantiles(sketches: DataFrame, quantiles=(0.5, 0.95, 0.99)) -> DataFrame:
    """The columns of ``sketches`` but the sketch, with p50, p95 ... and the number of samples."""
    return sketches.select(*[c for c in sketches.columns if c != "sketch"], *[
        F.kll_sketch_get_quantile_double("sketch", F.lit(q)).alias("p" + f"{q * 100:g}".replace(".", "_"))
        for q in quantiles], F.kll_sketch_get_n_double("sketch").alias("samples"))


def end_to_end_latency(outcomes: DataFrame, quantiles=(0.5, 0.95, 0.99)) -> DataFrame:
    """tick - receivedAt in ms over FUSED records (negatives left out)."""
    ms = (F.unix_micros("tick") - F.unix_micros("received_at")) / F.lit(1000.0)
    fused = outcomes.filter(F.col("outcome") == "FUSED").select(ms.alias("latency_ms"))
    return nearest_rank(fused.filter("latency_ms >= 0"), "latency_ms", None, quantiles)
