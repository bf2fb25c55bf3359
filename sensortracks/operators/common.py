"""Small building blocks shared by several operators."""

from __future__ import annotations

import datetime as _dt
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_UNITS_US = {
    "microsecond": 1, "millisecond": 1000, "ms": 1000, "second": 1_000_000, "s": 1_000_000,
    "minute": 60_000_000, "min": 60_000_000, "hour": 3_600_000_000, "h": 3_600_000_000,
    "day": 86_400_000_000, "d": 86_400_000_000,
}


def interval_us(interval) -> int:
    """Microseconds of an interval given as seconds, timedelta or text ('6 hours')."""
    if isinstance(interval, _dt.timedelta):
        us = interval // _dt.timedelta(microseconds=1)
    elif isinstance(interval, (int, float)):
        us = int(round(interval * 1_000_000))
    else:
        m = re.fullmatch(r"\s*([0-9.]+)\s*([a-z]+)\s*", str(interval).lower())
        unit = m and (m.group(2) if m.group(2) in _UNITS_US else m.group(2).rstrip("s"))
        if not m or unit not in _UNITS_US:
            raise ValueError(f"cannot read interval {interval!r}")
        us = int(round(float(m.group(1)) * _UNITS_US[unit]))
    if us <= 0:
        raise ValueError("interval must be positive")
    return us


def micros(col) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.unix_micros(c)


def floor_to(col_us: Column, step_us: int) -> Column:
    """Largest multiple of ``step_us`` <= value (floor, also before 1970)."""
    return col_us - F.pmod(col_us, F.lit(step_us))


def floor_div(col_long: Column, n: int) -> Column:
    """Integer floor division (exact, also for negative values)."""
    return ((col_long - F.pmod(col_long, F.lit(n))) / F.lit(n)).cast("long")


def ceil_div(col_long: Column, n: int) -> Column:
    return floor_div(col_long + F.lit(n - 1), n)


def running_max_before(df: DataFrame, order_col: str, value_col: str, out_col: str,
                       block: int = 1 << 16) -> DataFrame:
    """Max of ``value_col`` over all rows with a smaller ``order_col`` (a scan).

    Two-level so no single task sees the whole table: a window inside each block
    of ``block`` consecutive keys, plus the max of all earlier blocks taken from a
    per-block summary (one row per block).  ``order_col`` must be unique.
    """
    b = F.floor(F.col(order_col) / F.lit(block)).cast("long")
    with_block = df.withColumn("_blk", b)
    summary = with_block.groupBy("_blk").agg(F.max(value_col).alias("_blk_max"))
    summary = summary.withColumn(
        "_before_blk",
        F.max("_blk_max").over(Window.orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)))
    inner = Window.partitionBy("_blk").orderBy(order_col).rowsBetween(Window.unboundedPreceding, -1)
    out = (with_block.withColumn("_in_blk", F.max(value_col).over(inner))
           .join(summary.select("_blk", "_before_blk"), "_blk", "left"))
    return out.withColumn(out_col, F.greatest("_in_blk", "_before_blk")).drop(
        "_blk", "_in_blk", "_before_blk")


def running_sum_before(df: DataFrame, order_col: str, value_col: str, out_col: str,
                       block: int = 1 << 16) -> DataFrame:
    """Sum of ``value_col`` over all rows with a smaller ``order_col`` (exclusive scan)."""
    b = F.floor(F.col(order_col) / F.lit(block)).cast("long")
    with_block = df.withColumn("_blk", b)
    summary = with_block.groupBy("_blk").agg(F.sum(value_col).alias("_blk_sum"))
    summary = summary.withColumn(
        "_before_blk",
        F.coalesce(F.sum("_blk_sum").over(
            Window.orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inner = Window.partitionBy("_blk").orderBy(order_col).rowsBetween(Window.unboundedPreceding, -1)
    out = (with_block.withColumn("_in_blk", F.coalesce(F.sum(value_col).over(inner), F.lit(0)))
           .join(summary.select("_blk", "_before_blk"), "_blk", "left"))
    return out.withColumn(out_col, F.col("_in_blk") + F.col("_before_blk")).drop(
        "_blk", "_in_blk", "_before_blk")


def dense_ordinal(df: DataFrame, col: str, out_col: str, block: int) -> DataFrame:
    """1-based rank of each distinct numeric value of ``col``, joined back.

    Only the distinct values are shuffled and scanned (two-level, see
    ``running_sum_before``); ``block`` is a width in units of ``col``.
    """
    distinct = df.select(col).distinct().withColumn("_one", F.lit(1))
    ranks = running_sum_before(distinct, col, "_one", "_before", block=block)
    mapping = ranks.select(col, (F.col("_before") + 1).cast("long").alias(out_col))
    return df.join(mapping, col, "left")


def with_ordinal(df: DataFrame, order: list[Column], out_col: str = "ordinal",
                 eager_checkpoint: bool = True) -> DataFrame:
    """Rows in a total order with their 1-based position, computed distributed.

    A range-partitioned sort, numbered in the same pass by (partition, row in
    partition), is checkpointed to the shared folder; per-partition counts, one row
    a partition, give the offsets.  Rows are shuffled once.
    """
    from sensortracks.session import checkpoint_dir

    checkpoint_dir(df.sparkSession)
    ordered = df.orderBy(*order).withColumn("_id", F.monotonically_increasing_id())
    if eager_checkpoint:
        ordered = ordered.checkpoint(eager=True)
    ordered = ordered.withColumn("_part", F.shiftright("_id", 33))
    counts = ordered.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.withColumn("_off", F.coalesce(F.sum("_n").over(
        Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return (ordered.join(F.broadcast(counts.select("_part", "_off")), "_part")
            .withColumn(out_col, (F.col("_id").bitwiseAND((1 << 33) - 1) + 1 + F.col("_off")).cast("long"))
            .drop("_part", "_id", "_off"))
