"""Contributors of each track as of each tick."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def contributors_as_of(assignments: DataFrame, spine: DataFrame | None = None,
                       track: str = "track_id", tick: str = "tick",
                       payload: list[str] | None = None) -> DataFrame:
    """Per (track, tick): the latest assigned detection of every source ever seen.

    ``assignments``: one row per (track, tick, source) assignment.  Contributors
    never expire and are sorted by (source_type, source_id); ``last_observed_at``
    is the running maximum of observed_at.  ``spine`` lists the (track, tick)
    rows to report (default: the ticks with assignments).  Work is bounded by
    spine rows x sources seen per track; the as-of step is a per-(track, source)
    window, not a join against every earlier row.
    """
    payload = payload or [c for c in assignments.columns
                          if c not in (track, tick, "source_type", "source_id")]
    if spine is None:
        spine = assignments.select(track, tick).distinct()
    srcs = assignments.groupBy(track, "source_type", "source_id").agg(F.min(tick).alias("_first"))
    grid = spine.join(srcs, track).filter(F.col(tick) >= F.col("_first")).drop("_first")
    rows = assignments.select(track, tick, "source_type", "source_id",
                              F.struct(*[F.col(c) for c in payload]).alias("_det"))
    u = grid.join(rows, [track, tick, "source_type", "source_id"], "left")
    w = (Window.partitionBy(track, "source_type", "source_id").orderBy(tick)
         .rowsBetween(Window.unboundedPreceding, 0))
    u = u.withColumn("_latest", F.last("_det", ignorenulls=True).over(w))
    per_tick = u.groupBy(track, tick).agg(F.sort_array(F.collect_list(
        F.struct("source_type", "source_id", "_latest"))).alias("_c"))
    obs = assignments.groupBy(track, tick).agg(F.max("observed_at").alias("_obs"))
    out = per_tick.join(obs, [track, tick], "left")
    wt = Window.partitionBy(track).orderBy(tick).rowsBetween(Window.unboundedPreceding, 0)
    return out.select(
        track, tick,
        F.transform("_c", lambda c: F.struct(c["source_type"].alias("source_type"),
                                             c["source_id"].alias("source_id"),
                                             *[c["_latest"][p].alias(p) for p in payload]))
        .alias("contributors"),
        F.max("_obs").over(wt).alias("last_observed_at"))
