"""Track status per tick from its hit/miss sequence, with window functions only.

Rules (defaults H=3, W=5, D=5): a track is born on a hit, TENTATIVE (CONFIRMED
if H = 1).  It confirms on the first hit where its last W outcomes hold >= H
hits.  A tentative track drops on the first miss with a full window holding
< H hits; it never coasts.  A confirmed track coasts on a miss, is confirmed
again on a hit, and drops when its run of misses reaches D.  Rows after the
drop are removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sensortracks.schema import FusionConfig


def track_lifecycle(df: DataFrame, config: FusionConfig | None = None, track: str = "track_id",
                    tick: str = "tick", hit: str = "hit") -> DataFrame:
    """Adds status, hit_count and consecutive_misses; the first row is the birth."""
    cfg = config or FusionConfig()
    H, W, D = cfg.confirmation_hits, cfg.confirmation_window, cfg.drop_after_misses
    w = Window.partitionBy(track).orderBy(tick)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    h = F.col(hit).cast("int")
    x = (df.withColumn("_i", F.row_number().over(w))
         .withColumn("_h", F.when(F.col("_i") == 1, F.lit(1)).otherwise(h))
         .withColumn("_win", F.sum("_h").over(w.rowsBetween(-(W - 1), 0)))
         .withColumn("_last_hit", F.max(F.when(F.col("_h") == 1, F.col("_i"))).over(upto))
         .withColumn("_run", F.col("_i") - F.col("_last_hit")))
    confirm_i = F.when((F.col("_h") == 1) & (F.col("_win") >= H), F.col("_i"))
    tent_drop_i = F.when((F.col("_h") == 0) & (F.col("_i") >= W) & (F.col("_win") < H), F.col("_i"))
    whole = Window.partitionBy(track)
    x = (x.withColumn("_c", F.min(confirm_i).over(whole))
         .withColumn("_td", F.min(F.when(tent_drop_i < F.coalesce(F.col("_c"), F.lit(1 << 62)),
                                         tent_drop_i)).over(whole)))
    conf_drop_i = F.when(F.col("_c").isNotNull() & (F.col("_i") > F.col("_c")) & (F.col("_run") >= D),
                         F.col("_i"))
    x = x.withColumn("_cd", F.min(conf_drop_i).over(whole))
    drop_at = F.coalesce(F.col("_td"), F.col("_cd"))
    status = (F.when(F.col("_i") == drop_at, F.lit("DROPPED"))
              .when(F.col("_c").isNull() | (F.col("_i") < F.col("_c")), F.lit("TENTATIVE"))
              .when(F.col("_h") == 1, F.lit("CONFIRMED"))
              .otherwise(F.lit("COASTING")))
    x = x.filter(drop_at.isNull() | (F.col("_i") <= drop_at))
    return (x.withColumn("status", status)
            .withColumn("hit_count", F.sum("_h").over(upto).cast("int"))
            .withColumn("consecutive_misses", F.col("_run").cast("int"))
            .drop("_i", "_h", "_win", "_last_hit", "_run", "_c", "_td", "_cd"))
