"""Track tables and change feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sensortracks.functions import geo
from sensortracks.functions.order import sort_structs
from sensortracks.operators.common import running_max_before
from sensortracks.session import checkpoint_dir
from sensortracks.streaming.ledger import LedgerTable

HISTORY_COLUMNS = ["session_id", "track_id", "status", "state_at", "last_observed_at", "lat_deg", "lon_deg",
                   "alt_m", "ve_mps", "vn_mps", "hit_count", "consecutive_misses", "contributors"]


def track_view(snapshots: DataFrame, origin, session_id=None) -> DataFrame:
    """ENU snapshots (up = 0) -> lat/lon; altitude = first known contributor altitude."""
    g = geo.to_geodetic(F.col("east_m"), F.col("north_m"), F.lit(0.0), origin)
    alts = F.filter(F.transform("contributors", lambda c: c["alt_m"]), lambda a: a.isNotNull())
    sess = F.col("session_id") if "session_id" in snapshots.columns else F.lit(session_id).cast("string")
    return snapshots.select(
        sess.alias("session_id"), "track_id", "status", "state_at", "last_observed_at",
        g.lat_deg.alias("lat_deg"), g.lon_deg.alias("lon_deg"), F.try_element_at(alts, F.lit(1)).alias("alt_m"),
        "ve_mps", "vn_mps", F.col("hit_count").cast("int").alias("hit_count"),
        F.col("consecutive_misses").cast("int").alias("consecutive_misses"), "contributors")


def append_history(df: DataFrame, path: str) -> None:
    """Append rows to the history table, partitioned by day of state_at."""
    (df.withColumn("state_date", F.to_date("state_at"))
     .write.mode("append").partitionBy("state_date").parquet(path))


def history_table(spark, path: str) -> LedgerTable:
    """E2 for streams: the history as a ledger table; ``history_table(...).writer()`` goes to ``foreachBatch``.

    Every batch counts once, and its files are sorted by track, so that E3 skips most of a batch.
    """
    return LedgerTable(spark, path, ["track_id", "state_at"])


def read_history(spark, path: str) -> DataFrame:
    """The history at ``path``, however it was written."""
    rows = history_table(spark, path).read()
    return spark.read.parquet(path) if rows is None else rows.drop("batch_id")


def track_history(df: DataFrame, track_id: int | None = None) -> DataFrame:
    """Rows by state_at across sessions, with their position ``seq`` in their track's history.

    One track's history if ``track_id`` is given (pushed down as a filter), else all.
    """
    if track_id is not None:
        df = df.filter(F.col("track_id") == F.lit(track_id))
    w = Window.partitionBy("track_id").orderBy("state_at", "session_id")
    return df.withColumn("seq", F.row_number().over(w).cast("long"))


def current_tracks(df: DataFrame) -> DataFrame:
    """Latest row per (session, track), without DROPPED tracks.

    ``max_by`` aggregates map-side, so a long-lived track is never gathered whole.
    """
    cols = [c for c in df.columns if c not in ("session_id", "track_id")]
    latest = (df.groupBy("session_id", "track_id")
              .agg(F.max_by(F.struct(*cols), F.col("state_at")).alias("_r")))
    return latest.select("session_id", "track_id", *[F.col("_r." + c).alias(c) for c in cols]) \
        .filter(F.col("status") != "DROPPED")


def latest_rows(snapshots: DataFrame) -> DataFrame:
    """E4 for streams: the latest row of every (session, track), DROPPED ones too, as a streaming
    aggregate for update mode: a micro-batch puts out the tracks that changed."""
    cols = [c for c in snapshots.columns if c not in ("session_id", "track_id")]
    latest = snapshots.groupBy("session_id", "track_id").agg(F.max_by(F.struct(*cols), F.col("state_at")).alias("_r"))
    return latest.select("session_id", "track_id", *[F.col("_r." + c).alias(c) for c in cols])


def current_table(spark, path: str) -> LedgerTable:
    """E4 for streams: the sink of ``latest_rows``; a later batch's row replaces the earlier ones of its track."""
    return LedgerTable(spark, path, ["session_id", "track_id"])


def read_current(spark, path: str) -> DataFrame | None:
    """The live tracks after the last batch that ``current_table`` has; None before the first."""
    rows = current_table(spark, path).read()
    if rows is None:
        return None
    cols = [c for c in rows.columns if c not in ("session_id", "track_id", "batch_id")]
    last = rows.groupBy("session_id", "track_id").agg(F.max_by(F.struct(*cols), "batch_id").alias("_r"))
    return last.select("session_id", "track_id", *[F.col("_r." + c).alias(c) for c in cols]).filter("status <> 'DROPPED'")


def track_delta_rows(df: DataFrame) -> DataFrame:
    """E5 as rows: every track row with the ``version`` of its (session, tick), 1, 2, ... per session.

    Only the distinct ticks are numbered; track rows are joined to their number.
    """
    ticks = df.select("session_id", "state_at").distinct()
    w = Window.partitionBy("session_id").orderBy("state_at")
    numbers = ticks.withColumn("version", F.row_number().over(w).cast("long"))
    return df.join(numbers, ["session_id", "state_at"])


def track_deltas(df: DataFrame) -> DataFrame:
    """E5 for a sink: one change event per (session, tick) with its track rows nested."""
    cols = [c for c in df.columns if c != "session_id"]
    return track_delta_rows(df).groupBy("session_id", "version", "state_at").agg(sort_structs(
        F.collect_list(F.struct(*cols)), "track_id").alias("tracks")).select(
        "session_id", "version", F.lit(False).alias("snapshot"), "state_at", "tracks")


def apply_track_events(events: DataFrame, seq: str = "seq") -> DataFrame:
    """Fold snapshot and delta events into the current track set.

    Events are taken in ``seq`` (arrival) order.  A session change clears all, an
    event older than the newest seen version is ignored, a snapshot replaces the
    set, DROPPED deletes, anything else upserts.  Closed form: keep the final run
    of the last session; drop stale events by a running max of versions; start
    from the last accepted snapshot; apply the latest later delta per track.
    """
    # All decisions are made on the small per-event table (no track payloads);
    # payloads are joined back only for the events that survive.
    checkpoint_dir(events.sparkSession)
    events = events.checkpoint(eager=True)
    meta = events.select("session_id", seq, "version", "snapshot")
    last_session = meta.select(F.max_by("session_id", F.col(seq))).scalar()
    last_change = meta.filter(F.col("session_id") != last_session).select(F.max(seq)).scalar()
    run = meta.filter(F.col("session_id") == last_session).filter(
        last_change.isNull() | (F.col(seq) > last_change))
    run = running_max_before(run, seq, "version", "_maxv")
    accepted = run.filter(F.col("_maxv").isNull() | (F.col("version") >= F.col("_maxv")))
    snap = accepted.filter("snapshot").select(F.max(seq)).scalar()
    wanted = accepted.filter((F.col(seq) == snap) | (~F.col("snapshot") & (snap.isNull() | (F.col(seq) > snap))))
    payload = events.join(wanted.select(seq), seq, "left_semi")
    base = (payload.filter(F.col(seq) == snap).select(F.explode("tracks").alias("t"))
            .select("t.*").filter(F.col("status") != "DROPPED"))
    deltas = (payload.filter(~F.col("snapshot") & (snap.isNull() | (F.col(seq) > snap)))
              .select(seq, F.explode("tracks").alias("t")))
    latest = deltas.groupBy(F.col("t.track_id").alias("track_id")).agg(F.max_by("t", F.col(seq)).alias("t"))
    upserts = latest.select("t.*")
    kept = base.join(upserts.select("track_id"), "track_id", "left_anti")
    return kept.unionByName(upserts.filter(F.col("status") != "DROPPED"))


def tracks_geojson(df: DataFrame) -> DataFrame:
    """One GeoJSON point feature per track (label, status, source mix)."""
    types = F.array_sort(F.array_distinct(F.transform("contributors", lambda c: c["source_type"])))
    kind = (F.when(F.size(types) > 1, F.lit("FUSED"))
            .otherwise(F.coalesce(F.try_element_at(types, F.lit(1)), F.lit("UNKNOWN"))))
    props = F.struct(F.col("track_id").alias("trackId"), F.concat(F.lit("T"), F.col("track_id")).alias("label"),
                     F.col("status").alias("status"), kind.alias("sourceType"),
                     F.size(types).alias("sourceCount"))
    feature = F.struct(F.lit("Feature").alias("type"),
                       F.struct(F.lit("Point").alias("type"),
                                F.array("lon_deg", "lat_deg").alias("coordinates")).alias("geometry"),
                       props.alias("properties"))
    session = [c for c in ("session_id",) if c in df.columns]
    return df.select(*session, "track_id", props.alias("properties"), F.to_json(feature).alias("feature"))


def track_summary(current: DataFrame) -> DataFrame:
    """Active and confirmed track counts per session."""
    return current.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("active"),
        F.count_if(F.col("status") == "CONFIRMED").alias("confirmed"))
