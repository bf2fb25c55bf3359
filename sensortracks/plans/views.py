"""Registered queries for track tables, health and evaluation (E, F)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sensortracks.operators import evaluate, health, tables
from sensortracks.plans import duck
from sensortracks.plans.ingest import DUCK_OUTCOMES, outcome_input
from sensortracks.plans.registry import r, register, us
from sensortracks.operators.ticks import classify_outcomes
from sensortracks.session import checkpoint_dir
from sensortracks.sources.testdata import (
    DUCK_HISTORY, ORIGIN, events_as_detections, events_as_history, events_as_stage_events)

_E, _N, _U = duck.enu("lat_deg", "lon_deg", "alt_m")
DUCK_HIST = DUCK_HISTORY.format(desc=duck.CANONICAL_DESC, tick=duck.tick_us("observed_at", 3_600_000_000),
                            entries=duck.attr_entries(), e=_E, n=_N)
_LAT, _LON, _ = duck.geodetic("east_m", "north_m", "0.0::DOUBLE")


@register("track_view", duck.with_det(f"""
SELECT session_id, track_id, state_us, {duck.rnd(_LAT, 7)} AS lat_deg, {duck.rnd(_LON, 7)} AS lon_deg, alt_m
FROM hist""", DUCK_HIST))
def q_track_view(spark, sf_dir):
    v = tables.track_view(events_as_history(spark, sf_dir), ORIGIN)
    return v.select("session_id", "track_id", us("state_at").alias("state_us"),
                    r("lat_deg", 7).alias("lat_deg"), r("lon_deg", 7).alias("lon_deg"), "alt_m")


@register("append_history", duck.with_det("SELECT session_id, track_id, state_us, status FROM hist", DUCK_HIST))
def q_append_history(spark, sf_dir):
    path = f"{checkpoint_dir(spark).rstrip('/')}/history-{uuid.uuid4().hex}"
    tables.append_history(tables.track_view(events_as_history(spark, sf_dir), ORIGIN), path)
    back = tables.read_history(spark, path)
    return back.select("session_id", "track_id", us("state_at").alias("state_us"), "status")


@register("track_history", duck.with_det("""
SELECT track_id, row_number() OVER (PARTITION BY track_id ORDER BY state_us, session_id) AS seq,
       state_us, session_id FROM hist""", DUCK_HIST))
def q_track_history(spark, sf_dir):
    h = tables.track_history(events_as_history(spark, sf_dir))
    return h.select("track_id", "seq", us("state_at").alias("state_us"),
                    "session_id")


DUCK_CURRENT = """cur AS (SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY session_id, track_id ORDER BY state_us DESC) AS rn FROM hist)
  WHERE rn = 1 AND status <> 'DROPPED')"""


@register("current_tracks", duck.with_det("SELECT session_id, track_id, status, state_us FROM cur",
                                          DUCK_HIST + ",\n" + DUCK_CURRENT))
def q_current(spark, sf_dir):
    c = tables.current_tracks(events_as_history(spark, sf_dir))
    return c.select("session_id", "track_id", "status", us("state_at").alias("state_us"))


_DELTAS = """deltas AS (
  SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY state_us) AS version, state_us,
         count(*) AS n_tracks, string_agg(track_id::VARCHAR, ',' ORDER BY track_id) AS track_ids
  FROM hist GROUP BY session_id, state_us)"""


@register("track_deltas", duck.with_det(
    "SELECT session_id, version, state_us AS tick_us, n_tracks, track_ids FROM deltas",
    DUCK_HIST + ",\n" + _DELTAS))
def q_deltas(spark, sf_dir):
    d = tables.track_deltas(events_as_history(spark, sf_dir))
    return d.select("session_id", "version", us("state_at").alias("tick_us"),
                    F.size("tracks").cast("long").alias("n_tracks"),
                    F.array_join(F.transform("tracks", lambda t: t["track_id"].cast("string")), ",")
                    .alias("track_ids"))


def track_events(spark, sf_dir):
    """Deltas of the derived history as a change feed: every 24th version is sent as a
    snapshot, every 10th (from 3) once more five places later (a stale copy)."""
    d = tables.track_deltas(events_as_history(spark, sf_dir))
    sess = F.substring("session_id", 2, 4).cast("long")
    base = d.withColumn("seq", sess * 1_000_000 + F.col("version") * 10) \
        .withColumn("snapshot", F.col("version") % 24 == 0)
    stale = base.filter(F.col("version") % 10 == 3).withColumn("seq", F.col("seq") + 55) \
        .withColumn("snapshot", F.lit(False))
    return base.unionByName(stale)


@register("apply_track_events", duck.with_det("""
SELECT h.track_id, h.status, h.state_us FROM (
  SELECT track_id, arg_max(status, seq) AS status, arg_max(state_us, seq) AS state_us FROM (
    SELECT a.seq, a.snapshot, h.track_id, h.status, h.state_us FROM acc a
    JOIN hist h ON h.session_id = a.session_id AND h.state_us = a.state_us
    WHERE a.seq > coalesce((SELECT max(seq) FROM acc WHERE snapshot), -1) AND NOT a.snapshot
  ) GROUP BY track_id
  UNION ALL
  SELECT h.track_id, h.status, h.state_us FROM acc a
    JOIN hist h ON h.session_id = a.session_id AND h.state_us = a.state_us
  WHERE a.seq = (SELECT max(seq) FROM acc WHERE snapshot)
    AND h.track_id NOT IN (
      SELECT h2.track_id FROM acc a2 JOIN hist h2 ON h2.session_id = a2.session_id AND h2.state_us = a2.state_us
      WHERE a2.seq > (SELECT max(seq) FROM acc WHERE snapshot) AND NOT a2.snapshot)
) h WHERE h.status <> 'DROPPED'""", DUCK_HIST + ",\n" + _DELTAS + """,
ev AS (
  SELECT session_id, version, state_us,
         substr(session_id, 2)::BIGINT * 1000000 + version * 10 AS seq, version % 24 = 0 AS snapshot FROM deltas
  UNION ALL
  SELECT session_id, version, state_us,
         substr(session_id, 2)::BIGINT * 1000000 + version * 10 + 55 AS seq, false AS snapshot
  FROM deltas WHERE version % 10 = 3),
lastsess AS (SELECT arg_max(session_id, seq) AS s FROM ev),
run AS (SELECT * FROM ev WHERE session_id = (SELECT s FROM lastsess)
        AND seq > coalesce((SELECT max(seq) FROM ev WHERE session_id <> (SELECT s FROM lastsess)), -1)),
acc AS (SELECT r.* FROM run r WHERE NOT EXISTS (SELECT 1 FROM run q WHERE q.seq < r.seq AND q.version > r.version))"""))
def q_apply_events(spark, sf_dir):
    ev = track_events(spark, sf_dir)
    cur = tables.apply_track_events(ev)
    return cur.select("track_id", "status", us("state_at").alias("state_us"))


@register("tracks_geojson", duck.with_det(f"""
SELECT session_id, track_id, 'T' || track_id::VARCHAR AS label, status,
       CASE WHEN n_types > 1 THEN 'FUSED' ELSE least_type END AS source_type, n_types AS source_count,
       {duck.rnd(_LAT, 7)} AS lat_deg, {duck.rnd(_LON, 7)} AS lon_deg
FROM cur""", DUCK_HIST + ",\n" + DUCK_CURRENT))
def q_geojson(spark, sf_dir):
    cur = tables.current_tracks(events_as_history(spark, sf_dir))
    v = tables.track_view(cur, ORIGIN)
    g = tables.tracks_geojson(v)
    return g.join(v.select("session_id", "track_id", "lat_deg", "lon_deg"), ["session_id", "track_id"]).select(
        "session_id", "track_id", "properties.label", "properties.status", "properties.sourceType",
        F.col("properties.sourceCount").cast("long").alias("source_count"),
        r("lat_deg", 7).alias("lat_deg"), r("lon_deg", 7).alias("lon_deg")
    ).withColumnRenamed("sourceType", "source_type")


@register("track_summary", duck.with_det("""
SELECT session_id, count(*) AS active, count(*) FILTER (WHERE status = 'CONFIRMED') AS confirmed
FROM cur GROUP BY session_id""", DUCK_HIST + ",\n" + DUCK_CURRENT))
def q_summary(spark, sf_dir):
    return tables.track_summary(tables.current_tracks(events_as_history(spark, sf_dir)))


_STAGES = """dl AS (
  SELECT *, make_timestamp(epoch_us(received_at) + 5000) AS arrived_at, true AS is_first FROM det
  UNION ALL
  SELECT *, make_timestamp(epoch_us(received_at) + 255000) AS arrived_at, false AS is_first FROM det
  WHERE event_id % 17 = 0),
stages AS (
  SELECT source_id, source_type, 'adapter' AS stage, NOT (source_type = 'error' AND event_id % 3 = 0) AS ok,
         received_at AS ev_at, NULL::TIMESTAMP AS rcv FROM dl WHERE is_first
  UNION ALL SELECT source_id, source_type, 'publish', NOT (source_type = 'error' AND event_id % 3 = 1),
         make_timestamp(epoch_us(received_at) + 1000), NULL FROM dl WHERE is_first
  UNION ALL SELECT source_id, source_type, 'consume', true, arrived_at, received_at FROM dl
  UNION ALL SELECT source_id, source_type, 'redeliver', true, arrived_at, NULL FROM dl WHERE NOT is_first
  UNION ALL SELECT source_id, source_type, 'late', true, make_timestamp(epoch_us(received_at) + 600000000), NULL
         FROM dl WHERE is_first AND event_id % 23 = 0
  UNION ALL SELECT 'WEATHER', 'WEATHER', 'enrichment', event_id % 50 <> 0,
         make_timestamp(epoch_us(received_at) + 2000), NULL FROM dl WHERE is_first AND event_id % 5 = 0
  UNION ALL SELECT source_id, source_type, 'circuit', true, make_timestamp(epoch_us(received_at) + 3000), NULL
         FROM dl WHERE is_first AND source_type = 'error' AND event_id % 97 = 0),
known AS (SELECT DISTINCT source_type, source_id FROM stages WHERE NOT ok OR stage <> 'enrichment'),
lastev AS (SELECT source_type, source_id, stage, arg_max(NOT ok, epoch_us(ev_at) * 2 + CASE WHEN ok THEN 0 ELSE 1 END) AS failing FROM stages
           WHERE NOT ok OR stage IN ('adapter', 'publish', 'enrichment') GROUP BY ALL),
deg AS (SELECT k.source_type, k.source_id, coalesce(bool_or(l.failing), false) AS degraded
        FROM known k LEFT JOIN lastev l USING (source_type, source_id) GROUP BY ALL),
hl AS (
  SELECT source_type, source_id,
    count(*) FILTER (WHERE stage = 'adapter' AND ok) AS adapter_received,
    count(*) FILTER (WHERE stage = 'publish' AND ok) AS published,
    count(*) FILTER (WHERE stage = 'consume' AND ok) AS consumed,
    count(*) FILTER (WHERE stage = 'redeliver' AND ok) AS redelivered,
    count(*) FILTER (WHERE stage = 'late' AND ok) AS late,
    count(*) FILTER (WHERE NOT ok) AS errors,
    count(*) FILTER (WHERE stage = 'circuit' AND ok) AS circuit_transitions,
    max(ev_at) FILTER (WHERE stage = 'consume' AND ok) AS last_message_at,
    min(ev_at) AS started_at
  FROM stages WHERE NOT ok OR stage <> 'enrichment' GROUP BY ALL)"""
_AS_OF = "2024-01-31 00:00:00"
_NOW = "2024-01-30 23:59:50"


@register("source_health", duck.with_det(f"""
SELECT hl.source_type, hl.source_id, adapter_received, published, consumed, redelivered, late, errors,
       circuit_transitions, epoch_us(last_message_at) AS last_message_us, epoch_us(started_at) AS started_us,
       {duck.rnd(f"consumed / greatest(1.0, (epoch_us(TIMESTAMP '{_AS_OF}') - epoch_us(started_at)) / 1e6)", 9)}
         AS message_rate, deg.degraded
FROM hl JOIN deg USING (source_type, source_id)""", _STAGES))
def q_health(spark, sf_dir):
    h = health.source_health(events_as_stage_events(spark, sf_dir), _AS_OF)
    return h.select("source_type", "source_id", "adapter_received", "published", "consumed", "redelivered",
                    "late", "errors", "circuit_transitions", us("last_message_at").alias("last_message_us"),
                    us("started_at").alias("started_us"), r("message_rate", 9).alias("message_rate"), "degraded")


@register("degraded_sources", duck.with_det("SELECT source_type, source_id, degraded FROM deg", _STAGES))
def q_degraded(spark, sf_dir):
    return health.degraded_sources(events_as_stage_events(spark, sf_dir))


@register("source_state", duck.with_det(f"""
SELECT source_type, source_id,
  CASE WHEN last_message_at IS NULL THEN 'waiting'
       WHEN epoch_us(TIMESTAMP '{_NOW}') - epoch_us(last_message_at) > 30000000 OR degraded THEN 'degraded'
       ELSE 'healthy' END AS state
FROM hl JOIN deg USING (source_type, source_id)""", _STAGES))
def q_state(spark, sf_dir):
    h = health.source_health(events_as_stage_events(spark, sf_dir), _AS_OF)
    return health.source_state(h, _NOW).select("source_type", "source_id", "state")


def _pct_sql(v: str) -> str:
    return (f"quantile_disc({v}, 0.5) AS p50, quantile_disc({v}, 0.95) AS p95, quantile_disc({v}, 0.99) AS p99, "
            f"max({v}) AS max, count({v}) AS samples")


@register("source_latency", duck.with_det(f"""
SELECT source_type, source_id, {_pct_sql('ms')} FROM (
  SELECT source_type, source_id, (epoch_us(ev_at) - epoch_us(rcv)) / 1000.0 AS ms FROM stages
  WHERE stage = 'consume' AND ok) WHERE ms >= 0 GROUP BY ALL""", _STAGES))
def q_source_latency(spark, sf_dir):
    return health.source_latency(events_as_stage_events(spark, sf_dir))


@register("latency_histogram", duck.with_det("""
SELECT source_type, source_id, round(CASE WHEN ms = 0 THEN 0.0 ELSE pow(2.0, ceil(round(log2(ms) * 4, 9)) / 4) END, 6) AS upper_ms,
       count(*) AS messages
FROM (SELECT source_type, source_id, (epoch_us(ev_at) - epoch_us(rcv)) / 1000.0 AS ms FROM stages
      WHERE stage = 'consume' AND ok) WHERE ms >= 0 GROUP BY ALL""", _STAGES))
def q_latency_histogram(spark, sf_dir):
    h = health.latency_histogram(events_as_stage_events(spark, sf_dir))
    return h.select("source_type", "source_id", r("upper_ms", 6).alias("upper_ms"), "messages")


_RANK_ERROR = 0.03  # of the sketch's k = 200: 1.65 % at 99 % confidence, twice over for the roll-up of all periods


@register("latency_sketches", duck.with_det("""
SELECT source_type, source_id, count(*) AS samples, true AS p50_near, true AS p95_near, true AS p99_near
FROM stages WHERE stage = 'consume' AND ok AND epoch_us(ev_at) >= epoch_us(rcv) GROUP BY ALL""", _STAGES))
def q_latency_sketches(spark, sf_dir):
    """Hourly sketches rolled up per source; is each quantile's true rank near the one asked for?"""
    stages = events_as_stage_events(spark, sf_dir)
    rolled = health.sketch_quantiles(health.merged_sketches(health.latency_sketches(stages), health.SOURCE))
    ms = (F.unix_micros("at") - F.unix_micros("received_at")) / F.lit(1000.0)
    values = stages.filter((F.col("stage") == "consume") & F.col("ok")).select(*health.SOURCE, ms.alias("ms")).filter("ms >= 0")
    counts = values.groupBy(*health.SOURCE, "ms").agg(F.count(F.lit(1)).alias("n")).join(rolled, health.SOURCE)
    near = []
    for q in (50, 95, 99):
        below = F.sum(F.when(F.col("ms") < F.col(f"p{q}"), F.col("n")).otherwise(0))
        upto = F.sum(F.when(F.col("ms") <= F.col(f"p{q}"), F.col("n")).otherwise(0))
        total = F.sum("n")
        near.append(((below <= (q / 100 + _RANK_ERROR) * total) & (upto >= (q / 100 - _RANK_ERROR) * total)).alias(f"p{q}_near"))
    return counts.groupBy(*health.SOURCE).agg(F.first("samples").alias("samples"), *near)


@register("latency_percentiles", duck.with_det(f"""
SELECT {_pct_sql('ms')} FROM (
  SELECT (epoch_us(ev_at) - epoch_us(rcv)) / 1000.0 AS ms FROM stages WHERE stage = 'consume' AND ok)
WHERE ms >= 0""", _STAGES))
def q_latency_pct(spark, sf_dir):
    s = events_as_stage_events(spark, sf_dir).filter((F.col("stage") == "consume") & F.col("ok"))
    ms = (F.unix_micros("at") - F.unix_micros("received_at")) / F.lit(1000.0)
    return health.nearest_rank(s.select(ms.alias("ms")).filter("ms >= 0"), "ms")


@register("end_to_end_latency", duck.with_det(f"""
SELECT {_pct_sql('ms')} FROM (SELECT (tick_us - received_us) / 1000.0 AS ms FROM outcomes WHERE outcome = 'FUSED')
WHERE ms >= 0""", DUCK_OUTCOMES))
def q_e2e(spark, sf_dir):
    out = classify_outcomes(outcome_input(spark, sf_dir), as_of="2024-01-30 12:00:00",
                            lateness="2 seconds", flush="500 ms")
    return health.end_to_end_latency(out)


def _truth_inputs(spark, sf_dir):
    d = events_as_detections(spark, sf_dir, keep_event_columns=True)
    pairs = d.select((F.col("user_id") % 60).alias("track_id"),
                     F.concat(F.lit("truth-"), (F.col("user_id") % 45).cast("string")).alias("truth")).distinct()
    truths = d.select(F.concat(F.lit("truth-"), (F.col("user_id") % 47).cast("string")).alias("truth")).distinct()
    return d, pairs, truths


_DUCK_TRUTH = """pairs AS (SELECT DISTINCT user_id % 60 AS track_id, 'truth-' || (user_id % 45)::VARCHAR AS truth FROM det),
truths AS (SELECT DISTINCT 'truth-' || (user_id % 47)::VARCHAR AS truth FROM det),
alltruth AS (SELECT truth FROM truths UNION SELECT truth FROM pairs),
integ AS (SELECT
  (SELECT count(*) FROM (SELECT track_id FROM pairs GROUP BY track_id HAVING count(DISTINCT truth) > 1)) AS impure_tracks,
  (SELECT count(*) FROM alltruth WHERE truth NOT IN (SELECT truth FROM pairs)) AS missing_truths,
  (SELECT count(*) FROM (SELECT truth FROM pairs GROUP BY truth HAVING count(DISTINCT track_id) > 1)) AS fragmented_truths),
red AS (SELECT (SELECT count(DISTINCT truth) FROM truths) AS truth_objects,
               (SELECT count(DISTINCT truth) FROM truths) * (SELECT count(DISTINCT source_type) FROM det) AS source_specific_tracks,
               (SELECT count(DISTINCT track_id) FROM pairs) AS fused_tracks)"""


@register("truth_integrity", duck.with_det("SELECT * FROM integ", _DUCK_TRUTH))
def q_integrity(spark, sf_dir):
    _, pairs, truths = _truth_inputs(spark, sf_dir)
    return evaluate.truth_integrity(pairs, truths)


@register("duplicate_reduction", duck.with_det("""
SELECT truth_objects, source_specific_tracks, fused_tracks,
       round(greatest(0.0, 1 - fused_tracks / source_specific_tracks) * 100, 3) AS reduction_percent FROM red""",
    _DUCK_TRUTH))
def q_reduction(spark, sf_dir):
    d, pairs, truths = _truth_inputs(spark, sf_dir)
    return evaluate.duplicate_reduction(pairs, truths, d.select("source_type"))


_DUCK_CREDIT = DUCK_HIST + """,
grp AS (SELECT *, row_number() OVER (PARTITION BY source_type, source_id, user_id, tick_us ORDER BY """ + \
    duck.CANONICAL_DESC + """) AS grn
        FROM (SELECT *, """ + duck.tick_us("observed_at", 3_600_000_000) + """ AS tick_us, """ + duck.attr_entries() + \
    """ AS attr_entries FROM det)),
reps AS (SELECT source_type, source_id, user_id, tick_us, event_id AS rep FROM grp WHERE grn = 1),
credited AS (SELECT g.event_id, g.received_at FROM grp g JOIN reps USING (source_type, source_id, user_id, tick_us)
             WHERE reps.rep IN (SELECT event_id FROM co1h))"""


def _credited(spark, sf_dir):
    d = events_as_detections(spark, sf_dir, keep_event_columns=True)
    d = d.withColumn("truth", F.concat(F.lit("u"), F.col("user_id").cast("string")))
    d = d.withColumn("tick", F.timestamp_micros(
        F.unix_micros("observed_at") - F.pmod(F.unix_micros("observed_at"), F.lit(3_600_000_000)) + 3_600_000_000))
    contrib = events_as_history(spark, sf_dir).select(F.explode("contributors").alias("c")).select(
        F.col("c.event_id").alias("event_id"))
    return d, evaluate.credit_observations(d, contrib, truth="truth", det_id="event_id", tick="tick")


@register("credit_observations", duck.with_det("SELECT event_id FROM credited", _DUCK_CREDIT))
def q_credit(spark, sf_dir):
    _, c = _credited(spark, sf_dir)
    return c.select("event_id")


@register("delivery_report", duck.with_det("""
SELECT (SELECT count(*) FROM det) AS input_messages, (SELECT count(*) FROM credited) AS latency_samples,
       round((SELECT count(*) FROM credited) / (SELECT count(*) FROM det), 4) AS delivery_ratio,
       round((SELECT count(*) FROM det) / greatest((epoch_us(max(received_at)) - epoch_us(min(received_at))) / 1e6, 1e-9), 3)
         AS throughput_per_second
FROM det""", _DUCK_CREDIT))
def q_delivery(spark, sf_dir):
    d, c = _credited(spark, sf_dir)
    return evaluate.delivery_report(d, c)


@register("acceptance", duck.with_det("""
SELECT len(f) = 0 AS passed, array_to_string(f, ',') AS failed_checks, len(g) = 0 AS passed_waived,
       array_to_string(g, ',') AS failed_waived, delivery_ratio, p99_ms, reduction_percent,
       impure_tracks, missing_truths, fragmented_truths
FROM (SELECT *, list_filter([
        CASE WHEN impure_tracks > 0 THEN 'impure_tracks' END,
        CASE WHEN missing_truths > 0 THEN 'missing_truths' END,
        CASE WHEN fragmented_truths > 0 THEN 'fragmented_truths' END,
        CASE WHEN delivery_ratio < 0.9 THEN 'delivery_ratio' END], lambda x: x IS NOT NULL) AS f, list_filter([
        CASE WHEN impure_tracks > 0 THEN 'impure_tracks' END,
        CASE WHEN missing_truths > 0 THEN 'missing_truths' END,
        CASE WHEN delivery_ratio < 0.5 THEN 'delivery_ratio' END,
        CASE WHEN reduction_percent < 80 THEN 'reduction_percent' END,
        CASE WHEN p99_ms > 1000 THEN 'p99_ms' END], lambda x: x IS NOT NULL) AS g
      FROM (SELECT round((SELECT count(*) FROM credited) / (SELECT count(*) FROM det), 4) AS delivery_ratio,
                   (SELECT quantile_disc(ms, 0.99) FROM (SELECT (epoch_us(ev_at) - epoch_us(rcv)) / 1000.0 AS ms
                    FROM stages WHERE stage = 'consume' AND ok) WHERE ms >= 0) AS p99_ms,
                   round(greatest(0.0, 1 - red.fused_tracks / red.source_specific_tracks) * 100, 3) AS reduction_percent,
                   integ.*
            FROM integ, red))""", _DUCK_CREDIT + ",\n" + _DUCK_TRUTH + ",\n" + _STAGES))
def q_acceptance(spark, sf_dir):
    """The strict verdict, and one with fragmentation waived and limits on p99 and reduction."""
    d, c = _credited(spark, sf_dir)
    _, pairs, truths = _truth_inputs(spark, sf_dir)
    rep = evaluate.delivery_report(d, c).select("delivery_ratio")
    integ = evaluate.truth_integrity(pairs, truths)
    reduction = evaluate.duplicate_reduction(pairs, truths, d.select("source_type"))
    report = (rep.withColumn("impure_tracks", integ.select("impure_tracks").scalar())
              .withColumn("missing_truths", integ.select("missing_truths").scalar())
              .withColumn("fragmented_truths", integ.select("fragmented_truths").scalar())
              .withColumn("reduction_percent", reduction.select("reduction_percent").scalar())
              .withColumn("p99_ms", q_latency_pct(spark, sf_dir).select("p99").scalar())
              .withColumn("receiver_errors", F.lit(0)))
    strict = evaluate.acceptance(report, min_delivery_ratio=0.9).withColumnsRenamed(
        {"passed": "strict", "failures": "strict_failures"})
    out = evaluate.acceptance(strict, min_delivery_ratio=0.5, max_p99_ms=1000, min_reduction_percent=80,
                              allow_fragmentation=True)
    return out.select(F.col("strict").alias("passed"), F.array_join("strict_failures.check", ",").alias("failed_checks"),
                      F.col("passed").alias("passed_waived"), F.array_join("failures.check", ",").alias("failed_waived"),
                      "delivery_ratio", "p99_ms", "reduction_percent", "impure_tracks", "missing_truths", "fragmented_truths")
