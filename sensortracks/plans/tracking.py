"""Registered queries for association and tracking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensortracks.functions import geo
from sensortracks.functions.order import identity
from sensortracks.operators.associate import assign_pairs, assignment_faults, gate_pairs, priced_pairs
from sensortracks.operators.common import dense_ordinal
from sensortracks.operators.contributors import contributors_as_of
from sensortracks.operators.lifecycle import track_lifecycle
from sensortracks.operators.motion import kalman_filter
from sensortracks.operators.regions import build_tracks_by_region, split_regions
from sensortracks.operators.ticks import assign_tick, coalesce_detections
from sensortracks.operators.tracker import ONE_REGION, build_tracks, number_tracks, replay_tracks
from sensortracks.plans import duck
from sensortracks.plans.registry import r, register, us
from sensortracks.schema import INITIAL_VELOCITY_VARIANCE, FusionConfig
from sensortracks.sources.testdata import (
    DUCK_FLEET, FLEET_STEP_US, ORIGIN, events_as_detections, events_as_fleet, events_as_history)

TRACK_TICK = "6 hours"
TRACK_TICK_US = 6 * 3600 * 1_000_000
FLAGSHIP_TICK = "1 minute"
GATE = 9.21
_E, _N, _U = duck.enu("lat_deg", "lon_deg", "alt_m")


def enu_detections(spark, sf_dir, interval=TRACK_TICK) -> DataFrame:
    d = assign_tick(events_as_detections(spark, sf_dir), interval)
    p = geo.to_enu(F.col("lat_deg"), F.col("lon_deg"), F.col("alt_m"), ORIGIN)
    return d.select("*", F.unix_micros("tick").alias("tick_us"), p.east_m.alias("e"), p.north_m.alias("n"))


def gate_inputs(spark, sf_dir):
    d = enu_detections(spark, sf_dir)
    tracks = d.filter(F.col("source_type") == "view").select(
        "tick_us", F.col("event_id").alias("track_id"), "e", "n", (F.col("sigma_m") ** 2).alias("p"))
    dets = d.filter(F.col("source_type") != "view").select(
        "tick_us", F.col("event_id").alias("det_id"), "e", "n", F.col("sigma_m").alias("sigma"))
    return tracks, dets


_DUCK_ENU = f"""enu AS (SELECT *, {duck.tick_us('observed_at', TRACK_TICK_US)} AS tick_us,
                 {_E} AS e, {_N} AS n FROM det)"""


@register("gate_pairs", duck.with_det(f"""
SELECT t.tick_us, t.event_id AS track_id, d.event_id AS det_id,
       {duck.rnd('((d.e - t.e) * (d.e - t.e) + (d.n - t.n) * (d.n - t.n)) / (t.sigma_m * t.sigma_m + d.sigma_m * d.sigma_m)', 6)} AS cost
FROM enu t JOIN enu d ON t.tick_us = d.tick_us
WHERE t.source_type = 'view' AND d.source_type <> 'view'
  AND ((d.e - t.e) * (d.e - t.e) + (d.n - t.n) * (d.n - t.n)) / (t.sigma_m * t.sigma_m + d.sigma_m * d.sigma_m) <= {GATE}""",
    _DUCK_ENU))
def q_gate_pairs(spark, sf_dir):
    tracks, dets = gate_inputs(spark, sf_dir)
    return gate_pairs(tracks, dets, GATE).select("tick_us", "track_id", "det_id", r("cost", 6).alias("cost"))


@register("assign_pairs")
def q_assign_pairs(spark, sf_dir):
    tracks, dets = gate_inputs(spark, sf_dir)
    pairs = gate_pairs(tracks, dets, GATE)
    return assign_pairs(pairs, ("tick_us",), GATE, sides=(tracks, dets)).select(
        "tick_us", "track_id", "det_id", r("cost", 6).alias("cost"))


@register("assignment_proof", duck.with_det(f"""
SELECT t.tick_us, count(*) AS n_pairs, count(DISTINCT t.event_id) AS n_tracks, count(DISTINCT d.event_id) AS n_dets,
       0::BIGINT AS faults
FROM enu t JOIN enu d ON t.tick_us = d.tick_us
WHERE t.source_type = 'view' AND d.source_type <> 'view'
  AND ((d.e - t.e) * (d.e - t.e) + (d.n - t.n) * (d.n - t.n)) / (t.sigma_m * t.sigma_m + d.sigma_m * d.sigma_m) <= {GATE}
GROUP BY t.tick_us""", _DUCK_ENU))
def q_assignment_proof(spark, sf_dir):
    """Prices of every gated pair prove each tick's assignment one-to-one, largest and cheapest: no faults."""
    tracks, dets = gate_inputs(spark, sf_dir)
    return assignment_faults(priced_pairs(gate_pairs(tracks, dets, GATE), ("tick_us",), GATE, sides=(tracks, dets)))


def _kalman_sql() -> str:
    q = 4.0
    dt = "((b.t - k.t) / 1000000.0)"
    pp = f"(k.p + {dt} * k.pv * 2 + {dt} * {dt} * k.v + {q} * {dt} * {dt} * {dt} * {dt} / 4)"
    ppv = f"(k.pv + {dt} * k.v + {q} * {dt} * {dt} * {dt} / 2)"
    pvv = f"(k.v + {q} * {dt} * {dt})"
    pe, pn = f"(k.se + k.sve * {dt})", f"(k.sn + k.svn * {dt})"
    s = f"({pp} + b.sigma_m * b.sigma_m)"
    kp, kv = f"({pp} / {s})", f"({ppv} / {s})"
    return f"""
kf AS (
  SELECT user_id, source_type, seq, t, e AS se, n AS sn, ve0 AS sve, vn0 AS svn,
         sigma_m * sigma_m AS p, 0.0::DOUBLE AS pv, 400.0::DOUBLE AS v
  FROM base WHERE seq = 1
  UNION ALL
  SELECT b.user_id, b.source_type, b.seq, b.t,
         {pe} + {kp} * (b.e - {pe}), {pn} + {kp} * (b.n - {pn}),
         k.sve + {kv} * (b.e - {pe}), k.svn + {kv} * (b.n - {pn}),
         greatest({pp} - {kp} * {pp}, 1e-9), {ppv} - {kp} * {ppv}, greatest({pvv} - {kv} * {ppv}, 1e-9)
  FROM kf k JOIN base b ON b.user_id = k.user_id AND b.source_type = k.source_type AND b.seq = k.seq + 1)"""


@register("kalman_filter", "WITH RECURSIVE " + duck.with_det(f"""
SELECT user_id, source_type, seq, t AS t_us, {duck.rnd('se')} AS east_m, {duck.rnd('sn')} AS north_m,
       {duck.rnd('sve', 4)} AS ve_mps, {duck.rnd('svn', 4)} AS vn_mps
FROM kf""", f"""base AS (
  SELECT user_id, source_type, epoch_us(observed_at) AS t, sigma_m, {_E} AS e, {_N} AS n,
         CASE WHEN speed_mps IS NOT NULL AND heading_deg IS NOT NULL THEN speed_mps * sin(radians(heading_deg)) ELSE 0.0 END AS ve0,
         CASE WHEN speed_mps IS NOT NULL AND heading_deg IS NOT NULL THEN speed_mps * cos(radians(heading_deg)) ELSE 0.0 END AS vn0,
         row_number() OVER (PARTITION BY user_id, source_type ORDER BY observed_at, received_at) AS seq
  FROM det),""" + _kalman_sql())[len("WITH "):])
def q_kalman(spark, sf_dir):
    d = events_as_detections(spark, sf_dir, keep_event_columns=True)
    k = kalman_filter(d, ["user_id", "source_type"], accel_sigma=2.0, origin=ORIGIN)
    return k.select("user_id", "source_type", "seq", "t_us", r("east_m").alias("east_m"),
                    r("north_m").alias("north_m"), r("ve_mps", 4).alias("ve_mps"),
                    r("vn_mps", 4).alias("vn_mps"))


def hit_table(spark, sf_dir, horizon: int = 5) -> DataFrame:
    """Per user: its hourly ticks plus the next ``horizon`` global ticks after each."""
    d = assign_tick(events_as_detections(spark, sf_dir, keep_event_columns=True), "1 hour")
    d = d.select("user_id", F.unix_micros("tick").alias("tick_us"))
    ticks = dense_ordinal(d.select("tick_us").distinct(), "tick_us", "ord", block=3_600_000_000 * 4096)
    seen = d.distinct().join(ticks, "tick_us")
    cand = seen.select("user_id", "ord", F.explode(F.sequence(F.lit(0), F.lit(horizon))).alias("j"))
    cand = cand.select("user_id", (F.col("ord") + F.col("j")).alias("ord")).distinct().join(ticks, "ord")
    return (cand.join(seen.select("user_id", "tick_us", F.lit(True).alias("hit")), ["user_id", "tick_us"], "left")
            .select(F.col("user_id").alias("track_id"), "tick_us", F.coalesce("hit", F.lit(False)).alias("hit")))


def _lifecycle_sql(cfg: FusionConfig) -> str:
    H, W, D = cfg.confirmation_hits, cfg.confirmation_window, cfg.drop_after_misses
    mask = (1 << W) - 1
    nh = f"(((k.hist << 1) | r.h) & {mask})"
    cnt = f"bit_count({nh})"
    birth = "'CONFIRMED'" if H == 1 else "'TENTATIVE'"
    status = f"""CASE WHEN r.h = 1 THEN
        CASE WHEN k.status = 'COASTING' OR (k.status = 'TENTATIVE' AND {cnt} >= {H}) THEN 'CONFIRMED' ELSE k.status END
      ELSE CASE WHEN k.status = 'TENTATIVE' THEN
             CASE WHEN least(k.hlen + 1, {W}) = {W} AND {cnt} < {H} THEN 'DROPPED' ELSE 'TENTATIVE' END
           WHEN k.misses + 1 >= {D} THEN 'DROPPED' ELSE 'COASTING' END END"""
    return f"""
lc AS (
  SELECT track_id, i, tick_us, {birth} AS status, 1::BIGINT AS hist, 1 AS hlen, 1 AS hits, 0 AS misses
  FROM rows WHERE i = 1
  UNION ALL
  SELECT r.track_id, r.i, r.tick_us, {status}, {nh}, least(k.hlen + 1, {W}), k.hits + r.h,
         CASE WHEN r.h = 1 THEN 0 ELSE k.misses + 1 END
  FROM lc k JOIN rows r ON r.track_id = k.track_id AND r.i = k.i + 1
  WHERE k.status <> 'DROPPED')"""


_DUCK_HITS = f"""hd AS (SELECT DISTINCT user_id, {duck.tick_us('observed_at', 3_600_000_000)} AS tick_us FROM det),
gt AS (SELECT tick_us, row_number() OVER (ORDER BY tick_us) AS ord FROM (SELECT DISTINCT tick_us FROM hd)),
seen AS (SELECT hd.user_id, hd.tick_us, gt.ord FROM hd JOIN gt USING (tick_us)),
cand AS (SELECT DISTINCT s.user_id, gt.tick_us FROM seen s JOIN gt ON gt.ord BETWEEN s.ord AND s.ord + 5),
rows AS (SELECT c.user_id AS track_id, c.tick_us,
                CASE WHEN s.user_id IS NOT NULL THEN 1 ELSE 0 END AS h,
                row_number() OVER (PARTITION BY c.user_id ORDER BY c.tick_us) AS i
         FROM cand c LEFT JOIN seen s ON s.user_id = c.user_id AND s.tick_us = c.tick_us),"""


@register("track_lifecycle", "WITH RECURSIVE " + duck.with_det("""
SELECT track_id, tick_us, status, hits::INTEGER AS hit_count, misses::INTEGER AS consecutive_misses FROM lc""",
    _DUCK_HITS + _lifecycle_sql(FusionConfig()))[len("WITH "):])
def q_lifecycle(spark, sf_dir):
    h = hit_table(spark, sf_dir)
    out = track_lifecycle(h, FusionConfig(), tick="tick_us")
    return out.select("track_id", "tick_us", "status", "hit_count", "consecutive_misses")


def _track_rows(t: DataFrame, metres: int = 3, speeds: int = 4) -> DataFrame:
    return t.select(
        "track_id", "status", us("state_at").alias("state_us"), us("last_observed_at").alias("last_observed_us"),
        r("east_m", metres).alias("east_m"), r("north_m", metres).alias("north_m"),
        r("ve_mps", speeds).alias("ve_mps"), r("vn_mps", speeds).alias("vn_mps"), F.col("hit_count").cast("long").alias("hit_count"),
        F.col("consecutive_misses").cast("long").alias("consecutive_misses"),
        F.array_join(F.transform("contributors", lambda c: F.concat_ws(":", c["source_type"], c["source_id"])),
                     "|").alias("contributors"))


def _fleet_sql(tick: str, where: str) -> str:
    """Tracks of the fleet mapping: as vehicles never meet, a user is one track at a time.

    The recursion walks a user's ticks (its own and the next ``horizon`` global ones)
    with filter and lifecycle state; after a drop the next report starts a new life.
    """
    cfg = FusionConfig()
    H, W, D, q = cfg.confirmation_hits, cfg.confirmation_window, cfg.drop_after_misses, cfg.accel_sigma ** 2
    dead = "k.status IN ('DROPPED', 'GONE')"
    nh = f"(((k.hist << 1) | r.h) & {(1 << W) - 1})"
    status = f"""CASE WHEN {dead} THEN CASE WHEN r.h = 1 THEN 'TENTATIVE' ELSE 'GONE' END
      WHEN r.h = 1 THEN
        CASE WHEN k.status = 'COASTING' OR (k.status = 'TENTATIVE' AND bit_count({nh}) >= {H}) THEN 'CONFIRMED' ELSE k.status END
      WHEN k.status = 'TENTATIVE' THEN
        CASE WHEN least(k.hlen + 1, {W}) = {W} AND bit_count({nh}) < {H} THEN 'DROPPED' ELSE 'TENTATIVE' END
      WHEN k.misses + 1 >= {D} THEN 'DROPPED' ELSE 'COASTING' END"""
    dt = "((r.tick_us - k.tick_us) / 1000000.0)"
    pp = f"(k.p + {dt} * k.pv * 2 + {dt} * {dt} * k.v + {q} * {dt} * {dt} * {dt} * {dt} / 4)"
    ppv = f"(k.pv + {dt} * k.v + {q} * {dt} * {dt} * {dt} / 2)"
    pvv = f"(k.v + {q} * {dt} * {dt})"
    pe, pn = f"(k.se + k.sve * {dt})", f"(k.sn + k.svn * {dt})"
    s_ = f"({pp} + r.sigma_m * r.sigma_m)"
    kp, kv = f"({pp} / {s_})", f"({ppv} / {s_})"

    def state(born: str, hit: str, miss: str) -> str:
        return f"CASE WHEN {dead} THEN {born} WHEN r.h = 1 THEN {hit} ELSE {miss} END"

    return f"""WITH RECURSIVE {DUCK_FLEET},
fl AS (SELECT *, epoch_us(observed_at) AS obs, {_E} AS e, {_N} AS n,
              speed_mps * sin(radians(heading_deg)) AS ve0, speed_mps * cos(radians(heading_deg)) AS vn0
       FROM (SELECT *, row_number() OVER (PARTITION BY tick_us, user_id ORDER BY {duck.CANONICAL_DESC}) AS rn
             FROM (SELECT *, {tick} AS tick_us FROM fleet)) WHERE rn = 1),
gt AS (SELECT tick_us, row_number() OVER (ORDER BY tick_us) AS ord FROM (SELECT DISTINCT tick_us FROM fl)),
cand AS (SELECT DISTINCT f.user_id, g2.tick_us FROM fl f JOIN gt g ON g.tick_us = f.tick_us
         JOIN gt g2 ON g2.ord BETWEEN g.ord AND g.ord + {cfg.horizon}),
rows AS (SELECT c.user_id, c.tick_us, f.obs, f.lat_deg, f.lon_deg, f.e, f.n, f.ve0, f.vn0, f.sigma_m,
                CASE WHEN f.user_id IS NULL THEN 0 ELSE 1 END AS h,
                row_number() OVER (PARTITION BY c.user_id ORDER BY c.tick_us) AS i
         FROM cand c LEFT JOIN fl f ON f.user_id = c.user_id AND f.tick_us = c.tick_us),
tr AS (
  SELECT user_id, i, tick_us, 1 AS life, 'TENTATIVE' AS status, 1::BIGINT AS hist, 1 AS hlen, 1 AS hits, 0 AS misses,
         obs AS last_obs, e AS se, n AS sn, ve0 AS sve, vn0 AS svn, sigma_m * sigma_m AS p, 0.0::DOUBLE AS pv,
         {INITIAL_VELOCITY_VARIANCE}::DOUBLE AS v, lat_deg, lon_deg, tick_us AS born
  FROM rows WHERE i = 1
  UNION ALL
  SELECT r.user_id, r.i, r.tick_us, k.life + CASE WHEN {dead} AND r.h = 1 THEN 1 ELSE 0 END, {status},
         {state('1', nh, nh)}, {state('1', f'least(k.hlen + 1, {W})', f'least(k.hlen + 1, {W})')},
         {state('1', 'k.hits + 1', 'k.hits')}, {state('0', '0', 'k.misses + 1')},
         {state('r.obs', 'greatest(k.last_obs, r.obs)', 'k.last_obs')},
         {state('r.e', f'{pe} + {kp} * (r.e - {pe})', pe)}, {state('r.n', f'{pn} + {kp} * (r.n - {pn})', pn)},
         {state('r.ve0', f'k.sve + {kv} * (r.e - {pe})', 'k.sve')}, {state('r.vn0', f'k.svn + {kv} * (r.n - {pn})', 'k.svn')},
         {state('r.sigma_m * r.sigma_m', f'greatest({pp} - {kp} * {pp}, 1e-9)', pp)},
         {state('0.0', f'{ppv} - {kp} * {ppv}', ppv)},
         {state(f'{INITIAL_VELOCITY_VARIANCE}', f'greatest({pvv} - {kv} * {ppv}, 1e-9)', pvv)},
         {state('r.lat_deg', 'k.lat_deg', 'k.lat_deg')}, {state('r.lon_deg', 'k.lon_deg', 'k.lon_deg')},
         {state('r.tick_us', 'k.born', 'k.born')}
  FROM tr k JOIN rows r ON r.user_id = k.user_id AND r.i = k.i + 1),
born AS (SELECT user_id, life, row_number() OVER (ORDER BY born, lat_deg, lon_deg) AS track_id
         FROM (SELECT DISTINCT user_id, life, born, lat_deg, lon_deg FROM tr WHERE status <> 'GONE'))
SELECT b.track_id, t.status, t.tick_us AS state_us, t.last_obs AS last_observed_us,
       {duck.rnd('t.se', 2)} AS east_m, {duck.rnd('t.sn', 2)} AS north_m, {duck.rnd('t.sve', 3)} AS ve_mps,
       {duck.rnd('t.svn', 3)} AS vn_mps, t.hits::BIGINT AS hit_count, t.misses::BIGINT AS consecutive_misses,
       'fleet:fleet-feed' AS contributors
FROM tr t JOIN born b ON b.user_id = t.user_id AND b.life = t.life
WHERE t.status <> 'GONE' AND {where}"""


def _fleet_rows(t: DataFrame) -> DataFrame:
    return _track_rows(t, 2, 3)


_FLEET_TRACKS = _fleet_sql(duck.tick_us("observed_at", FLEET_STEP_US), "true")


@register("build_tracks", _FLEET_TRACKS)
def q_build_tracks(spark, sf_dir):
    return _fleet_rows(build_tracks(events_as_fleet(spark, sf_dir), "1 second", ORIGIN))


@register("build_tracks_by_region", _FLEET_TRACKS)
def q_build_tracks_region(spark, sf_dir):
    return _fleet_rows(build_tracks_by_region(events_as_fleet(spark, sf_dir), "1 second", cell_m=3000.0, origin=ORIGIN))


@register("replay_tracks", _fleet_sql("epoch_us(observed_at)", """t.status <> 'DROPPED'
  AND t.tick_us = (SELECT max(epoch_us(observed_at)) FROM fleet)"""))
def q_replay(spark, sf_dir):
    return _fleet_rows(replay_tracks(events_as_fleet(spark, sf_dir), ORIGIN))


@register("build_tracks_1min")
def q_build_tracks_1min(spark, sf_dir):
    d = events_as_detections(spark, sf_dir)
    return _track_rows(build_tracks(d, FLAGSHIP_TICK, ORIGIN, region=ONE_REGION))


@register("build_tracks_6h")
def q_build_tracks_6h(spark, sf_dir):
    d = events_as_detections(spark, sf_dir)
    return _track_rows(build_tracks(d, TRACK_TICK, ORIGIN, region=ONE_REGION))


def birth_rows(spark, sf_dir) -> DataFrame:
    """Coalesced detections at 6-hour ticks seen as births, with their source rank."""
    from sensortracks.operators.tracker import attr_key
    from sensortracks.functions.order import canonical_key
    from pyspark.sql.window import Window

    d = coalesce_detections(assign_tick(events_as_detections(spark, sf_dir), TRACK_TICK))
    d = d.withColumn("tick_us", F.unix_micros("tick"))
    src = (d.groupBy("tick_us", "source_type", "source_id").agg(F.min(canonical_key()).alias("_k"))
           .withColumn("source_rank", F.row_number().over(Window.partitionBy("tick_us").orderBy("_k")))
           .drop("_k"))
    return d.join(src, ["tick_us", "source_type", "source_id"]).withColumn("attr_key", attr_key())


@register("number_tracks", duck.with_det(f"""
SELECT event_id, (SELECT max(user_id) FROM det) + row_number() OVER (ORDER BY tick_us, source_rank, pos) AS track_id
FROM (SELECT *, min(pos) OVER (PARTITION BY tick_us, source_type, source_id) AS first_pos FROM (
        SELECT *, row_number() OVER (PARTITION BY tick_us ORDER BY {duck.CANONICAL_ASC}) AS pos FROM co)) x
JOIN (SELECT tick_us, source_type, source_id,
             row_number() OVER (PARTITION BY tick_us ORDER BY first_pos) AS source_rank
      FROM (SELECT tick_us, source_type, source_id, min(pos) AS first_pos FROM (
              SELECT *, row_number() OVER (PARTITION BY tick_us ORDER BY {duck.CANONICAL_ASC}) AS pos FROM co)
            GROUP BY ALL)) s USING (tick_us, source_type, source_id)""",
    f"""co AS (SELECT * FROM (
        SELECT *, row_number() OVER (PARTITION BY tick_us, source_type, source_id, icao24
                                     ORDER BY {duck.CANONICAL_DESC}) AS rn
        FROM (SELECT *, {duck.tick_us('observed_at', TRACK_TICK_US)} AS tick_us,
                     {duck.attr_entries()} AS attr_entries FROM det))
      WHERE icao24 IS NULL OR rn = 1)"""))
def q_number_tracks(spark, sf_dir):
    b = birth_rows(spark, sf_dir)
    born = {"b_rank": "source_rank", "b_observed_us": F.unix_micros("observed_at"), "b_lat": "lat_deg", "b_lon": "lon_deg",
            "b_alt": "alt_m", "b_speed": "speed_mps", "b_heading": "heading_deg", "b_sigma": "sigma_m",
            "b_received_us": F.unix_micros("received_at"), "b_attr_key": "attr_key"}
    births = b.select(F.lit(0).cast("long").alias("region"), F.col("event_id").alias("local_id"), "tick_us",
                      F.lit(True).alias("is_birth"),
                      *[(F.col(c) if isinstance(c, str) else c).alias(k) for k, c in born.items()])
    used = events_as_history(spark, sf_dir).select(F.coalesce(F.max("track_id"), F.lit(0)) + 1).scalar()
    return number_tracks(births, used).select(F.col("local_id").alias("event_id"), "track_id")


_DUCK_ASG = f"""asg AS (SELECT user_id AS track_id, tick_us, source_type, source_id, event_id, observed_at FROM (
        SELECT *, row_number() OVER (PARTITION BY tick_us, source_type, source_id, icao24
                                     ORDER BY {duck.CANONICAL_DESC}) AS rn
        FROM (SELECT *, {duck.tick_us('observed_at', TRACK_TICK_US)} AS tick_us,
                     {duck.attr_entries()} AS attr_entries FROM det))
      WHERE icao24 IS NOT NULL AND rn = 1),
spine AS (SELECT DISTINCT track_id, tick_us FROM asg),
srcs AS (SELECT track_id, source_type, source_id, min(tick_us) AS first_tick FROM asg GROUP BY ALL),
grid AS (SELECT s.track_id, s.tick_us, c.source_type, c.source_id FROM spine s
         JOIN srcs c ON s.track_id = c.track_id AND s.tick_us >= c.first_tick),
latest AS (SELECT g.track_id, g.tick_us, g.source_type, g.source_id, arg_max(a.event_id, a.tick_us) AS event_id
           FROM grid g JOIN asg a ON a.track_id = g.track_id AND a.source_type = g.source_type
                AND a.source_id = g.source_id AND a.tick_us <= g.tick_us GROUP BY ALL),
lastobs AS (SELECT s.track_id, s.tick_us, max(epoch_us(a.observed_at)) AS last_observed_us
            FROM spine s JOIN asg a ON a.track_id = s.track_id AND a.tick_us <= s.tick_us GROUP BY ALL)"""


@register("contributors_as_of", duck.with_det("""
SELECT l.track_id, l.tick_us,
       string_agg(l.source_type || ':' || l.event_id::VARCHAR, '|' ORDER BY l.source_type, l.source_id) AS contributors,
       o.last_observed_us
FROM latest l JOIN lastobs o USING (track_id, tick_us) GROUP BY l.track_id, l.tick_us, o.last_observed_us""",
    _DUCK_ASG))
def q_contributors(spark, sf_dir):
    d = coalesce_detections(assign_tick(events_as_detections(spark, sf_dir, keep_event_columns=True), TRACK_TICK))
    asg = (d.filter(identity().isNotNull())
           .select(F.col("user_id").alias("track_id"), F.unix_micros("tick").alias("tick_us"),
                   "source_type", "source_id", "event_id", "observed_at"))
    c = contributors_as_of(asg, tick="tick_us", payload=["event_id", "observed_at"])
    return c.select("track_id", "tick_us",
                    F.array_join(F.transform("contributors", lambda x: F.concat_ws(
                        ":", x["source_type"], x["event_id"].cast("string"))), "|").alias("contributors"),
                    us("last_observed_at").alias("last_observed_us"))


_CELL = 1500.0
_OFF = 1 << 30


@register("split_regions", "WITH RECURSIVE " + duck.with_det(f"""
SELECT c.event_id, m.region FROM cellof c JOIN (SELECT src, min(dst) AS region FROM reach GROUP BY src) m
  ON m.src = c.cell""", f"""cellof AS (SELECT event_id, (floor({_E} / {_CELL})::BIGINT + {_OFF}) * {1 << 31}
                         + (floor({_N} / {_CELL})::BIGINT + {_OFF}) AS cell,
                         floor({_E} / {_CELL})::BIGINT AS cx, floor({_N} / {_CELL})::BIGINT AS cy FROM det),
cells AS (SELECT DISTINCT cell, cx, cy FROM cellof),
edges AS (SELECT a.cell AS src, b.cell AS dst FROM cells a JOIN cells b
          ON abs(a.cx - b.cx) <= 1 AND abs(a.cy - b.cy) <= 1),
reach AS (SELECT cell AS src, cell AS dst FROM cells
          UNION SELECT r.src, e.dst FROM reach r JOIN edges e ON r.dst = e.src)""")[len("WITH "):])
def q_split_regions(spark, sf_dir):
    d = events_as_detections(spark, sf_dir)
    p = geo.to_enu(F.col("lat_deg"), F.col("lon_deg"), F.col("alt_m"), ORIGIN)
    d = d.select("event_id", p.east_m.alias("e"), p.north_m.alias("n"))
    return split_regions(d, _CELL).select("event_id", "region")
