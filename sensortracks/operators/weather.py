"""Weather: parse responses (C7), as-of enrichment (C8), fetch planning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sensortracks.functions import geo
from sensortracks.operators.common import interval_us
from sensortracks.session import checkpoint_dir, discard, written
from sensortracks.sources.feeds import is_number, vtype

# --- fixed values: weather attribute keys and unit factors -------------------
WEATHER_FIELDS = [
    ("weather.temperatureC", "temperature_2m", 1.0),
    ("weather.windSpeedMps", "wind_speed_10m", 1 / 3.6),
    ("weather.windDirectionDeg", "wind_direction_10m", 1.0),
]
WEATHER_CODE = ("weather.code", "weather_code")
_INTEGRAL = r"^(TINYINT|SMALLINT|INT|BIGINT)$"


def parse_weather(raw: DataFrame, payload: str = "payload") -> tuple[DataFrame, DataFrame]:
    """The ``current`` object -> string attributes; no ``current`` -> rejected.

    Numbers are scaled (wind km/h -> m/s) and written as Java-style double text;
    the weather code only when it is an integer.
    """
    v = F.try_parse_json(F.col(payload))
    cur = F.try_variant_get(v, "$.current", "variant")
    checked = raw.withColumn("_cur", cur)
    ok = F.col("_cur").isNotNull() & vtype(F.col("_cur")).startswith("OBJECT")
    entries = []
    for key, field, factor in WEATHER_FIELDS:
        x = F.try_variant_get(F.col("_cur"), f"$.{field}", "variant")
        val = F.when(is_number(x), (F.try_variant_get(x, "$", "double") * F.lit(factor)).cast("string"))
        entries.append(F.struct(F.lit(key).alias("key"), val.alias("value")))
    code = F.try_variant_get(F.col("_cur"), f"$.{WEATHER_CODE[1]}", "variant")
    code_val = F.when(code.isNotNull() & vtype(code).rlike(_INTEGRAL),
                      F.try_variant_get(code, "$", "int").cast("string"))
    entries.append(F.struct(F.lit(WEATHER_CODE[0]).alias("key"), code_val.alias("value")))
    attrs = F.map_from_entries(F.filter(F.array(*entries), lambda e: e["value"].isNotNull()))
    parsed = checked.filter(ok).withColumn("weather", attrs).drop("_cur")
    rejected = checked.filter(~ok | F.col("_cur").isNull()).drop("_cur").withColumn(
        "reason", F.lit("weather response has no current data"))
    return parsed, rejected


def enrich_weather(detections: DataFrame, weather: DataFrame, ttl, grid_deg: float,
                   at: str | Column = "received_at") -> DataFrame:
    """Add the cell's weather in force at ``at`` to each detection's attributes.

    ``weather``: cell_lat, cell_lon, fetched_at, weather (map).  An entry is in
    force from fetched_at until the earlier of fetched_at + ttl (strict) and the
    cell's next fetch.  Those intervals do not overlap, so the as-of join is an
    equi-join on (cell, time bucket of length ttl) plus a range test, with at
    most one match per detection: no window over a whole cell.  Without an
    entry the row passes unchanged; weather keys overwrite (LAST_WIN policy).
    """
    ttl_us = interval_us(ttl)
    at_col = F.col(at) if isinstance(at, str) else at
    w = Window.partitionBy("cell_lat", "cell_lon").orderBy("fetched_at")
    spans = (weather.select("cell_lat", "cell_lon", F.unix_micros("fetched_at").alias("_from"), "weather")
             .withColumn("_next", F.lead("_from").over(w.orderBy("_from")))
             .withColumn("_to", F.least(F.col("_from") + F.lit(ttl_us), F.coalesce("_next", F.lit(1 << 62)))))
    b0 = F.floor(F.col("_from") / F.lit(ttl_us)).cast("long")
    spans = (spans.withColumn("_bucket", F.explode(F.array(b0, b0 + 1)))
             .select(F.col("cell_lat").alias("_clat"), F.col("cell_lon").alias("_clon"), "_bucket",
                     "_from", "_to", F.col("weather").alias("_w")))
    cell = geo.grid_cell(F.col("lat_deg"), F.col("lon_deg"), grid_deg)
    d = detections.withColumn("_t", F.unix_micros(at_col)).withColumn("_c", cell) \
        .withColumn("_bucket", F.floor(F.col("_t") / F.lit(ttl_us)).cast("long"))
    cond = ((d["_c.cell_lat"] == spans["_clat"]) & (d["_c.cell_lon"] == spans["_clon"])
            & (d["_bucket"] == spans["_bucket"]) & (spans["_from"] <= d["_t"]) & (d["_t"] < spans["_to"]))
    j = d.join(spans, cond, "left")
    merged = F.when(F.col("_w").isNull(), F.col("attributes")).otherwise(F.map_concat("attributes", "_w"))
    return j.withColumn("attributes", merged).select(*detections.columns)


def plan_weather_lookups(detections: DataFrame, ttl, grid_deg: float, at: str = "received_at") -> DataFrame:
    """The requests that trigger a fetch, one per cell per TTL counted from the fetch.

    Per cell the first request fetches; the next fetch is the first request at or
    after fetch + ttl, and so on.  ``next`` pointers (first request >= t + ttl)
    come from windows over TTL-wide buckets and one row per bucket; the chain from each cell's
    first request is then expanded by pointer doubling (O(log n) joins), so no
    cell's chain is ever gathered in one place.  Returns cell_lat, cell_lon,
    fetch_at, plus the number of requests the fetch serves.
    """
    ttl_us = interval_us(ttl)
    spark = detections.sparkSession
    checkpoint_dir(spark)
    cell = geo.grid_cell(F.col("lat_deg"), F.col("lon_deg"), grid_deg)
    req = detections.select(cell.cell_lat.alias("cell_lat"), cell.cell_lon.alias("cell_lon"),
                            F.unix_micros(at).alias("t"))
    times = req.groupBy("cell_lat", "cell_lon", "t").agg(F.count(F.lit(1)).alias("n"))
    key = ["cell_lat", "cell_lon"]
    # next(t): the first request time >= t + ttl in the same cell
    probes = times.select(*key, (F.col("t") + F.lit(ttl_us)).alias("pos"), F.col("t").alias("src"),
                          F.lit(1).alias("kind"), F.lit(None).cast("long").alias("cand"))
    data = times.select(*key, F.col("t").alias("pos"), F.lit(None).cast("long").alias("src"),
                        F.lit(0).alias("kind"), F.col("t").alias("cand"))
    both = probes.unionByName(data).withColumn("_b", F.floor(F.col("pos") / F.lit(ttl_us)).cast("long"))
    # inside a TTL-wide bucket by a window; beyond it, the first request of the next
    # bucket that has one, from a table of one row per bucket
    inside = Window.partitionBy(*key, "_b").orderBy("pos", "kind").rowsBetween(0, Window.unboundedFollowing)
    beyond = Window.partitionBy(*key).orderBy("_b").rowsBetween(1, Window.unboundedFollowing)
    firsts = both.groupBy(*key, "_b").agg(F.min("cand").alias("_first")).withColumn(
        "_next", F.first("_first", ignorenulls=True).over(beyond)).drop("_first")
    nxt = (both.withColumn("_in", F.first("cand", ignorenulls=True).over(inside)).filter("kind = 1")
           .join(firsts, [*key, "_b"])
           .select(*key, F.col("src").alias("t"), F.coalesce("_in", "_next").alias("nxt")))
    old: list[str] = []
    nxt = written(nxt, old)
    heads = times.groupBy(*key).agg(F.min("t").alias("t"))
    chain = written(heads, old)
    jump = nxt  # jump by 2^k
    while True:  # the chain is finite and doubles its reach each round
        step = chain.join(jump, [*key, "t"]).select(*key, F.col("nxt").alias("t")).filter(F.col("t").isNotNull())
        new_chain = written(chain.unionByName(step).distinct(), old)
        own = len(old)
        grew = new_chain.count() > chain.count()
        chain = new_chain
        j2 = (jump.alias("a").join(jump.alias("b"), [F.col("a.cell_lat") == F.col("b.cell_lat"),
                                                     F.col("a.cell_lon") == F.col("b.cell_lon"),
                                                     F.col("a.nxt") == F.col("b.t")], "left")
              .select(F.col("a.cell_lat").alias("cell_lat"), F.col("a.cell_lon").alias("cell_lon"),
                      F.col("a.t").alias("t"), F.col("b.nxt").alias("nxt")))
        if not grew:
            break
        jump = written(j2, old)
    discard(spark, old[:own - 1] + old[own:])
    # Each request is served by the one fetch f with f <= t < f + ttl: an
    # equi-join on (cell, ttl bucket) with a range test, no per-cell window.
    b0 = F.floor(F.col("fetch_us") / F.lit(ttl_us)).cast("long")
    fetches = (chain.withColumnRenamed("t", "fetch_us")
               .withColumn("_b", F.explode(F.array(b0, b0 + 1))))
    tb = times.withColumn("_b", F.floor(F.col("t") / F.lit(ttl_us)).cast("long"))
    served = (tb.join(fetches, [*key, "_b"])
              .filter((F.col("fetch_us") <= F.col("t")) & (F.col("t") < F.col("fetch_us") + F.lit(ttl_us)))
              .groupBy(*key, "fetch_us").agg(F.sum("n").alias("requests_served")))
    return served.select(*key, F.timestamp_micros("fetch_us").alias("fetch_at"), "requests_served")
