"""Merging feeds (A7) and area filters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_sources(feeds: list[tuple[DataFrame, tuple[str, str] | None]]) -> tuple[DataFrame, DataFrame]:
    """One stream from several feeds.

    Each feed comes with its declared (source_id, source_type), or None for a
    feed that may carry any.  Rows of a declared feed that name another source
    are refused (second result, with the declared pair).
    """
    good, bad = [], []
    for df, declared in feeds:
        if declared is None:
            good.append(df)
            continue
        sid, stype = declared
        match = (F.col("source_id") == F.lit(sid)) & (F.col("source_type") == F.lit(stype))
        good.append(df.filter(match))
        bad.append(df.filter(~match).withColumn("declared_source", F.lit(f"{stype}:{sid}")))
    accepted = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), good)
    refused = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), bad) if bad else \
        accepted.limit(0).withColumn("declared_source", F.lit(None).cast("string"))
    return accepted, refused


def bbox_filter(df: DataFrame, boxes: list[tuple[float, float, float, float]]) -> DataFrame:
    """Rows inside any box given by two corners (lat1, lon1, lat2, lon2), edges included.

    Plain comparisons on the columns, so Parquet scans receive them as pushed
    filters.
    """
    if not boxes:
        raise ValueError("at least one bounding box is required")
    conds = []
    for lat1, lon1, lat2, lon2 in boxes:
        for v, lo, hi in ((lat1, -90, 90), (lat2, -90, 90), (lon1, -180, 180), (lon2, -180, 180)):
            if not (lo <= v <= hi):
                raise ValueError("invalid bounding box")
        conds.append(F.col("lat_deg").between(min(lat1, lat2), max(lat1, lat2))
                     & F.col("lon_deg").between(min(lon1, lon2), max(lon1, lon2)))
    return df.filter(reduce(lambda a, b: a | b, conds))
