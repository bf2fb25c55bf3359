"""A1: the eleven field rules of a detection; rejected rows keep their reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensortracks.schema import DETECTION_COLUMNS

_INF = float("inf")


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(_INF))


def _blank(c: Column) -> Column:
    return c.isNull() | ~c.rlike(r"\S")


def rejection_reasons(df: DataFrame) -> Column:
    """Array of the codes of broken rules (empty when the row is a valid detection)."""
    lat, lon = F.col("lat_deg"), F.col("lon_deg")
    alt, spd, hdg, sig = (F.col(c) for c in ("alt_m", "speed_mps", "heading_deg", "sigma_m"))
    attrs = F.col("attributes")
    rules = [
        (_blank(F.col("source_id")), "source_id_blank"),
        (_blank(F.col("source_type")), "source_type_blank"),
        (F.col("observed_at").isNull(), "observed_at_null"),
        (F.col("received_at").isNull(), "received_at_null"),
        (~(finite(lat) & (lat >= -90) & (lat <= 90)), "lat_outside"),
        (~(finite(lon) & (lon >= -180) & (lon <= 180)), "lon_outside"),
        (alt.isNotNull() & ~finite(alt), "alt_not_finite"),
        (spd.isNotNull() & ~(finite(spd) & (spd >= 0)), "speed_not_positive"),
        (hdg.isNotNull() & ~(finite(hdg) & (hdg >= 0) & (hdg < 360)), "heading_outside"),
        (~(finite(sig) & (sig > 0)), "sigma_not_positive"),
        (attrs.isNotNull() & F.exists(F.map_values(attrs), lambda v: v.isNull()),
         "attribute_null"),
    ]
    return F.array_compact(F.array(*[F.when(cond, F.lit(msg)) for cond, msg in rules]))


def validate_detections(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split into (valid, rejected). Valid rows get ``attributes`` = {} when null.

    Columns beyond the detection schema are carried along untouched.
    """
    checked = df.withColumn("reasons", rejection_reasons(df))
    extra = [c for c in df.columns if c not in DETECTION_COLUMNS]
    valid = (checked.filter(F.size("reasons") == 0)
             .withColumn("attributes", F.coalesce(
                 F.col("attributes"), F.create_map().cast("map<string,string>")))
             .select(*DETECTION_COLUMNS, *extra))
    rejected = checked.filter(F.size("reasons") > 0)
    return valid, rejected
