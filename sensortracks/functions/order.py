"""Canonical detection order and object identity (C5 and the keys of C4)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sensortracks.schema import IDENTITY_KEYS

# The 11 ordering keys; nullable doubles sort nulls first.
ORDER_COLUMNS = ["observed_at", "source_type", "source_id", "lat_deg", "lon_deg",
                 "alt_m", "speed_mps", "heading_deg", "sigma_m", "received_at"]
NULLABLE = {"alt_m", "speed_mps", "heading_deg"}


def sorted_attributes(attributes: str | Column = "attributes") -> Column:
    """Attributes as an array of (key, value) sorted by key: comparable and hashable."""
    col = F.col(attributes) if isinstance(attributes, str) else attributes
    return F.sort_array(F.map_entries(col))


def canonical_order(descending: bool = False, prefix: str = "") -> list[Column]:
    """Sort expressions for the deterministic total order of detections."""
    out = []
    for name in ORDER_COLUMNS:
        c = F.col(prefix + name)
        if descending:
            out.append(c.desc_nulls_last() if name in NULLABLE else c.desc())
        else:
            out.append(c.asc_nulls_first() if name in NULLABLE else c.asc())
    attrs = sorted_attributes(prefix + "attributes")
    out.append(attrs.desc() if descending else attrs.asc())
    return out


def canonical_key(prefix: str = "") -> Column:
    """A struct whose natural ordering is the canonical order (nulls first)."""
    return F.struct(*[F.col(prefix + n).alias(n) for n in ORDER_COLUMNS],
                    sorted_attributes(prefix + "attributes").alias("attr_entries"))


def identity(attributes: str | Column = "attributes") -> Column:
    """First non-blank identity attribute rendered ``key=value``, else null."""
    col = F.col(attributes) if isinstance(attributes, str) else attributes
    picks = []
    for key in IDENTITY_KEYS:
        v = col.getItem(key)
        picks.append(F.when(v.rlike(r"\S"), F.concat(F.lit(key + "="), v)))
    return F.coalesce(*picks)


def sort_structs(arr: Column, *fields: str) -> Column:
    """Sort an array of structs by some of their fields (works when a field is a map)."""
    def cmp(a, b):
        out = F.lit(0)
        for f in reversed(fields):
            out = F.when(a[f] < b[f], F.lit(-1)).when(a[f] > b[f], F.lit(1)).otherwise(out)
        return out
    return F.array_sort(arr, cmp)
