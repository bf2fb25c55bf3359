"""Query registry: name -> (spark, sf_dir) -> DataFrame, and name -> DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


def us(col: str | Column) -> Column:
    """Timestamps leave the engine as epoch microseconds (one form for both sides)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.unix_micros(c)


def r(col: str | Column, digits: int = 3) -> Column:
    """Rounded double; ``+ 0.0`` turns a negative zero into zero."""
    c = F.col(col) if isinstance(col, str) else col
    return F.round(c, digits) + F.lit(0.0)
