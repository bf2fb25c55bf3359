"""Registered queries over the driver's test tables, with their DuckDB oracles."""

from sensortracks.plans.registry import ORACLES, QUERIES
from sensortracks.plans import catalog  # noqa: F401,E402

__all__ = ["QUERIES", "ORACLES"]
