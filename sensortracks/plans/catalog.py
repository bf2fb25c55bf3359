"""Import every plan module so all queries are registered."""

from sensortracks.plans import feeds, ingest, streams, tracking, views  # noqa: F401
from sensortracks.plans.registry import ORACLES, QUERIES  # noqa: F401
