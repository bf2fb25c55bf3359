"""Column-level helpers (all native Spark expressions)."""
