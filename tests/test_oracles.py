"""Every registered query against its DuckDB oracle (the driver's check) at sf0.001,
and every query without an oracle runs and returns rows with a stable schema."""

import pytest

from conftest import SF_SMALL
from oracle_compare import compare, duck_connection
from sensortracks.plans import ORACLES, QUERIES

_CON = {}


def _con():
    if "c" not in _CON:
        _CON["c"] = duck_connection(SF_SMALL)
    return _CON["c"]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, name):
    assert compare(spark, name, SF_SMALL, _con(), verbose=True)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_oracle_runs(spark, name):
    rows = QUERIES[name](spark, SF_SMALL).toPandas()
    assert len(rows) > 0 and len(rows.columns) == len(set(rows.columns))
    keys = {"assign_pairs": ["tick_us", "det_id"], "stream_tracks": ["track_id", "state_us"],
            "build_tracks_1min": ["track_id", "state_us"], "build_tracks_6h": ["track_id", "state_us"]}
    assert not rows.duplicated(keys[name]).any() if name in keys else not rows.isna().any().any()


def test_entry(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
