from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tremorframe.session import local_session  # noqa: E402

T0 = 1_000_000_000_000_000  # 2001-09-09 01:46:40 UTC
HOUR = 3_600_000_000
EVENT_SCHEMA = (
    "eq_id string, event_id bigint, t_us bigint, lat double, lon double, depth double, "
    "mag double, mag_type string"
)
CAT_SCHEMA = (
    "eq_id string, t0_us bigint, mainshock_mag double, mainshock_depth double, "
    "mainshock_lat double, mainshock_lon double, year int"
)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(
        4, "tests", **{"spark.checkpoint.dir": str(tmp_path_factory.mktemp("scratch"))}
    )
    yield session
    session.stop()


@pytest.fixture
def make_events(spark):
    """Events from ``(eq_id, hours, mag[, lat, lon, depth, type])`` tuples."""

    def make(rows):
        full = []
        for i, row in enumerate(rows):
            eq, hours, mag, lat, lon, depth, kind = (*row, *(0.0, 0.0, 10.0, "mb")[len(row) - 3 :])
            t_us = None if hours is None else T0 + round(hours * HOUR)
            full.append((eq, i, t_us, lat, lon, depth, mag, kind))
        return spark.createDataFrame(full, EVENT_SCHEMA)

    return make


@pytest.fixture
def make_cat(spark):
    """Catalog from ``(eq_id[, mag, lat, lon, t0_us, depth])`` tuples."""

    def make(rows):
        full = []
        for row in rows:
            eq, mag, lat, lon, t0, depth = (*row, *(7.0, 0.0, 0.0, T0, 10.0)[len(row) - 1 :])
            full.append((eq, t0, mag, depth, lat, lon, 2001))
        return spark.createDataFrame(full, CAT_SCHEMA)

    return make


def rows_of(df, *keys):
    """Collected rows as dicts in a stable order."""
    out = [r.asDict(recursive=True) for r in df.collect()]
    keys = keys or df.columns
    return sorted(out, key=lambda r: [(r[k] is None, r[k]) if r[k] is not None else (True, 0) for k in keys])
