"""The driver contract: every query with an SQL twin gives the same rows."""

from __future__ import annotations

import math
import os
import re

import duckdb
import pytest

import __spark_entry__ as contract

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables not present")

# Their values are compared in test_models.py and test_forecast.py: SQL cannot fit these models.
ROWS_ONLY = {
    "cross_lasso", "cross_forest", "cross_boosting", "model_metrics", "model_best", "tree_importances",
    "forest_importances", "model_saved", "omori_fit_converged",
}


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for name in os.listdir(SF_DIR):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from '{SF_DIR}/{name}'")
    return con


def normal(rows, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)

    def cell(v):
        return None if v is None or (isinstance(v, float) and math.isnan(v)) else v

    out = [tuple(cell(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda t: [(x is None, 0 if x is None else x) for x in t])


def library(names):
    """Without the optional text operators, which have tests of their own."""
    return {n for n in names if n != "pipeline" and not re.match(r"op\d+_", n)}


def test_every_query_has_a_twin_or_is_a_model():
    assert library(contract.queries()) - set(contract.oracle_sql()) == ROWS_ONLY
    assert not set(contract.oracle_sql()) - set(contract.queries())


def test_flagship(spark):
    df = contract.entry(spark)
    assert df.columns == ["eq_id", "window", "max_mag", "t_us", "mag_type", "n_events"]
    assert df.count() > 0


@pytest.mark.parametrize("name", sorted(library(contract.oracle_sql())))
def test_same_rows_as_sql(spark, tables, name):
    df = contract.queries()[name](spark, SF_DIR)
    mine = normal(df.collect(), df.columns)
    cursor = tables.execute(contract.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert mine == normal(cursor.fetchall(), columns)


NO_CROSS = [
    "window_max_per_sequence", "sequence_features", "completeness_edge", "rj_a", "etas_max_mag", "omori_fit",
    "predictions", "submission", "associate_space_time", "load_status", "mag_histogram", "top_sequences",
]


@pytest.mark.parametrize("name", NO_CROSS)
def test_no_cross_joins_in_plans(spark, name):
    plan = contract.queries()[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan


def test_scan_reads_only_needed_columns(spark):
    plan = contract.queries()["omori_bins"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "props" not in plan and "event_type" not in plan
