from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from tremorframe.operators import forest, models

COLS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def settings(spark):
    return RandomForestRegressor(numTrees=7, featureSubsetStrategy="sqrt", minInstancesPerNode=2, maxDepth=30, seed=42)


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(8)
    x = rng.uniform(size=(600, 3))
    y = np.where(x[:, 0] > 0.4, 2.0, 1.0) + 0.5 * x[:, 1] + 0.01 * rng.normal(size=600)
    return spark.createDataFrame(
        [(i, float(y[i]), *map(float, x[i])) for i in range(600)], "eq_id int, label double, a double, b double, c double"
    )


def predictions(model, rows):
    return {r["eq_id"]: r["prediction"] for r in model.transform(rows).collect()}


def test_no_node_below_the_top_is_on_the_driver(rows):
    """MLlib held all nodes there, about as many as rows times trees."""
    model = models._fit(rows, "RandomForest", COLS)
    assert len(model.top.tree) == 200
    assert model.below.agg(F.sum(F.size("feature"))).first()[0] > 10_000


def test_nodes_split_over_partitions_or_in_a_task_are_the_same(rows, settings, monkeypatch):
    whole = forest.fit_forest(rows, COLS, settings)
    monkeypatch.setattr(forest, "GROUP_ROWS", 50)
    cut = forest.fit_forest(rows.repartition(5), COLS, settings)
    assert len(whole.top.tree) == 7 < len(cut.top.tree)
    assert predictions(whole, rows) == predictions(cut, rows.repartition(3))
    assert np.allclose(whole.importances(), cut.importances(), rtol=1e-9)


def test_forest_learns_and_takes_more_rows_than_it_was_trained_on(rows, settings):
    model = forest.fit_forest(rows.filter("eq_id < 200"), COLS, settings)
    got = predictions(model, rows)
    want = {r["eq_id"]: r["label"] for r in rows.collect()}
    assert len(got) == 600 and np.mean([abs(got[i] - want[i]) for i in want]) < 0.15
    assert np.argmax(model.importances()) == 0


def test_one_row_and_equal_rows(rows, settings):
    one = forest.fit_forest(rows.filter("eq_id = 0"), COLS, settings)
    same = rows.filter("eq_id < 40").withColumns({c: F.lit(1.0) for c in COLS})
    flat = forest.fit_forest(same, COLS, settings)
    assert predictions(one, rows)[5] == pytest.approx(rows.first()["label"])
    assert len(set(predictions(flat, same).values())) == 1


def test_a_missing_value_is_an_error(rows, settings):
    model = forest.fit_forest(rows, COLS, settings)
    with pytest.raises(Exception, match="without a value"):
        model.transform(rows.withColumn("a", F.lit(None).cast("double"))).collect()
