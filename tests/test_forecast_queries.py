"""The registered model queries at smoke size, with small forests."""

import pytest
from pyspark.ml.regression import RandomForestRegressor

from driverbind import catalog
from tests.test_oracle import FOLDER


@pytest.fixture(autouse=True)
def small(monkeypatch):
    monkeypatch.setitem(catalog.FOREST, "numTrees", 3)
    monkeypatch.setitem(catalog.FOREST, "maxDepth", 3)


def test_predict_demand_reads_the_written_feature_table(spark):
    """Training, the largest quantity and the future inputs read one table; the sales are not summed again for each."""
    found = catalog.QUERIES["predict_demand"](spark, FOLDER)
    assert {name.split("/")[-2].split("-")[0] for name in found.inputFiles()} == {"features"}
    assert found.where("within_range").count() == found.count() > 0


def test_top_demand_forecast_reads_the_written_feature_table(spark):
    found = catalog.QUERIES["top_demand_forecast"](spark, FOLDER)
    assert {name.split("/")[-2].split("-")[0] for name in found.inputFiles()} == {"features"}
    assert found.where("total_of_days").count() == found.count() > 0


def test_feature_importance_comes_from_a_forest_grown_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(RandomForestRegressor, "_fit", lambda *_: pytest.fail("left to Spark's training"))
    found = catalog.QUERIES["feature_importance"](spark, FOLDER).collect()
    assert len(found) == 14 and all(r["not_negative"] and r["sums_to_one"] for r in found)
