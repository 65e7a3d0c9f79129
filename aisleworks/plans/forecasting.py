"""Training and using the demand forecast over a set of tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession

from aisleworks.operators import features, forecast
from aisleworks.plans.presentation import present
from aisleworks.plans.reports import within
from aisleworks.session import materialize, release
from aisleworks.sources import models
from aisleworks.sources.tables import Tables


class Forecasting:
    """``model_path`` is a folder on shared storage that holds the model and its metadata."""

    def __init__(self, tables: Tables, model_path: str, as_of: dt.date | str | None = None):
        self.tables, self.model_path, self.as_of = tables, model_path, as_of
        self._table: DataFrame | None = None

    def features(self) -> DataFrame:
        """The feature table, written once and read by everything after."""
        if self._table is None:
            t = self.tables
            built = features.feature_table(
                t.transaction, t.date, t.product, t.category, t.store, t.external_factors
            )
            self._table = materialize(built, "features")
        return self._table

    def train(self, **forest) -> forecast.Trained:
        trained = forecast.train_forecast(self.features(), **forest)
        if trained.model is not None:
            importance = forecast.feature_importance(self.features().sparkSession, trained.model)
            models.save_model(trained.model, trained.metrics, importance, self.model_path)
        return trained

    def model_info(self, spark: SparkSession) -> DataFrame:
        return models.model_info(spark, self.model_path)

    def daily(self, days_ahead: int = 7, product_id=None, store_id=None, of: DataFrame | None = None) -> DataFrame:
        """Forecast of every key, of the ones asked for, or of the (product_id, store_id) rows ``of``."""
        within("days_ahead", days_ahead, 1, 30)
        model = models.load_model(self.model_path)
        table = self.features()
        if of is not None:
            table = table.join(of.select(*features.KEY), features.KEY, "left_semi")
        future = features.future_features(table, self.as_of, days_ahead)
        return forecast.predict_demand(model, future, product_id, store_id)

    def demand(self, days_ahead: int = 7, product_id=None, store_id=None, of: DataFrame | None = None) -> DataFrame:
        return forecast.forecast_totals(self.daily(days_ahead, product_id, store_id, of))

    def close(self) -> None:
        """Delete the written feature table."""
        if self._table is not None:
            release(self._table)
            self._table = None

    def top_demand(self, store_id=None, top_n: int = 10) -> DataFrame:
        within("top_n", top_n, 1, 50)
        best = forecast.leaders(self.features(), store_id, top_n)
        return present("top_demand_forecast", forecast.top_demand_forecast(best, self.demand(7, of=best)))

    def weekly_quantity(self, of: DataFrame | None = None) -> DataFrame:
        """(product_id, store_id, forecast_7d_qty), as restock orders want it; ``of`` names the keys that are needed."""
        return self.demand(7, of=of).select("product_id", "store_id", "total_predicted_qty").withColumnRenamed(
            "total_predicted_qty", "forecast_7d_qty"
        )
