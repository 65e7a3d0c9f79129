"""Training, scoring and reporting of the demand forecast."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from aisleworks.functions.rounding import round_half_even
from aisleworks.operators import forest as own_forest
from aisleworks.operators.features import FEATURES, KEY, TARGET
from aisleworks.session import is_written, materialized

# --- fixed values -----------------------------------------------------------
MIN_ROWS = 50
MIN_CLEAN_ROWS = 30
HOLDOUT_DAYS = 14
FOREST = {"numTrees": 100, "maxDepth": 10, "minInstancesPerNode": 3, "seed": 42}
# For forests that are left to Spark's own training: node ids are kept between levels instead of walking every tree from its
# root again; memory bounds the statistics that one task gathers for a group of nodes (a few such tasks run at once).
TRAINING = {"cacheNodeIds": True, "checkpointInterval": 10, "maxMemoryInMB": 512}
TOO_FEW_ROWS = "Not enough data to train. Need at least 50 rows."
TOO_FEW_CLEAN_ROWS = "Too many NaN rows after cleaning. Check your data."
# ----------------------------------------------------------------------------


@dataclass
class Trained:
    """Outcome of a training run: a model with its one-row metrics, or the reason for none."""

    model: PipelineModel | None
    metrics: DataFrame | None
    error: str | None = None


def clean_rows(features: DataFrame) -> DataFrame:
    return features.dropna(subset=[*FEATURES, TARGET])


def split_by_date(features: DataFrame, holdout_days: int = HOLDOUT_DAYS) -> tuple[DataFrame, DataFrame]:
    """Train on the past, hold out the last days."""
    cutoff = F.date_sub(features.agg(F.max("full_date")).scalar(), holdout_days)
    return features.where(F.col("full_date") <= cutoff), features.where(F.col("full_date") > cutoff)


def forecast_pipeline(**forest) -> Pipeline:
    assembler = VectorAssembler(inputCols=FEATURES, outputCol="features")
    # Every split looks at all inputs; Spark's default for regression is a third of them.
    regressor = RandomForestRegressor(
        labelCol=TARGET,
        featuresCol="features",
        predictionCol="prediction",
        featureSubsetStrategy="all",
        **{**FOREST, **TRAINING, **forest},
    )
    return Pipeline(stages=[assembler, regressor])


def fitted(train: DataFrame, **forest) -> PipelineModel:
    """The pipeline's model; what it asks for beyond plain bootstrapped trees over all inputs is left to Spark's training."""
    pipeline = forecast_pipeline(**forest)
    assembler, regressor = pipeline.getStages()
    if own_forest.shape_of(regressor) is None:
        return pipeline.fit(train)
    return PipelineModel([assembler, own_forest.fit(train, FEATURES, TARGET, regressor)])


def train_forecast(features: DataFrame, **forest) -> Trained:
    """Fit on all but the last two weeks and measure on those."""
    if is_written(features):
        return _trained_on(features.select("full_date", TARGET, *FEATURES), **forest)
    with materialized(features.select("full_date", TARGET, *FEATURES), "forecast-features") as kept:
        return _trained_on(kept, **forest)


def _trained_on(kept: DataFrame, **forest) -> Trained:
    complete = F.lit(True)
    for column in [*FEATURES, TARGET]:
        complete = complete & F.col(column).isNotNull()
    seen = kept.agg(F.count(F.lit(1)).alias("n"), F.count_if(complete).alias("clean")).first()
    if seen["n"] < MIN_ROWS:
        return Trained(None, None, TOO_FEW_ROWS)
    if seen["clean"] < MIN_CLEAN_ROWS:
        return Trained(None, None, TOO_FEW_CLEAN_ROWS)

    train, test = split_by_date(clean_rows(kept))
    model = fitted(train, **forest)
    train_rows = train.count()
    measured = forecast_metrics(model.transform(test))
    # one row, taken before the training table is released
    metrics = kept.sparkSession.createDataFrame([measured.first()], measured.schema).select(
        "mae",
        "rmse",
        "mape_pct",
        "mean_actual_qty",
        F.lit(train_rows).cast("long").alias("train_rows"),
        "test_rows",
        F.array(*[F.lit(name) for name in FEATURES]).alias("features_used"),
        F.lit("RandomForestRegressor").alias("model_type"),
    )
    return Trained(model, metrics)


def forecast_metrics(scored: DataFrame, actual: str = TARGET, predicted: str = "prediction") -> DataFrame:
    """Error measures of predictions, which count as zero where negative."""
    y = F.col(actual).cast("double")
    error = y - F.greatest(F.col(predicted), F.lit(0.0))
    return scored.agg(
        round_half_even(F.avg(F.abs(error)), 3).alias("mae"),
        round_half_even(F.sqrt(F.avg(error * error)), 3).alias("rmse"),
        round_half_even(F.avg(F.abs(error / F.greatest(y, F.lit(1.0)))) * 100.0, 2).alias("mape_pct"),
        round_half_even(F.avg(y), 3).alias("mean_actual_qty"),
        F.count(F.lit(1)).alias("test_rows"),
    )


def feature_importance(spark: SparkSession, model: PipelineModel) -> DataFrame:
    """One row per model input."""
    weights = model.stages[-1].featureImportances.toArray()
    rows = [(name, float(weight)) for name, weight in zip(FEATURES, weights)]
    return spark.createDataFrame(rows, "feature string, weight double").select(
        "feature", round_half_even(F.col("weight"), 4).alias("importance")
    )


def daily_forecast(scored: DataFrame, prediction: str | Column = "prediction") -> DataFrame:
    """Scored future inputs as forecast lines, rounded to a tenth and never negative."""
    value = F.col(prediction) if isinstance(prediction, str) else prediction
    # "+ 0.0" turns a rounded -0.0 into 0.0.
    quantity = F.greatest(F.lit(0.0), round_half_even(value, 1)) + F.lit(0.0)
    return scored.select(
        *KEY,
        "product_name",
        F.col("category_name").alias("category"),
        F.col("forecast_date").alias("date"),
        F.date_format("forecast_date", "EEEE").alias("day_name"),
        quantity.alias("predicted_qty"),
        (F.col("is_weekend") == 1).alias("is_weekend"),
    )


def scored(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """Rows with their prediction, as the model's ``transform`` gives it, computed on whole columns."""
    forest = model.stages[-1]
    found = None
    if len(model.stages) == 2 and isinstance(forest, RandomForestRegressionModel) and model.stages[0].getInputCols() == FEATURES:
        found = own_forest.predicted(forest, FEATURES, rows, forest.getPredictionCol())
    return model.transform(rows) if found is None else found


def predict_demand(
    model: PipelineModel, future: DataFrame, product_id=None, store_id=None
) -> DataFrame:
    """Daily forecast of every key, or of the ones asked for."""
    if product_id is not None:
        future = future.where(F.col("product_id") == product_id)
    if store_id is not None:
        future = future.where(F.col("store_id") == store_id)
    return daily_forecast(scored(model, future))


def forecast_totals(daily: DataFrame) -> DataFrame:
    """Horizon total per key with its days in order; the list is as long as the horizon."""
    day = F.struct("date", "day_name", "predicted_qty", "is_weekend")
    return daily.groupBy(*KEY, "product_name", "category").agg(
        F.count(F.lit(1)).alias("days_ahead"),
        F.sum(F.col("predicted_qty").cast("decimal(18,1)")).cast("double").alias("total_predicted_qty"),
        F.array_sort(F.collect_list(day)).alias("daily_forecast"),
    )


def leaders(features: DataFrame, store_id=None, top_n: int = 10) -> DataFrame:
    """Keys of each store's best sellers by units sold so far; a forecast of these alone is cheaper than of all."""
    history = features if store_id is None else features.where(F.col("store_id") == store_id)
    sold = history.groupBy(*KEY).agg(F.sum(TARGET).alias("units"))
    best = Window.partitionBy("store_id").orderBy(F.desc("units"), "product_id")
    return sold.withColumn("_place", F.row_number().over(best)).where(F.col("_place") <= top_n).select(*KEY)


def top_demand_forecast(best: DataFrame, totals: DataFrame) -> DataFrame:
    """Forecast totals of the leading keys."""
    return best.join(totals, KEY).select(
        "store_id",
        "product_id",
        "product_name",
        "category",
        F.col("total_predicted_qty").alias("total_7d_forecast"),
    )
