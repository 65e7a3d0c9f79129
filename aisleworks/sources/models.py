"""The trained forecast on shared storage, one folder per version."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_INFO = (
    "mae double, rmse double, mape_pct double, mean_actual_qty double, train_rows bigint, test_rows bigint, "
    "features_used array<string>, model_type string, "
    "feature_importance array<struct<importance: double, feature: string>>, saved_at timestamp"
)


def save_model(model: PipelineModel, metrics: DataFrame, importance: DataFrame, path: str) -> None:
    """A new version: the model, then its metadata row, whose presence makes the version count."""
    version = uuid.uuid4().hex
    model.write().save(f"{path}/{version}/model")
    heaviest_first = F.sort_array(F.collect_list(F.struct("importance", "feature")), asc=False)
    info = metrics.withColumns(
        {
            "feature_importance": importance.agg(heaviest_first).scalar(),
            "saved_at": F.current_timestamp(),
            "version": F.lit(version),
        }
    )
    info.coalesce(1).write.json(f"{path}/{version}/info")


def _versions(spark: SparkSession, path: str) -> DataFrame:
    schema = f"{_INFO}, version string"
    try:
        return spark.read.schema(schema).json(f"{path}/*/info")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def load_model(path: str) -> PipelineModel:
    """The newest version that was saved completely."""
    newest = _versions(SparkSession.active(), path).orderBy(F.desc("saved_at")).first()
    if newest is None:
        raise FileNotFoundError(f"no model has been saved at {path}")
    return PipelineModel.load(f"{path}/{newest['version']}/model")


def model_info(spark: SparkSession, path: str) -> DataFrame:
    """Metadata of the newest model; empty where none has been trained yet."""
    return _versions(spark, path).orderBy(F.desc("saved_at")).limit(1).drop("version")
