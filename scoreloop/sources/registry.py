"""Saved models, their dated copies, and a registry of numbered versions."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreloop.sources.files import exists, write_json

# Metrics every registered model has, -1 when unknown.
REQUIRED_METRICS = ("mae", "rmse", "r2")
_SCHEMA = "name string, version int, metrics map<string,double>, path string, created timestamp"


def save_with_copy(model: PipelineModel, root: str, name: str, on: date | None = None) -> tuple[str, str]:
    """Overwrite the main copy and write one named by date."""
    root = root.rstrip("/")
    paths = f"{root}/{name}", f"{root}/{name}_{(on or date.today()).isoformat()}"
    for path in paths:
        model.write().overwrite().save(path)
    return paths


def save_preparation(model: PipelineModel, root: str, name: str = "preparation") -> str:
    """A fitted preparation as an artifact of its own, beside the models that use it."""
    path = f"{root.rstrip('/')}/{name}"
    model.write().overwrite().save(path)
    return path


def load_preparation(spark: SparkSession, root: str, name: str = "preparation") -> PipelineModel:
    path = f"{root.rstrip('/')}/{name}"
    if not exists(spark, path):
        raise FileNotFoundError(path)
    return PipelineModel.load(path)


def numeric_metrics(metrics: dict) -> dict[str, float]:
    """Numbers only; the required ones default to -1."""
    numbers = {
        k: float(v) for k, v in metrics.items() if isinstance(v, (int, float)) and not isinstance(v, bool)
    }
    return {**dict.fromkeys(REQUIRED_METRICS, -1.0), **numbers}


class ModelRegistry:
    """Numbered model versions under one root, with a metrics table.

    One writer at a time per model name: versions are taken as highest + 1.
    The model is saved before its row is appended, so a registered version
    always has its files.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.table = f"{self.root}/_registry"

    def entries(self, name: str | None = None) -> DataFrame:
        if exists(self.spark, self.table):
            df = self.spark.read.schema(_SCHEMA).parquet(self.table)
        else:
            df = self.spark.createDataFrame([], _SCHEMA)
        return df.filter(F.col("name") == name) if name else df

    def register(self, model: PipelineModel, name: str, metrics: dict, created: datetime | None = None) -> int:
        latest = self.entries(name).agg(F.max("version")).first()[0]
        version = (latest or 0) + 1
        path = f"{self.root}/{name}/v={version}"
        model.write().overwrite().save(path)
        row = [(name, version, numeric_metrics(metrics), path, created or datetime.now())]
        self.spark.createDataFrame(row, _SCHEMA).coalesce(1).write.mode("append").parquet(self.table)
        return version

    def latest(self, name: str) -> tuple[PipelineModel, int]:
        row = self.entries(name).orderBy(F.desc("version")).limit(1).collect()
        if not row:
            raise LookupError(f"no registered model named {name!r}")
        return PipelineModel.load(row[0]["path"]), row[0]["version"]


def write_report(spark: SparkSession, path: str, report: dict) -> None:
    """A training report as a JSON document."""
    write_json(spark, path, report)
