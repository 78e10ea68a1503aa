"""Versioned data sets: one Parquet directory per entity and version."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreloop.sources.files import child_dirs, exists, read_json, write_json


def dated_version(version: str = "v1", on: date | None = None) -> str:
    """``<version>_<ISO date>``; pass the date for a repeatable name."""
    return f"{version}_{(on or date.today()).isoformat()}"


class FeatureStore:
    """Save, list and load data set versions under one root folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, entity: str, version: str, part: str = "data") -> str:
        return f"{self.root}/{entity}/{version}/{part}"

    def save(
        self, df: DataFrame, entity: str, version: str | None = "v1", use_date: bool = False, on: date | None = None
    ) -> str:
        """Overwrite a version; without a version name, today's ``v1_<date>``."""
        name = dated_version(version or "v1", on) if use_date or version is None else version
        path = self.path(entity, name)
        df.write.mode("overwrite").parquet(path)
        return path

    def versions(self, entity: str) -> list[str]:
        return child_dirs(self.spark, f"{self.root}/{entity}")

    def versions_frame(self, entity: str) -> DataFrame:
        rows = [(entity, v) for v in self.versions(entity)]
        return self.spark.createDataFrame(rows, "entity string, version string").orderBy("version")

    def latest(self, entity: str, prefix: str = "v1") -> str | None:
        """Largest name starting with ``<prefix>_``; the bare prefix never counts."""
        return max((v for v in self.versions(entity) if v.startswith(prefix + "_")), default=None)

    def load(
        self, entity: str, version: str = "v1", use_date: bool = False, latest_if_available: bool = False,
        on: date | None = None,
    ) -> DataFrame:
        """The dated version, else the latest one, else the exact one."""
        if use_date:
            name = dated_version(version, on)
        elif latest_if_available:
            name = self.latest(entity, version)
            if name is None:
                raise FileNotFoundError(f"no version of {entity!r} starts with '{version}_'")
        else:
            name = version
        path = self.path(entity, name)
        if not exists(self.spark, path):
            raise FileNotFoundError(path)
        return self.spark.read.parquet(path)

    def save_inference_sample(
        self, df: DataFrame, entity: str, order_by: str | Column, version: str = "v1", n_rows: int = 5,
        use_date: bool = False, on: date | None = None,
    ) -> str:
        """The last ``n_rows`` rows in a stated order, next to the data set."""
        name = dated_version(version, on) if use_date else version
        path = self.path(entity, name, "latest_for_inference")
        order = F.col(order_by) if isinstance(order_by, str) else order_by
        df.orderBy(order.desc()).limit(n_rows).write.mode("overwrite").parquet(path)
        return path

    def track_metadata(self, df: DataFrame, entity: str, version: str, created: datetime | None = None) -> dict:
        """Row count, columns and types as a JSON sidecar."""
        document = {
            "version": version,
            "created": (created or datetime.now()).isoformat(timespec="seconds"),
            "rows": df.count(),
            "columns": df.columns,
            "dtypes": dict(df.dtypes),
        }
        write_json(self.spark, self.path(entity, version, "metadata"), document)
        return document

    def metadata(self, entity: str, version: str) -> dict:
        return read_json(self.spark, self.path(entity, version, "metadata"))


def metadata_frame(df: DataFrame, version: str) -> DataFrame:
    """Metadata as rows (version, rows, ordinal, column, dtype), counted lazily."""
    columns = F.array(*[
        F.struct(F.lit(i).alias("ordinal"), F.lit(c).alias("column"), F.lit(t).alias("dtype"))
        for i, (c, t) in enumerate(df.dtypes)
    ])
    return df.agg(F.count(F.lit(1)).alias("rows")).select(
        F.lit(version).alias("version"), "rows", F.inline(columns)
    )
