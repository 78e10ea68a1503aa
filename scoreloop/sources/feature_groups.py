"""Keyed, partitioned feature tables and named views over them."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Mapping
from dataclasses import asdict, dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scoreloop.functions import date_string, parse_timestamp
from scoreloop.functions.vocabulary import NON_FEATURES
from scoreloop.operators.ledger import latest_per_key, sync_feedback, sync_predictions
from scoreloop.operators.project import feature_columns
from scoreloop.sources.files import exists, read_json, write_json
from scoreloop.sources.manifest import SEQ, VersionedRows

BUCKET = "key_bucket"
# Inserts that a read merges at most before the touched partitions are folded.
COMPACT_AFTER = 16
# What an insert takes through the shuffle at a time, by Spark's estimate of the rows, and the types of keys
# of which equal values have equal hashes.
SLICE_BYTES = 1 << 30
SLICED_TYPES = {"string", "int", "bigint", "smallint", "tinyint", "date", "timestamp", "timestamp_ntz", "boolean"}


@dataclass(frozen=True)
class TableSpec:
    """A feature table: name, version, key, event time, partition column.

    Without a partition column the table is partitioned by a hash bucket of
    the primary key, so that a compaction rewrites only the buckets touched.
    The partition of a key must not change over time.
    """

    name: str
    version: int = 1
    primary_key: tuple[str, ...] = ()
    event_time: str | None = None
    partition_key: str | None = None
    buckets: int = 64
    description: str = ""
    schema: str = field(default="", compare=False)

    @property
    def key(self) -> list[str]:
        return list(dict.fromkeys([*self.primary_key, *([self.event_time] if self.event_time else [])]))

    @property
    def partition(self) -> str:
        return self.partition_key or BUCKET

    def with_partition(self, df: DataFrame) -> DataFrame:
        if self.partition_key is None:
            bucket = F.pmod(F.xxhash64(*self.primary_key), F.lit(self.buckets)).cast("int")
            return df.withColumn(BUCKET, bucket)
        if self.partition_key not in df.columns:
            return df.withColumn(self.partition_key, date_string(self.event_time))
        return df


def table_path(root: str, name: str, version: int) -> str:
    return f"{root.rstrip('/')}/{name}/v={version}"


def create_or_get(spark: SparkSession, root: str, spec: TableSpec, schema: T.StructType | str) -> TableSpec:
    """The stored spec of the table, else store this one for an empty table."""
    base = table_path(root, spec.name, spec.version)
    if exists(spark, f"{base}/spec"):
        return _stored_spec(spark, root, spec.name, spec.version)
    # An empty table has no partition folder yet; the spec keeps its schema.
    empty = spec.with_partition(spark.createDataFrame([], schema))
    created = replace(spec, schema=empty.schema.json())
    write_json(spark, f"{base}/spec", asdict(created))
    return created


def _rows(spark: SparkSession, root: str, spec: TableSpec) -> VersionedRows:
    schema = T.StructType.fromJson(json.loads(spec.schema))
    return VersionedRows(spark, f"{table_path(root, spec.name, spec.version)}/data", spec.partition, schema, whole=("rows",))


def _stored_spec(spark: SparkSession, root: str, name: str, version: int) -> TableSpec:
    base = table_path(root, name, version)
    if not exists(spark, f"{base}/spec"):
        raise FileNotFoundError(f"feature group {name!r} version {version}")
    stored = read_json(spark, f"{base}/spec")
    return TableSpec(**{**stored, "primary_key": tuple(stored["primary_key"])})


def _last_writes(spec: TableSpec) -> Callable[[Mapping[str, DataFrame]], DataFrame]:
    """Rows of a later insert replace those of an earlier one; an insert holds a key once.

    The partition is part of the grouping, so a filter on it reaches the scan.
    """
    keys = list(dict.fromkeys([*spec.key, spec.partition]))
    return lambda parts: latest_per_key(reduce(DataFrame.unionByName, parts.values()), keys, [SEQ])


def read_group(spark: SparkSession, root: str, name: str, version: int = 1, commit: int | None = None) -> DataFrame:
    """All rows of a feature table as of one commit (the newest unless named), without the internal bucket column.

    Later inserts do not change what the result reads.
    """
    spec = _stored_spec(spark, root, name, version)
    return _rows(spark, root, spec).read(_last_writes(spec), commit).drop(BUCKET)


def group_commits(spark: SparkSession, root: str, name: str, version: int = 1) -> list[int]:
    """The commits of a feature table that can be read, oldest first."""
    return sorted(_rows(spark, root, _stored_spec(spark, root, name, version)).versions())


def compact_group(spark: SparkSession, root: str, name: str, version: int = 1) -> bool:
    """Fold the inserts since the last compaction into the partitions they touch."""
    spec = _stored_spec(spark, root, name, version)
    return _rows(spark, root, spec).compact(_last_writes(spec))


def expire_group(spark: SparkSession, root: str, name: str, version: int = 1, keep: int = 10) -> int:
    """Forget all commits but the newest ones, with the files only they need."""
    return _rows(spark, root, _stored_spec(spark, root, name, version)).expire(keep)


def slices(rows: DataFrame, key: list[str]) -> list[DataFrame]:
    """Parts of large rows by a hash of the key, each written before the next is read, so that
    the shuffle files of one part lie on disk at a time. All rows are in one part each.

    Only rows that are read and projected are cut: those come out the same however often they are read.
    """
    plan = rows._jdf.queryExecution()
    todo, found = [plan.analyzed()], set()
    while todo:
        node = todo.pop()
        found.add(node.getClass().getSimpleName())
        todo += [node.children().apply(i) for i in range(node.children().size())]
    n = -(-int(str(plan.optimizedPlan().stats().sizeInBytes())) // SLICE_BYTES)
    plain = {"Project", "Filter", "SubqueryAlias", "View", "LogicalRelation", "Union"}
    exact = all(rows.schema[c].dataType.simpleString() in SLICED_TYPES for c in key)
    if n <= 1 or not key or not exact or not plan.analyzed().deterministic() or not found <= plain:
        return [rows]
    place = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in key], F.lit("slice")), F.lit(n))
    return [rows.filter(place == i) for i in range(n)]


def insert(
    spark: SparkSession, root: str, spec: TableSpec, df: DataFrame | list[DataFrame], order_by: Iterable[str] = (),
    batch: tuple[str, int] | None = None, compact_after: int = COMPACT_AFTER,
) -> bool:
    """Insert rows by (primary key, event time): new rows replace stored ones.

    Within one insert the last row in ``order_by`` wins; without an order the largest row
    does, so that the result is the same on every run. The insert writes its own rows only
    and becomes visible at once; after ``compact_after`` of them the touched partitions are
    folded. ``batch`` (source, rising number) makes a repeated insert a no-op. ``df`` may be given
    in parts that share no key and have the same columns; large rows are cut into such.
    """
    first = df[0] if isinstance(df, list) else df
    spec = create_or_get(spark, root, spec, first.schema)
    store = _rows(spark, root, spec)
    unknown = [c for c in spec.with_partition(first).columns if c not in store.schema.fieldNames()]
    if unknown:
        raise ValueError(f"columns not in feature group {spec.name!r}: {unknown}")
    order = list(order_by) or [c for c in first.columns if c not in spec.key]

    def typed(part: DataFrame) -> DataFrame:
        """Stored column order and types, missing columns as NULL."""
        rows = spec.with_partition(part)
        return rows.select(*[
            (F.col(f"`{f.name}`") if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in store.schema.fields
        ])

    parts = [typed(part) for part in df] if isinstance(df, list) else slices(typed(df), spec.key)
    done = store.append([latest_per_key(part, spec.key, order) for part in parts], "rows", batch)
    if done and len(store.manifest().deltas) >= compact_after:
        store.compact(_last_writes(spec))
    return done


# ---- loads from logs ------------------------------------------------------

# The three tables of the loop.
PREDICTION_GROUP = TableSpec("user_fat_percentage", 1, ("user_id", "email"), "timestamp", "date")
FEEDBACK_GROUP = TableSpec("user_fat_feedback", 1, ("user_id", "email"), "timestamp", "date")
BATCH_GROUP = TableSpec("user_fat_predictions", 1, ("user_id", "email"), "timestamp", "date")


def backfill(spark: SparkSession, root: str, spec: TableSpec, history_path: str, schema: str | None = None) -> bool:
    """Load a CSV history into the table; nothing happens when it is absent."""
    if not exists(spark, history_path):
        return False
    reader = spark.read.option("header", True)
    df = reader.schema(schema).csv(history_path) if schema else reader.option("inferSchema", True).csv(history_path)
    return insert(spark, root, spec, df.withColumn(spec.event_time, parse_timestamp(spec.event_time)))


def sync_logs(spark: SparkSession, root: str, predictions: DataFrame | None, feedback: DataFrame | None) -> tuple[bool, bool]:
    """Both logs into their feature tables; an absent or empty log is skipped."""
    done = [
        log is not None and insert(spark, root, spec, shape(log))
        for log, spec, shape in (
            (predictions, PREDICTION_GROUP, sync_predictions),
            (feedback, FEEDBACK_GROUP, sync_feedback),
        )
    ]
    return done[0], done[1]


# ---- views ----------------------------------------------------------------

def create_or_get_view(
    spark: SparkSession, root: str, name: str, spec: TableSpec, features: Iterable[str],
    labels: Iterable[str] = (), keys: Iterable[str] = (), version: int = 1,
) -> dict:
    """Store (once) a named select list with its labels over a feature table."""
    path = f"{table_path(root, name, version)}/view"
    if not exists(spark, path):
        write_json(spark, path, {
            "name": name, "group": spec.name, "group_version": spec.version,
            "features": list(features), "labels": list(labels), "keys": list(keys),
        })
    return read_json(spark, path)


def read_view(spark: SparkSession, root: str, name: str, version: int = 1) -> DataFrame:
    """The view's columns; also registered as a temporary view of that name."""
    view = read_json(spark, f"{table_path(root, name, version)}/view")
    df = read_group(spark, root, view["group"], view["group_version"])
    columns = [*view["features"], *view["labels"], *view["keys"]]
    out = df.select(*[F.col(f"`{c}`") for c in columns if c in df.columns])
    out.createOrReplaceTempView(name)
    return out


def view_features(df: DataFrame) -> list[str]:
    """Feature columns: everything but keys, times, partition, label, prediction."""
    return feature_columns(df, NON_FEATURES)
