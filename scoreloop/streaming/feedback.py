"""Streaming feedback: patches folded into a bucketed ledger snapshot.

The snapshot holds versioned rows partitioned by a hash bucket of the id. A micro-batch adds
its own writes or folded patches as a delta and becomes visible at once; reading folds the
deltas over the merged rows, and now and then they are folded for good. Every part of a patch
is stored with the event time it came from, and a part is replaced only by a later one, so
late and replayed batches change nothing they should not.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery

from scoreloop.operators.ledger import (
    ERROR_FIELDS,
    LABEL_FIELDS,
    fold_patches,
    latest_per_key,
    merge_patches,
    patches_from_feedback,
    route_feedback,
)
from scoreloop.operators.quality import FEEDBACK_RULES, split_valid
from scoreloop.sources.files import exists, read_json, write_json
from scoreloop.sources.manifest import BASE, VersionedRows
from scoreloop.streaming.batches import query_id, without_repeats

FEEDBACK_SCHEMA = (
    "prediction_id string, email string, timestamp timestamp, "
    "real_fat_percentage double, predicted_fat_percentage double"
)
BUCKET = "id_bucket"
ORDERS = ("label_order", "error_order")
WRITE, PATCH = "write", "patch"


class LedgerSnapshot:
    """A keyed ledger on plain Parquet, updated by predictions and patches.

    Its rows are the last write per id merged with the folded patches of the id, in whatever
    order writes and patches arrive. The bucket count and the order of writes of an existing
    snapshot are read from its spec. A delta costs what its rows cost; after
    ``compact_after`` of them the touched buckets are folded.
    """

    def __init__(self, spark: SparkSession, path: str, key: str = "prediction_id", buckets: int = 64, compact_after: int = 16):
        self.spark, self.path, self.key, self.compact_after = spark, path.rstrip("/"), key, compact_after
        spec = f"{self.path}/spec"
        self.buckets = read_json(spark, spec)["buckets"] if exists(spark, spec) else buckets

    def _spec(self) -> tuple[VersionedRows, list[str]]:
        """The stored rows, and the columns that decide between writes of one id."""
        spec = read_json(self.spark, f"{self.path}/spec")
        schema = T.StructType.fromJson(spec["schema"])
        rest = [n for n in schema.fieldNames() if n not in {self.key, BUCKET, *spec["order"], *LABEL_FIELDS, *ERROR_FIELDS, *ORDERS}]
        return VersionedRows(self.spark, f"{self.path}/data", BUCKET, schema), [*spec["order"], *rest]

    def _bucketed(self, df: DataFrame) -> DataFrame:
        return df.withColumn(BUCKET, F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int"))

    def create(self, predictions: DataFrame, order: list[str]) -> None:
        """Start from logged predictions, the last write per id; on a tie the larger row."""
        rest = [c for c in predictions.columns if c not in {self.key, *order, *LABEL_FIELDS, *ERROR_FIELDS, *ORDERS}]
        base = latest_per_key(predictions, [self.key], [*order, *rest])
        none = self.spark.createDataFrame([], FEEDBACK_SCHEMA)
        nothing = fold_patches(patches_from_feedback(none), "prediction_id").withColumnRenamed("prediction_id", self.key)
        rows = self._bucketed(merge_patches(base, nothing, self.key, keep_order=True))
        write_json(self.spark, f"{self.path}/spec", {"schema": rows.schema.jsonValue(), "buckets": self.buckets, "order": list(order)})
        self._spec()[0].replace_all(rows)

    def _merge(self, parts: Mapping[str, DataFrame]) -> DataFrame:
        """Last write per id (equal times: the larger row), then the folded patches."""
        _, order = self._spec()
        own = [*LABEL_FIELDS, *ERROR_FIELDS]
        writes = [
            df.select(self.key, *order, F.when(F.lit(kind == BASE), F.struct(*own)).alias("own"))
            for kind, df in parts.items()
        ]
        # A label that came with a logged row, not by a patch, is the merged row's own.
        written = reduce(DataFrame.unionByName, writes).groupBy(self.key).agg(
            F.max(F.struct(*order)).alias("w"), F.first("own", ignorenulls=True).alias("own")
        ).select(self.key, "w.*", "own.*")
        fields = [self.key, *LABEL_FIELDS, *ERROR_FIELDS, *ORDERS]
        patches = [df.filter("label_order is not null").select(*fields) for df in parts.values()]
        folded = fold_patches(reduce(DataFrame.unionByName, patches), self.key)
        return self._bucketed(merge_patches(written, folded, self.key, keep_order=True))

    def read(self, version: int | None = None) -> DataFrame:
        """The ledger as of one version, the newest unless named."""
        return self._spec()[0].read(self._merge, version).drop(BUCKET, *ORDERS)

    def versions(self) -> list[int]:
        return sorted(self._spec()[0].versions())

    def compact(self) -> bool:
        return self._spec()[0].compact(self._merge)

    def _add(self, rows: DataFrame, kind: str, batch: tuple[str, int] | None) -> bool:
        store, _ = self._spec()
        done = store.append(self._bucketed(rows), kind, batch)
        if done and len(store.manifest().deltas) >= self.compact_after:
            store.compact(self._merge)
        return done

    def put(self, predictions: DataFrame, batch: tuple[str, int] | None = None) -> bool:
        """Whole-row writes: the later write of an id wins.

        Feedback already received for the id is kept, also when it came ahead
        of its prediction. ``batch`` makes a repeated call a no-op.
        """
        _, order = self._spec()
        latest = latest_per_key(predictions, [self.key], [c for c in order if c in predictions.columns])
        return self._add(latest.select(self.key, *[c for c in order if c in predictions.columns]), WRITE, batch)

    def apply(self, feedback: DataFrame, batch: tuple[str, int] | None = None) -> bool:
        """Fold feedback rows that name a prediction into the snapshot."""
        return self._add(fold_patches(patches_from_feedback(feedback, self.key), self.key), PATCH, batch)


def apply_feedback_stream(
    feedback: DataFrame, snapshot: LedgerSnapshot, checkpoint: str, orphans: str, invalid: str | None = None,
    distinct_within: str | None = None, **trigger,
) -> StreamingQuery:
    """Patch the snapshot from a feedback stream, one micro-batch at a time.

    Feedback that names no prediction is kept under ``orphans``. With ``invalid``, rows that
    break a feedback rule go there with their reasons, and only valid ones are applied. With
    ``distinct_within`` (see ``without_repeats``) a source that repeats rows counts each once.
    """
    if distinct_within:
        feedback = without_repeats(feedback, feedback.columns, "timestamp", distinct_within)

    def batch(df: DataFrame, batch_id: int) -> None:
        df = df.persist()
        good = df
        if invalid:
            good, bad = split_valid(df, FEEDBACK_RULES)
            bad.write.mode("overwrite").parquet(f"{invalid}/batch={batch_id}")
        snapshot.apply(good, (query_id(snapshot.spark, checkpoint), batch_id))
        # One folder per batch, overwritten on replay.
        _, loose = route_feedback(good, snapshot.key)
        loose.write.mode("overwrite").parquet(f"{orphans}/batch={batch_id}")
        df.unpersist()

    return (
        feedback.writeStream.foreachBatch(batch)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def read_feedback(spark: SparkSession, path: str, schema: T.StructType | str = FEEDBACK_SCHEMA, fmt: str = "json", files_per_trigger: int = 1000) -> DataFrame:
    """A stream over feedback files as they arrive in a folder."""
    return spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files_per_trigger).load(path)
