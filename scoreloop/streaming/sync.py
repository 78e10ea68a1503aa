"""Continuous sync of the logs into their feature tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming.query import StreamingQuery

from scoreloop.operators.ledger import sync_feedback, sync_predictions
from scoreloop.sources.feature_groups import FEEDBACK_GROUP, PREDICTION_GROUP, TableSpec, insert
from scoreloop.streaming.batches import query_id


def insert_stream(
    log: DataFrame, root: str, spec: TableSpec, shape: Callable[[DataFrame], DataFrame], checkpoint: str, **trigger
) -> StreamingQuery:
    """Insert a stream of log rows, brought into table form by ``shape``, one micro-batch at a time.

    The table remembers the batches it took in, so a batch that Spark runs again after a
    failure changes nothing. A key that comes again, in any batch, replaces the stored row.
    """

    def batch(df: DataFrame, batch_id: int) -> None:
        insert(df.sparkSession, root, spec, shape(df), batch=(query_id(df.sparkSession, checkpoint), batch_id))

    return (
        log.writeStream.foreachBatch(batch)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def sync_prediction_stream(log: DataFrame, root: str, checkpoint: str, spec: TableSpec = PREDICTION_GROUP, **trigger) -> StreamingQuery:
    """The prediction log into its feature table as it grows; labels are still unknown there."""
    return insert_stream(log, root, spec, sync_predictions, checkpoint, **trigger)


def sync_feedback_stream(log: DataFrame, root: str, checkpoint: str, spec: TableSpec = FEEDBACK_GROUP, **trigger) -> StreamingQuery:
    """The feedback log into its feature table as it grows."""
    return insert_stream(log, root, spec, sync_feedback, checkpoint, **trigger)
