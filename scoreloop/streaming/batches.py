"""What streams into keyed tables share: naming batches, and sources that repeat rows."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from scoreloop.sources.files import read_text


def query_id(spark: SparkSession, checkpoint: str) -> str:
    """The id Spark gave the query of this checkpoint when it first started.

    Batch numbers rise within it, over restarts too; a new checkpoint starts at 0 under a
    new id. So (id, batch number) names a batch for good.
    """
    return json.loads(read_text(spark, f"{checkpoint.rstrip('/')}/metadata"))["id"]


def without_repeats(stream: DataFrame, keys: Iterable[str], time: str, within: str) -> DataFrame:
    """The first row of each key of a stream whose source may deliver rows again.

    ``within`` is how far apart in event time repeats may lie, and how late a row may come;
    state older than that behind the newest time seen is dropped, and so are rows that
    late. Null times never count as late.
    """
    return stream.withWatermark(time, within).dropDuplicatesWithinWatermark(list(keys))
