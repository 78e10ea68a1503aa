"""Streaming score: request records in, prediction log rows out."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType

from scoreloop.functions import normalise_email, truncate_to_second
from scoreloop.operators.quality import REQUEST_RULES, split_valid
from scoreloop.plans.scoring import score_records
from scoreloop.streaming.batches import without_repeats

# The fields of a scoring request.
REQUEST_SCHEMA = (
    "email string, timestamp timestamp, age int, gender string, weight_kg double, height_m double, "
    "max_bpm int, avg_bpm int, resting_bpm int, session_duration_hours double, calories_burned double, "
    "workout_type string, water_intake_liters double, workout_frequency_days_week int, experience_level string"
)
# What tells scored requests apart: the parts of a prediction's id.
REQUEST_KEY = ("email", "timestamp")


def read_requests(spark: SparkSession, path: str, schema: StructType | str = REQUEST_SCHEMA, fmt: str = "json", files_per_trigger: int = 1000) -> DataFrame:
    """A stream over request files as they arrive in a folder."""
    return spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files_per_trigger).load(path)


def score_stream(
    requests: DataFrame, model: PipelineModel, out: str, checkpoint: str, quarantine: str,
    distinct_within: str | None = None, **trigger,
) -> list[StreamingQuery]:
    """Append scored rows to a Parquet log; invalid requests go to ``quarantine``.

    The file sink and the checkpoint make each row of the source appear in the log exactly
    once. A source that itself repeats rows needs ``distinct_within`` (see
    ``without_repeats``): of valid requests with one prediction id (email and second) the first is
    scored, and equal invalid ones are set aside once, so neither hides the other; otherwise no
    state is kept and there is no watermark.
    """
    trigger = trigger or {"availableNow": True}
    valid, invalid = split_valid(requests, REQUEST_RULES)
    if distinct_within:
        named = valid.withColumns({"email": normalise_email("email"), "timestamp": truncate_to_second("timestamp")})
        valid = without_repeats(named, REQUEST_KEY, "timestamp", distinct_within)
        invalid = without_repeats(invalid, requests.columns, "timestamp", distinct_within)

    def start(df: DataFrame, path: str, state: str) -> StreamingQuery:
        return (
            df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", state)
            .trigger(**trigger).start(path)
        )

    return [
        start(score_records(valid, model), out, f"{checkpoint}/scored"),
        start(invalid, quarantine, f"{checkpoint}/quarantine"),
    ]
