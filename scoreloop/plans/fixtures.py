"""The loop's tables (log, feedback, training set ...) derived from the test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreloop.functions import iso_utc
from scoreloop.functions.vocabulary import PREDICTED, REAL

NUMERIC = ["l_quantity", "l_discount", "l_tax", "p_size", "p_retailprice", "ratio", "log_quantity"]
CATEGORICAL = ["l_returnflag", "l_linestatus"]
LABEL = "y"
KEY = "row_key"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shifted(ts: str | Column, micros: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(ts) + micros)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with the time as an instant."""
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def prediction_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a logged prediction with its request fields."""
    e, u = F.col("event_id"), F.col("user_id")
    kinds = F.array(*[F.lit(k) for k in ("Cardio", "Strength", "Mixed")])
    return events(spark, sf_dir).select(
        e.cast("string").alias("prediction_id"),
        u.cast("string").alias("user_id"),
        F.concat(F.lit("User"), u, F.lit("@Example.com")).alias("email"),
        F.col("ts").alias("timestamp"),
        F.col("value").alias(PREDICTED),
        (10 + u % 91).cast("int").alias("age"),
        F.when(u % 2 == 0, "Male").otherwise("Female").alias("gender"),
        (30 + (e % 1700) / 10.0).alias("weight_kg"),
        (1.2 + (u % 100) / 100.0).alias("height_m"),
        (80 + e % 141).cast("int").alias("max_bpm"),
        (60 + e % 141).cast("int").alias("avg_bpm"),
        (30 + e % 91).cast("int").alias("resting_bpm"),
        (0.1 + (e % 40) / 10.0).alias("session_duration_hours"),
        (F.col("value") * 10).alias("calories_burned"),
        F.get(kinds, (e % 3).cast("int")).alias("workout_type"),
        ((e % 101) / 10.0).alias("water_intake_liters"),
        (1 + e % 7).cast("int").alias("workout_frequency_days_week"),
        (1 + e % 4).cast("string").alias("experience_level"),
    )


def feedback_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views and clicks come back as feedback; clicks repeat the prediction."""
    e = F.col("event_id")
    return events(spark, sf_dir).filter(F.col("event_type").isin("view", "click")).select(
        F.when(e % 11 == 0, F.lit(None)).when(e % 12 == 0, "").when(e % 13 == 0, (e + 100_000_000).cast("string"))
        .otherwise(e.cast("string")).alias("prediction_id"),
        F.col("user_id").cast("string").alias("user_id"),
        F.concat(F.lit("User"), "user_id", F.lit("@Example.com")).alias("email"),
        shifted("ts", (e % 5 - 2) * 200_000).alias("timestamp"),
        (F.col("value") * (1 + (e % 7 - 3) / 20.0)).alias(REAL),
        F.when(F.col("event_type") == "click", F.col("value")).alias(PREDICTED),
    )


def repeated_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feedback log, and an hour later a correction without a prediction."""
    first = feedback_log(spark, sf_dir)
    later = first.filter(F.col(PREDICTED).isNotNull()).withColumns({
        "timestamp": shifted("timestamp", F.lit(3_600_000_000)),
        REAL: F.col(REAL) * 1.1,
        PREDICTED: F.lit(None).cast("double"),
    })
    return first.unionByName(later)


def log_with_text_times(df: DataFrame) -> DataFrame:
    """A log as it lies in a file: ISO text times, unparsable for some users."""
    bad = F.col("email").startswith("User7")
    return df.withColumn("timestamp", F.when(bad, "not a time").otherwise(iso_utc("timestamp")))


def training_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineitem with its part and a label of known signal and little noise.

    The part table is joined on its key; its size is left to Spark to judge.
    """
    li, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    q = F.col("l_quantity")
    label = (
        10 + 5 * F.ln(q) + 40 * F.col("l_discount")
        + F.when(F.col("l_returnflag") == "A", 2).otherwise(0) + (F.col("l_partkey") % 7 - 3) / 3.0
    )
    return li.join(part, li["l_partkey"] == part["p_partkey"]).select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias(KEY),
        "l_partkey", "l_suppkey",
        *[c for c in NUMERIC if c not in ("ratio", "log_quantity")],
        (F.col("l_extendedprice") / (q * q)).alias("ratio"),
        F.log1p(q).alias("log_quantity"),
        *CATEGORICAL,
        label.alias(LABEL),
    )


def with_gaps(df: DataFrame) -> DataFrame:
    """Training rows with missing taxes and return flags."""
    return df.withColumns({
        "l_tax": F.when(F.col("l_partkey") % 10 != 0, F.col("l_tax")),
        "l_returnflag": F.when(F.col("l_suppkey") % 9 != 0, F.col("l_returnflag")),
    })
