"""Finding the keys that hold a large share of the rows.

One map-side sketch per input partition, merged once: no shuffle of the data
and at most ``limit`` result rows, so the result may be broadcast whatever the
size of the input. The sketch only steers how the work is split; results never
depend on which keys it names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOT = "__hot"
HOT_ROWS = "__hot_rows"
DEFAULT_HOT_ROWS = 10_000_000
HOT_LIMIT = 10_000
# Counts are off by at most 3.5 / SKETCH_ITEMS of all rows.
SKETCH_ITEMS = 65_536


def key_hash(keys: list[str]) -> Column:
    return F.xxhash64(*[F.col(k) for k in keys])


def hot_keys(df: DataFrame, keys: list[str], min_rows: int = DEFAULT_HOT_ROWS) -> DataFrame:
    """Key hashes (``__hot``) estimated at ``min_rows`` rows or more, with the estimate."""
    hashed = df.select(key_hash(keys).alias(HOT))
    top = hashed.agg(F.expr(f"approx_top_k({HOT}, {HOT_LIMIT}, {SKETCH_ITEMS})").alias("top"))
    return (
        top.select(F.inline("top"))
        .filter(F.col("count") >= min_rows)
        .select(F.col("item").alias(HOT), F.col("count").alias(HOT_ROWS))
    )


def shares(min_rows: int, most: int) -> Column:
    """Tasks to split a hot key over: one per ``min_rows`` rows, 2 to ``most``."""
    wanted = F.ceil(F.col(HOT_ROWS) / F.lit(min_rows))
    return F.least(F.greatest(wanted, F.lit(2)), F.lit(most)).cast("int")
