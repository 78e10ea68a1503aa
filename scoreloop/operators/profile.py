"""Describing a table: summary statistics, counts, histograms, samples."""

from __future__ import annotations

from collections.abc import Iterable
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloop.functions import nan_to_null
from scoreloop.operators.order_stats import exact_quantiles


def describe(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """count, mean, std (sample), min, quartiles (interpolated), max per column."""
    q = exact_quantiles(df, columns, [0.25, 0.5, 0.75], extra=[
        F.count("value").alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"),
    ])
    quartiles = [
        F.max(F.when(F.col("probability") == p, F.col("value"))).alias(name)
        for p, name in ((0.25, "p25"), (0.5, "p50"), (0.75, "p75"))
    ]
    return q.groupBy("column", "count", "mean", "std", "min", "max").agg(*quartiles).select(
        "column", "count", "mean", "std", "min", "p25", "p50", "p75", "max"
    )


def table_profile(df: DataFrame) -> DataFrame:
    """Per column: position, type, rows of the table, non-null values."""
    columns = df.columns
    counts = df.agg(
        F.count(F.lit(1)).alias("__rows"),
        *[F.count(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(columns)],
    )
    rows = F.array(*[
        F.struct(
            F.lit(i).alias("ordinal"), F.lit(c).alias("column"), F.lit(t).alias("dtype"),
            F.col("__rows").alias("rows"), F.col(f"n{i}").alias("non_null"),
        )
        for i, (c, t) in enumerate(df.dtypes)
    ])
    return counts.select(F.inline(rows))


def head(df: DataFrame, n: int, *order: str | Column) -> DataFrame:
    """First n rows in a stated order (tables have none of their own)."""
    if not order:
        raise ValueError("head needs an order")
    return df.orderBy(*order).limit(n)


def value_range(df: DataFrame, columns: Iterable[str], by: Iterable[str] = ()) -> DataFrame:
    """Smallest and largest value over all the columns."""
    values = [nan_to_null(F.col(f"`{c}`").cast("double")) for c in columns]
    low = [F.min(v) for v in values]
    high = [F.max(v) for v in values]
    return df.groupBy(*by).agg(
        (F.least(*low) if len(low) > 1 else low[0]).alias("min"),
        (F.greatest(*high) if len(high) > 1 else high[0]).alias("max"),
    )


def histogram(df: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """Equal-width bins over [min, max], empty ones included; the last holds the maximum.

    Without a value there is no bin. A constant column falls into the last bin
    of no width.
    """
    v = nan_to_null(F.col(f"`{column}`").cast("double"))
    data = df.select(v.alias("v")).filter("v is not null")
    span = data.agg(F.struct(F.min("v").alias("lo"), F.max("v").alias("hi")).alias("s")).scalar()
    lo, hi = span["lo"], span["hi"]
    width = (hi - lo) / bins
    at = F.when(hi == lo, F.lit(bins)).otherwise(F.floor((F.col("v") - lo) / width) + 1)
    number = F.least(at, F.lit(bins)).cast("int")
    counts = data.groupBy(number.alias("bin")).agg(F.count(F.lit(1)).alias("rows"))
    every = df.sparkSession.range(1, bins + 1).select(F.col("id").cast("int").alias("bin")).filter(lo.isNotNull())
    return every.join(counts, "bin", "left").select(
        "bin", (lo + width * (F.col("bin") - 1)).alias("low"), (lo + width * F.col("bin")).alias("high"),
        F.coalesce("rows", F.lit(0)).alias("rows"),
    )


def pair_grid(df: DataFrame, columns: Iterable[str], bins: int = 10) -> DataFrame:
    """Joint counts of every pair of columns on equal-width grids, empty cells included.

    Columns: ``x_name, y_name, x_bin, y_bin`` (from 1), the edges ``x_low, x_high, y_low,
    y_high`` and ``rows``. Spans and bins of a column are those of ``histogram``: over all
    its values, the last bin holding the maximum. A row counts for a pair where both values
    are there; pairs with a column without values are left out. All pairs are counted in one
    pass, combined before the shuffle, which moves a row per cell and task.
    """
    columns = list(columns)
    data = df.select(*[nan_to_null(F.col(f"`{c}`").cast("double")).alias(f"c{i}") for i, c in enumerate(columns)])
    ends = [F.struct(F.min(f"c{i}").alias("lo"), F.max(f"c{i}").alias("hi")).alias(f"c{i}") for i in range(len(columns))]
    spans = data.agg(F.struct(*ends).alias("s")).scalar()

    def bin_of(i: int) -> Column:
        lo, hi, v = spans[f"c{i}"]["lo"], spans[f"c{i}"]["hi"], F.col(f"c{i}")
        at = F.when(hi == lo, F.lit(bins)).otherwise(F.floor((v - lo) / ((hi - lo) / bins)) + 1)
        return F.when(v.isNotNull(), F.least(at, F.lit(bins)).cast("int"))

    binned = data.select(*[bin_of(i).alias(f"b{i}") for i in range(len(columns))])
    pairs = list(combinations(range(len(columns)), 2))
    cells = F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.col(f"b{a}").alias("x_bin"), F.col(f"b{b}").alias("y_bin")) for a, b in pairs])
    counted = binned.select(F.inline(cells)).filter("x_bin is not null and y_bin is not null").groupBy("x", "y", "x_bin", "y_bin").agg(F.count(F.lit(1)).alias("rows"))
    ids = df.sparkSession.range(len(pairs) * bins * bins).select(
        F.get(F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y")) for a, b in pairs]), F.expr(f"int(id div {bins * bins})")).alias("p"),
        F.expr(f"int(id div {bins} % {bins}) + 1").alias("x_bin"), F.expr(f"int(id % {bins}) + 1").alias("y_bin"),
    ).select("p.x", "p.y", "x_bin", "y_bin")
    full = ids.join(counted, ["x", "y", "x_bin", "y_bin"], "left")

    def edges(side: str) -> list[Column]:
        lo = F.get(F.array(*[spans[f"c{i}"]["lo"] for i in range(len(columns))]), F.col(side))
        hi = F.get(F.array(*[spans[f"c{i}"]["hi"] for i in range(len(columns))]), F.col(side))
        at, width = F.col(f"{side}_bin"), (hi - lo) / bins
        return [(lo + width * (at - 1)).alias(f"{side}_low"), (lo + width * at).alias(f"{side}_high")]

    names = F.array(*[F.lit(c) for c in columns])
    out = full.select(
        F.get(names, F.col("x")).alias("x_name"), F.get(names, F.col("y")).alias("y_name"), "x_bin", "y_bin",
        *edges("x"), *edges("y"), F.coalesce("rows", F.lit(0)).alias("rows"),
    )
    return out.filter("x_low is not null and y_low is not null")


def pair_sample(df: DataFrame, columns: Iterable[str], key: str, n: int = 1000, seed: int = 42) -> DataFrame:
    """Scatter points (x_name, y_name, x, y) of n rows picked by key hash.

    The pick is a top-n by hash, the same whatever the partitioning.
    """
    columns = list(columns)
    picked = (
        df.select(key, *columns)
        .withColumn("__h", F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))))
        .orderBy("__h", key)
        .limit(n)
    )
    points = F.array(*[
        F.struct(
            F.lit(a).alias("x_name"), F.lit(b).alias("y_name"),
            F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y"),
        )
        for a, b in combinations(columns, 2)
    ])
    return picked.select(key, F.inline(points))
