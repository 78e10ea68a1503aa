"""Exact order statistics without sorting a column in one task.

One pass counts every column and sketches its values; two points of the sketch bracket each
wanted rank and its successor. A bracket that may hold many rows is counted exactly and
sketched again, in one pass for all brackets. A bracket of few rows has its values counted one
by one, again in one pass for all, which yields the element and proves its rank: sketches
only steer, and a bracket that missed its rank is widened and counted again. Two passes do up
to some hundred thousand rows; each further one does over a thousand times more.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloop.functions import nan_to_null

ACCURACY = 100_000
# Rows of a bracket that are looked at one by one.
LAST_ROWS = 1_000
# Points of a sketch.
GRID = 4096
# As SQL text: thousands of literals one by one take seconds to build.
POINTS = f"array({', '.join(f'{i / GRID!r}D' for i in range(GRID + 1))})"


def _sketch(value: str, accuracy: int) -> Column:
    return F.expr(f"percentile_approx({value}, {POINTS}, {accuracy})")


@dataclass(frozen=True)
class Bracket:
    """Ranks still wanted, all inside (lo, hi); ``start`` rows lie below it, ``inside`` in it."""

    column: str
    ranks: tuple[int, ...]
    lo: object
    hi: object
    start: int
    inside: int
    grid: tuple
    widen: int = 1

    def reach(self, accuracy: int) -> int:
        """Sketch points around a rank that surely hold it."""
        return self.widen * (1 + math.ceil(2 * GRID / accuracy))

    def few(self, accuracy: int, last_rows: int) -> bool:
        return self.inside * min(1.0, (2 * self.reach(accuracy) + 2) / GRID) <= last_rows

    def pivots(self, accuracy: int) -> tuple[object, object]:
        at = [(r - self.start) / self.inside * GRID for r in (self.ranks[0], self.ranks[-1] + 1)]
        first, last = math.floor(at[0]) - self.reach(accuracy), math.ceil(at[1]) + self.reach(accuracy)
        return (self.lo if first <= 0 else self.grid[first]), (self.hi if last >= GRID else self.grid[last])


def _inside(long: DataFrame, cuts: list[tuple]) -> DataFrame:
    """Rows of ``long`` per bracket of their column, up to its upper pivot."""
    kind = long.schema["value"].dataType.simpleString()
    bounds = long.sparkSession.createDataFrame(cuts, f"name int, b_column string, low {kind}, high {kind}")
    hit = F.broadcast(bounds)  # a bracket per wanted rank
    return long.join(hit, F.col("column") == F.col("b_column")).filter(F.col("value") <= F.col("high"))


def _narrowed(long: DataFrame, brackets: list[Bracket], accuracy: int, found: dict) -> list[Bracket]:
    """One pass: each bracket counted between its pivots and sketched again; elements at pivots go to ``found``."""
    cuts = [(i, b.column, *b.pivots(accuracy)) for i, b in enumerate(brackets)]
    v, low, high = F.col("value"), F.col("low"), F.col("high")
    open_ = (v > low) & (v < high)
    counts = _inside(long, cuts).groupBy("name").agg(
        F.count_if(v < low).alias("below"), F.count_if(v == low).alias("at_low"), F.count_if(open_).alias("between"),
        F.count_if((v == high) & (high > low)).alias("at_high"), _sketch("case when value > low and value < high then value end", accuracy).alias("grid"),
    )
    got = {r["name"]: r for r in counts.collect()}  # a row per bracket
    out = []
    for i, b in enumerate(brackets):
        r, (low, high) = got.get(i), cuts[i][2:]
        ends = [0, 0, 0, 0]
        if r:
            start = r["below"]
            ends = [start, start + r["at_low"], start + r["at_low"] + r["between"], start + r["at_low"] + r["between"] + r["at_high"]]
        inner = tuple(k for k in b.ranks if ends[1] <= k < ends[2])
        for k in b.ranks:
            if ends[0] <= k < ends[1]:
                found[b.column, k] = low
            elif ends[2] <= k < ends[3]:
                found[b.column, k] = high
        if inner:
            out.append(Bracket(b.column, inner, low, high, ends[1], r["between"], tuple(r["grid"])))
        missed = tuple(k for k in b.ranks if not ends[0] <= k < ends[3])
        if missed:
            out.append(replace(b, ranks=missed, widen=4 * b.widen))
    return out


def _read_off(long: DataFrame, brackets: list[Bracket], accuracy: int, found: dict) -> list[Bracket]:
    """One pass: the values between the pivots counted one by one; gives the brackets that missed."""
    cuts = [(i, b.column, *b.pivots(accuracy)) for i, b in enumerate(brackets)]
    seen = F.when(F.col("value") >= F.col("low"), F.col("value"))
    counts: dict[int, list[tuple]] = {}
    for r in _inside(long, cuts).groupBy("name", seen.alias("value")).agg(F.count(F.lit(1)).alias("c")).collect():  # last_rows a bracket
        counts.setdefault(r["name"], []).append((r["value"], r["c"]))
    out = []
    for i, b in enumerate(brackets):
        own = counts.get(i, [])
        at = sum(c for v, c in own if v is None)
        for v, c in sorted((e for e in own if e[0] is not None), key=lambda e: e[0]):
            for k in b.ranks:
                if at <= k < at + c:
                    found[b.column, k] = v
            at += c
        missed = tuple(k for k in b.ranks if (b.column, k) not in found)
        if missed:
            out.append(replace(b, ranks=missed, widen=4 * b.widen))
    return out


def order_statistics(
    long: DataFrame,
    targets: Iterable[tuple[str, Callable[[int], int]]],
    accuracy: int = ACCURACY,
    last_rows: int = LAST_ROWS,
    extra: Iterable[Column] = (),
) -> DataFrame:
    """Elements at given ranks of ``value`` per ``column``.

    ``long`` has columns (column, value) without NULLs. Each target is
    (label, row count -> 0-based rank). Result: (column, target, n, rank,
    at_rank, next), ``next`` being the following element in order (NULL after
    the last), and any ``extra`` aggregates of the column. Runs its passes when
    called; a sketch per column and a row per column and target reach the driver.
    """
    targets, extra, spark = list(targets), list(extra), long.sparkSession
    base = long.groupBy("column").agg(
        F.count("value").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"),
        _sketch("value", accuracy).alias("grid"), *extra,
    )
    columns, wanted, brackets = base.collect(), [], []
    for r in columns:
        for label, rank_of in targets:
            rank = int(rank_of(r["n"]))
            wanted.append((r["column"], label, r["n"], rank))
            ranks = tuple(k for k in (rank, rank + 1) if 0 <= k < r["n"])
            if ranks:
                brackets.append(Bracket(r["column"], ranks, r["lo"], r["hi"], 0, r["n"], tuple(r["grid"])))
    found: dict[tuple[str, int], object] = {}
    while brackets:
        wide = [b for b in brackets if not b.few(accuracy, last_rows)]
        if wide:
            brackets = [b for b in brackets if b.few(accuracy, last_rows)] + _narrowed(long, wide, accuracy, found)
        else:
            brackets = _read_off(long, brackets, accuracy, found)
    kind = long.schema["value"].dataType.simpleString()
    looked_up = spark.createDataFrame(
        [(c, label, n, rank, found.get((c, rank)), found.get((c, rank + 1))) for c, label, n, rank in wanted],
        f"column string, target string, n bigint, rank bigint, at_rank {kind}, next {kind}",
    )
    if not extra:
        return looked_up
    kept = base.drop("n", "lo", "hi", "grid").schema
    return looked_up.join(spark.createDataFrame([tuple(r[c] for c in kept.fieldNames()) for r in columns], kept), "column")


def to_long(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """(column, value) rows of numeric columns, missing values dropped."""
    columns = list(columns)
    doubles = df.select(*[nan_to_null(F.col(f"`{c}`").cast("double")).alias(c) for c in columns])
    return doubles.unpivot([], [F.col(f"`{c}`") for c in columns], "column", "value").filter(
        "value is not null"
    )


def exact_quantiles(
    df: DataFrame, columns: Iterable[str], probabilities: Iterable[float], accuracy: int = ACCURACY,
    last_rows: int = LAST_ROWS, extra: Iterable[Column] = (),
) -> DataFrame:
    """(column, probability, value) with linear interpolation between neighbours.

    ``extra`` aggregates of ``value`` come from the same pass and are added.
    """
    probabilities, extra = list(probabilities), list(extra)

    def rank_of(p: float) -> Callable[[int], int]:
        return lambda n: math.floor(p * (n - 1))

    found = order_statistics(
        to_long(df, columns), [(repr(p), rank_of(p)) for p in probabilities], accuracy, last_rows, extra
    )
    position = F.col("target").cast("double") * (F.col("n") - 1)
    share = position - F.col("rank")
    value = F.when(share > 0, F.col("at_rank") + share * (F.col("next") - F.col("at_rank")))
    names = [c for c in found.columns if c not in ("column", "target", "n", "rank", "at_rank", "next")]
    return found.select(
        "column", F.col("target").cast("double").alias("probability"),
        value.otherwise(F.col("at_rank")).alias("value"), *names,
    )


def medians(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """(column, value): exact median per numeric column."""
    return exact_quantiles(df, columns, [0.5]).select("column", "value")


def modes(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """(column, value): most frequent text per column, ties to the smallest.

    Counts per value shuffle first, so no task holds a whole column.
    """
    columns = list(columns)
    texts = df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in columns])
    counts = (
        texts.unpivot([], [F.col(f"`{c}`") for c in columns], "column", "value")
        .filter("value is not null")
        .groupBy("column", "value")
        .agg(F.count(F.lit(1)).alias("c"))
    )
    best = F.min(F.struct((-F.col("c")).alias("neg"), "value"))
    return counts.groupBy("column").agg(best.alias("b")).select("column", F.col("b.value").alias("value"))
