"""Order-preserving cells: split ordered work on one key over many tasks.

Cell borders are approximate percentiles. They decide only how evenly the rows
spread; any borders give the same final result, because running totals are
carried from cell to cell exactly.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def most_shares(df: DataFrame) -> int:
    """Upper bound of tasks for one key: a few per task of a session's shuffle."""
    return 4 * max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def borders(value: str, cells: int) -> Column:
    """Aggregate: sorted inner borders that cut column ``value`` into about equal cells."""
    # As one SQL text: thousands of literals as Column objects are slow to build.
    cuts = ", ".join(f"{i / cells!r}D" for i in range(1, cells))
    return F.expr(f"percentile_approx({value}, array({cuts}), {20 * cells})")


def thin(edges: Column, cells: int, wanted: Column) -> Column:
    """Every n-th border, leaving about ``wanted`` cells of ``cells``."""
    step = F.greatest(F.lit(1), F.floor(F.lit(cells) / wanted))
    return F.filter(edges, lambda _, i: (i + 1) % step == 0)


def cell_of(value: Column, edges: Column, cells: int) -> Column:
    """Number of borders below ``value``: a two-level scan, about 2*sqrt(cells) tests."""
    step = max(1, math.isqrt(cells))
    coarse = F.filter(edges, lambda e, i: ((i + 1) % step == 0) & (e < value))
    passed = F.size(coarse) * step
    fine = F.filter(F.slice(edges, passed + 1, F.lit(step)), lambda e: e < value)
    return F.when(edges.isNull() | value.isNull(), F.lit(0)).otherwise(passed + F.size(fine))
