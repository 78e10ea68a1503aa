"""Vectors as blocks: cleaning, principal axes, a global order, and packing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scoreloop.llm.common import stored


def usable(vec: str) -> Column:
    """Not null, and no component null, NaN or infinite."""
    big = F.lit(float("inf"))
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < big))
    return F.coalesce(fine, F.lit(False))


def matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    """Rows of a list column as a float64 matrix, padded with zeros to ``width``."""
    lists = column.to_pylist()
    width = max(map(len, lists), default=0) if width is None else width
    out = np.zeros((len(lists), width))
    for row, values in enumerate(lists):
        out[row, : len(values)] = values
    return out


def principal_axes(vectors: DataFrame, vec: str, width: int) -> np.ndarray:
    """The orthogonal axes (columns) of all vectors, by falling second moment.

    Each task adds up its own moments; Spark adds those by entry, so the driver gets
    ``width * width`` numbers, whatever the number of rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            x = matrix(batch.column(0), width)
            x /= np.maximum(np.abs(x).max(1, initial=0.0, keepdims=True), 1e-300)
            total += x.T @ x
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()[at])], names=["at", "v"])

    found = vectors.select(vec).mapInArrow(run, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).toArrow()
    moments = np.zeros(width * width)
    moments[found.column("at").to_numpy()] = found.column("v").to_numpy()
    moments = moments.reshape(width, width)
    return np.linalg.eigh((moments + moments.T) / 2)[1][:, ::-1].copy()


def numbered(df: DataFrame, order: list[str], name: str = "pos") -> DataFrame:
    """``df`` with each row's place (from 0) in the order of some columns, as a stored table.

    Rows are dealt out by ranges and sorted there; the places before a range come from
    one count per range. ``order`` should tell all rows apart, or a hot value stays together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            own = [pa.array(np.full(n, part, np.int32)), pa.array(np.arange(at, at + n))]
            at += n
            yield pa.RecordBatch.from_arrays([*batch.columns, *own], names=[*batch.schema.names, "_part", "_at"])

    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    schema = df.select("*", F.lit(0).alias("_part"), F.lit(0).cast("long").alias("_at")).schema
    dealt = stored(ranged.mapInArrow(run, schema), "ordered")
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy("_part").count()
    before = counts.select("_part", F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("_before"))
    return dealt.join(before, "_part").withColumn(name, F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")


def packed(rows: DataFrame, block: Column, fields: dict[str, str], vec: str, width: int) -> DataFrame:
    """One row per block of a bounded number of rows: ``block``, arrays of ``fields`` (name to type), ``x`` (float64 bytes)."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        x = np.zeros((len(frame), width))
        for k, values in enumerate(frame[vec]):
            x[k, : len(values)] = values
        made = {name: [frame[name].tolist()] for name in fields}
        return pd.DataFrame({"block": [int(frame["block"].iloc[0])], **made, "x": [x.tobytes()]})

    schema = "block long, " + ", ".join(f"{n} array<{t}>" for n, t in fields.items()) + ", x binary"
    return rows.select(block.cast("long").alias("block"), *fields, vec).groupBy("block").applyInPandas(run, schema)
