"""Near-duplicate vectors by an epsilon grid order join.

On unit vectors a cosine of at least c is a distance of at most eps = sqrt(2 - 2c). The
vectors are sorted by their grid cells (side eps) along the leading principal axes, label
first. The sorted sequence is cut into blocks, blocks into intervals of blocks, and so on
upwards; an interval knows its range of labels and its box along the axes. The join starts
with pairs of the longest intervals and goes down: a pair whose boxes are more than eps
apart, or whose labels do not meet, is dropped with all that lies inside. What remains are
pairs of blocks, each compared in one matrix product.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreloop.llm.common import components, stored
from scoreloop.llm.vectors import matrix, numbered, packed, principal_axes, usable

BLOCK_ROWS = 1024
# Intervals that make up the next longer one.
FAN = 8
# Leading axes whose cells make the order, and axes that boxes are kept along.
CELL_AXES, BOX_AXES = 4, 16


def _prepared(rows: DataFrame, key: str, vec: str, label: str) -> DataFrame:
    """Distinct usable vectors by label with their number and smallest key; ``h1, h2`` name them."""
    rows = rows.select(F.col(key).alias("key"), F.col(label).alias("label"), F.col(vec).cast("array<double>").alias("vec"))
    good = usable("vec") & F.col("label").isNotNull() & F.exists("vec", lambda x: x != 0)
    clean = F.when(good, F.transform("vec", lambda x: x + F.lit(0.0)))
    rows = rows.withColumn("vec", clean)
    # 128 bits stand for label and vector in joins.
    return rows.select(
        "key", "label", "vec",
        F.when(F.col("vec").isNotNull(), F.xxhash64("label", "vec")).alias("h1"),
        F.when(F.col("vec").isNotNull(), F.xxhash64(F.lit("second"), "vec", "label")).alias("h2"),
    )


def _close_blocks(blocks: DataFrame, eps: float) -> DataFrame:
    """Pairs ``(a, b)``, a <= b, of blocks whose boxes lie within ``eps`` and whose labels meet."""
    axes = len(blocks.select("lo").head()[0])

    def interval(level: int) -> DataFrame:
        parts = [F.min(F.col("lo")[i]) for i in range(axes)], [F.max(F.col("hi")[i]) for i in range(axes)]
        return blocks.groupBy(F.expr(f"block div {FAN ** level}").alias("node")).agg(
            F.min("first").alias("first"), F.max("last").alias("last"),
            F.array(*parts[0]).alias("lo"), F.array(*parts[1]).alias("hi"),
        )

    n = blocks.agg(F.max("block")).head()[0] + 1
    top = max(0, math.ceil(math.log(n, FAN))) if n > 1 else 0
    spark = blocks.sparkSession
    pairs = spark.range(1).select(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))
    apart = F.aggregate(
        F.arrays_zip("a_lo", "a_hi", "b_lo", "b_hi"), F.lit(0.0),
        lambda total, z: total + F.pow(F.greatest(F.lit(0.0), z["a_lo"] - z["b_hi"], z["b_lo"] - z["a_hi"]), F.lit(2.0)),
    )
    for level in range(top, -1, -1):
        if level < top:
            down = lambda name: F.explode(F.sequence(F.col(name) * FAN, F.col(name) * FAN + FAN - 1))
            pairs = pairs.select("b", down("a").alias("a")).select("a", down("b").alias("b")).filter("a <= b")
        nodes = stored(interval(level), "intervals")
        side = lambda s: nodes.select(F.col("node").alias(s), *(F.col(c).alias(f"{s}_{c}") for c in ("first", "last", "lo", "hi")))
        met = pairs.join(side("a"), "a").join(side("b"), "b")
        met = met.filter((F.col("a_first") <= F.col("b_last")) & (F.col("b_first") <= F.col("a_last")))
        pairs = stored(met.filter(apart <= F.lit(eps * eps)).select("a", "b"), "pairs")
    return pairs


def _spanning(hits: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """A link from every node to the smallest node it reaches inside a pair of blocks.

    Nodes are the rows and then the columns of ``hits`` (the rows alone if ``same``).
    """
    a, b = hits.shape
    if same:
        hits = hits | hits.T | np.eye(a, dtype=bool)
        label = np.arange(a)
    else:
        label = np.arange(a + b)
    while True:
        before = label.copy()
        if same:
            label = np.where(hits, label[None, :], a).min(1)
        else:
            rows = np.minimum(label[:a], np.where(hits, label[None, a:], a + b).min(1))
            cols = np.minimum(label[a:], np.where(hits, rows[:, None], a + b).min(0))
            label = np.concatenate((rows, cols))
        label = label[label]
        if (label == before).all():
            moved = np.flatnonzero(label != np.arange(len(label)))
            return moved, label[moved]


def near_duplicates(rows: DataFrame, cosine: float = 0.98, key: str = "vec_id", vec: str = "embedding", label: str = "label", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(key, n_links, component_id, kept)`` for every row.

    Rows link if their labels are equal and not null and the cosine of their vectors, in
    double precision, is at least ``cosine`` (above 0). Null, empty and zero vectors, those
    with null or non-finite components, and vectors of different lengths link with nothing.
    Equal vectors are compared once and counted as often as they occur; all pairs of
    different vectors are counted, but only a spanning link per vector and block pair is
    kept for the components. Repeated rows count as several vectors. ``component_id`` is
    the smallest key that links reach.
    """
    named = _prepared(rows, key, vec, label)
    distinct = named.filter("vec IS NOT NULL").groupBy("label", "vec", "h1", "h2").agg(
        F.count(F.lit(1)).alias("n"), F.min("key").alias("least")
    )
    distinct = stored(distinct.withColumn("dim", F.size("vec")), "vectors")
    alone = (F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component_id"))
    narrow = named.select("key", "h1", "h2")

    def shown(df: DataFrame) -> DataFrame:
        return df.select(F.col("key").alias(key), "n_links", "component_id", F.col("key").eqNullSafe(F.col("component_id")).alias("kept"))

    width = distinct.agg(F.max("dim")).head()[0]
    if width is None:
        return shown(narrow.select("key", *alone))
    # The margin covers rounding: boxes and cells only ever prune what is surely apart.
    eps = math.sqrt(max(0.0, 2 - 2 * cosine)) + 1e-6
    axes = principal_axes(distinct, "vec", width)
    n_box = min(BOX_AXES, width)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(2), width)
            x /= np.abs(x).max(1, keepdims=True)
            x /= np.sqrt((x * x).sum(1, keepdims=True))
            at = x @ axes[:, :n_box]
            cells = np.zeros((len(x), CELL_AXES), np.int64)
            cells[:, : min(CELL_AXES, n_box)] = np.floor(at[:, :CELL_AXES] / eps)
            lists = [pa.array(list(m)) for m in (x, at)]
            cols = [batch.column(i) for i in (0, 1, 3, 4, 5, 6, 7)]
            yield pa.RecordBatch.from_arrays([*cols, *lists, *(pa.array(cells[:, i]) for i in range(CELL_AXES))], names=names)

    kinds = {f.name: f.dataType.simpleString() for f in distinct.schema.fields}
    names = ["tag", "label", "h1", "h2", "n", "least", "dim", "unit", "at", *(f"c{i}" for i in range(CELL_AXES))]
    schema = f"tag long, label {kinds['label']}, h1 long, h2 long, n long, least {kinds['least']}, dim int, unit array<double>, at array<double>, " + ", ".join(
        f"c{i} long" for i in range(CELL_AXES)
    )
    source = distinct.select(F.col("h1").alias("tag"), "label", "vec", "h1", "h2", "n", "least", "dim")
    placed = stored(source.mapInArrow(place, schema), "placed").drop("tag")
    ordered = numbered(placed, ["label", "dim", *(f"c{i}" for i in range(CELL_AXES)), "h1", "h2"])
    ordered = stored(ordered.withColumn("block", F.expr(f"pos div {block_rows}")), "sequence")
    bounds = ordered.groupBy("block").agg(
        F.min("label").alias("first"), F.max("label").alias("last"),
        F.array(*(F.min(F.col("at")[i]) for i in range(n_box))).alias("lo"),
        F.array(*(F.max(F.col("at")[i]) for i in range(n_box))).alias("hi"),
    )
    pairs = _close_blocks(stored(bounds, "bounds"), eps)
    payload = stored(
        packed(ordered, F.col("block"), {"pos": "long", "label": kinds["label"], "dim": "int", "n": "long"}, "unit", width), "blocks"
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                side = {
                    s: {c: np.array(row[f"{s}_{c}"]) for c in ("pos", "label", "dim", "n")} | {"x": np.frombuffer(row[f"{s}_x"]).reshape(-1, width)}
                    for s in "ab"
                }
                a, b = side["a"], side["b"]
                same = row["a"] == row["b"]
                hits = a["x"] @ b["x"].T >= cosine
                hits &= (a["label"][:, None] == b["label"][None, :]) & (a["dim"][:, None] == b["dim"][None, :])
                if same:
                    hits = np.triu(hits, 1)
                pos = a["pos"] if same else np.concatenate((a["pos"], b["pos"]))
                found, root = _spanning(hits, same)
                left, right = hits @ b["n"], hits.T @ a["n"]
                linked = left + right if same else np.concatenate((left, right))
                some = np.flatnonzero(linked)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate((pos[some], pos[found]))), pa.array(np.concatenate((pos[some], pos[root]))), pa.array(np.concatenate((linked[some], np.zeros(len(found), np.int64))))],
                    names=["src", "dst", "links"],
                )

    one = lambda s: payload.select(F.col("block").alias(s), *(F.col(c).alias(f"{s}_{c}") for c in ("pos", "label", "dim", "n", "x")))
    found = stored(pairs.join(one("a"), "a").join(one("b"), "b").mapInArrow(compare, "src long, dst long, links long"), "found")
    linked = found.filter("src = dst").groupBy(F.col("src").alias("pos")).agg(F.sum("links").alias("links"))
    roots = components(found.filter("src <> dst").select("src", "dst")).withColumnRenamed("node", "pos")
    classes = stored(ordered.select("pos", "h1", "h2", "n", "least").join(roots, "pos", "left").join(linked, "pos", "left"), "classes")
    groups = classes.filter("root IS NOT NULL").groupBy("root").agg(F.min("least").alias("component"))
    classes = classes.join(groups, "root", "left").select(
        "h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "least").alias("component_id")
    )
    inside = narrow.filter("h1 IS NOT NULL").join(classes, ["h1", "h2"])
    outside = narrow.filter("h1 IS NULL").select("key", *alone)
    return shown(inside.select("key", "n_links", "component_id").union(outside))
