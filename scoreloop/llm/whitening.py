"""Embedding whitening by Chebyshev-filtered subspace iteration.

The leading eigenvectors of the covariance come from passes over the centred vectors that
give V q for a thin block q, never V itself. A Chebyshev polynomial of V, built by its
three-term recurrence with one pass a degree, damps the spectrum between 0 and the smallest
Ritz value of the block; QR and Rayleigh-Ritz follow. The rounds end when the residuals of
the wanted pairs are at rounding level; a block that gains too little is widened, up to the
whole space, where Rayleigh-Ritz is exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloop.llm.common import stored
from scoreloop.llm.vectors import usable

# Bytes of a packed block of vectors.
BLOCK_BYTES = 1 << 22
# Degree of the polynomial in each round.
DEGREE = 12
# A residual of so little of the largest eigenvalue certifies a pair; one below LOOSE that no longer falls does too.
TIGHT, LOOSE = 1e-14, 1e-11
KINDS = ("<i2", "<i4", "<i8")


@dataclass(frozen=True)
class Whitener:
    """Number and sums of the fitted vectors; eigenpairs by falling eigenvalue; residuals and total variance."""

    n: int
    sums: tuple[int, ...]
    vectors: np.ndarray
    values: np.ndarray
    residuals: np.ndarray
    trace: float
    passes: int

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums]) if self.n else np.zeros(len(self.sums))


def integers(vec: str, scale: int) -> Column:
    """floor(scale * c) of every component, as longs (saturating at their ends)."""
    return F.transform(F.col(vec).cast("array<double>"), lambda c: F.floor(c * F.lit(float(scale))))


def _int_rows(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as an int64 matrix, padded with zeros."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(column), width), np.int64)
    row = np.repeat(np.arange(len(column)), sizes)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _blocks(fit: DataFrame, width: int) -> DataFrame:
    """The fit list as rows ``(n, kind, x)``: blocks of a bounded size, in the smallest integer type that holds them; stored."""
    height = max(1, BLOCK_BYTES // (8 * max(1, width)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, height):
                x = _int_rows(batch.column(0).slice(at, height), width)
                kind = next(k for k, t in enumerate(KINDS) if (x >= np.iinfo(t).min).all() and (x <= np.iinfo(t).max).all())
                cells = [[len(x)], [kind], [x.astype(KINDS[kind]).tobytes()]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, (pa.int64(), pa.int32(), pa.binary()))], names=["n", "kind", "x"])

    return stored(fit.mapInArrow(run, "n long, kind int, x binary"), "blocks")


def _matrices(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[np.ndarray]:
    for batch in batches:
        for n, kind, x in zip(*(batch.column(i) for i in range(3))):
            yield np.frombuffer(x.as_py(), KINDS[kind.as_py()]).reshape(n.as_py(), width)


def _totals(blocks: DataFrame, width: int) -> tuple[int, tuple[int, ...]]:
    """Number of vectors and their exact sums; high and low halves add up without overflow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high, low, n = np.zeros(width + 1, np.int64), np.zeros(width + 1, np.int64), 0
        for x in _matrices(batches, width):
            x = x.astype(np.int64)
            high[:width] += (x >> 32).sum(0)
            low[:width] += (x & 0xFFFFFFFF).sum(0)
            n += len(x)
        low[width] = n
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width + 1)), pa.array(high), pa.array(low)], names=["at", "high", "low"])

    wide = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low")]
    found = {r.at: (int(r.high) << 32) + int(r.low) for r in blocks.mapInArrow(run, "at long, high long, low long").groupBy("at").agg(*wide).collect()}
    return found.get(width, 0), tuple(found.get(i, 0) for i in range(width))


def _product(blocks: DataFrame, mean: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, float]:
    """Sum over the centred vectors x of ``x (x q)``, and of their squared lengths: one pass.

    Each task gives its own sums, which Spark adds by entry.
    """
    width, k = q.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, squares = np.zeros((width, k)), 0.0
        for x in _matrices(batches, width):
            x = x - mean
            total += x.T @ (x @ q)
            squares += float((x * x).sum())
        flat = np.append(total.ravel(), squares)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], names=["at", "v"])

    found = blocks.mapInArrow(run, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).toArrow()
    flat = np.zeros(width * k + 1)
    flat[found.column("at").to_numpy()] = found.column("v").to_numpy()
    return flat[:-1].reshape(width, k), float(flat[-1])


def fit(vectors: DataFrame, components: int, seed: int = 7) -> tuple[Whitener, DataFrame]:
    """The whitener of the distinct integer vectors in column ``x``, and its blocks of vectors.

    Shorter vectors are padded with zeros to the longest. Directions without variance are no
    components, so there may be fewer than asked for, or none.
    """
    width = vectors.agg(F.max(F.size("x"))).head()[0] or 0
    blocks = _blocks(vectors.select("x").distinct(), width)
    n, sums = _totals(blocks, width)
    mean = np.array([s / n for s in sums]) if n else np.zeros(width)
    rng = np.random.default_rng(seed)
    wanted = min(components, width)
    size = min(width, 2 * components + 8)
    passes, trace, last = 0, 0.0, np.inf

    def times(q: np.ndarray) -> np.ndarray:
        nonlocal passes, trace
        out, squares = _product(blocks, mean, q)
        passes, trace = passes + 1, squares / n
        return out / n

    nothing = Whitener(n, sums, np.zeros((width, 0)), np.zeros(0), np.zeros(0), 0.0, 0)
    if not n or not wanted:
        return nothing, blocks
    q = np.linalg.qr(rng.normal(size=(width, size)))[0]
    while True:
        image = times(q)
        small = q.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, image = q @ turn, image @ turn
        residuals = np.linalg.norm(image - q * values, axis=0)[:wanted]
        worst, top = residuals.max(), values[0]
        if top <= 0:
            return nothing, blocks
        if size == width or worst <= TIGHT * top or (worst <= LOOSE * top and worst > last / 2):
            break
        if worst > last / 4:
            # Too slow: the next eigenvalues lie too close to the block's smallest.
            more = min(width, 2 * size) - size
            extra = rng.normal(size=(width, more))
            q = np.linalg.qr(np.column_stack((q, extra)))[0]
            size, last = size + more, np.inf
            continue
        last = worst
        # The recurrence on [0, smallest Ritz value], scaled so that the largest stays near 1.
        half = max(values[-1], 1e-12 * top) / 2
        first = half / (top - half)
        sigma, before = first, q
        now = (image - half * q) * (first / half)
        for _ in range(DEGREE - 1):
            after = 1 / (2 / first - sigma)
            before, now = now, (times(now) - half * now) * (2 * after / half) - before * (sigma * after)
            sigma = after
        q = np.linalg.qr(now)[0]
    real = np.flatnonzero(values[:wanted] > width * np.finfo(float).eps * top)
    found = q[:, real]
    sign = np.sign(found[np.abs(found).argmax(0), np.arange(len(real))])
    return Whitener(n, sums, found * sign, values[real], residuals[real], trace, passes), blocks


def identity_error(blocks: DataFrame, model: Whitener) -> float:
    """The largest absolute entry of the whitened fit list's covariance minus the identity, measured in one pass."""
    width, k = model.vectors.shape
    mean, axes = model.mean, model.vectors / np.sqrt(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for x in _matrices(batches, width):
            z = (x - mean) @ axes
            total[:k] += z.T @ z
            total[k] += z.sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["at", "v"])

    if not k:
        return 0.0
    found = blocks.mapInArrow(run, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).toArrow()
    total = np.zeros((k + 1) * k)
    total[found.column("at").to_numpy()] = found.column("v").to_numpy()
    total = total.reshape(k + 1, k) / model.n
    return float(np.abs(total[:k] - np.outer(total[k], total[k]) - np.eye(k)).max())


def project(rows: DataFrame, model: Whitener) -> DataFrame:
    """Rows ``(key, x)`` to one row per component: ``key, component, deviation, whitened``.

    ``deviation`` is the exact sum of (n x - S) squared as a decimal (null beyond 38 digits).
    """
    width, k = model.vectors.shape
    n, sums, mean, axes = model.n, model.sums, model.mean, model.vectors / np.sqrt(model.values)
    limit = 10**38

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _int_rows(batch.column(1), width)
            far = n * int(np.abs(x.astype(float)).max(initial=0) + 1) + max(map(abs, sums), default=0)
            if far * far * max(1, width) < 2**63:
                exact = ((n * x - np.array(sums, np.int64)) ** 2).sum(1).tolist()
            else:
                exact = [sum((n * v - s) ** 2 for v, s in zip(row, sums)) for row in x.tolist()]
            exact = pa.array([Decimal(v) if v < limit else None for v in exact], pa.decimal128(38, 0))
            z = (x - mean) @ axes
            owner = pa.array(np.repeat(np.arange(len(x)), k))
            number = np.tile(np.arange(1, k + 1), len(x)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(owner), pa.array(number), exact.take(owner), pa.array(z.ravel())], names=["key", "component", "deviation", "whitened"]
            )

    kind = rows.schema["key"].dataType.simpleString()
    return rows.select("key", "x").mapInArrow(run, f"key {kind}, component int, deviation decimal(38,0), whitened double")


def whiten(rows: DataFrame, components: int, scale: int = 256, key: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """Whitened coordinates: a row per usable row and component.

    Columns: ``key, component`` (from 1), ``n`` (distinct fitted vectors), ``deviation``,
    ``whitened``, ``explained`` (share of the total variance), ``identity_error`` and
    ``residual`` (of the eigenpair, over the largest eigenvalue). Null vectors and vectors
    with a null or non-finite component take no part; repeated rows stay repeated and
    count once in the fit; without variance, or rows, there is no component and no row.
    """
    spark = rows.sparkSession
    clean = rows.select(F.col(key).alias("key"), F.col(vec).alias("vec")).filter(usable("vec"))
    clean = stored(clean.select("key", integers("vec", scale).alias("x")), "integers")
    model, blocks = fit(clean, components)
    facts = [
        (i + 1, float(v / model.trace), float(r / model.values[0])) for i, (v, r) in enumerate(zip(model.values, model.residuals))
    ]
    error = identity_error(blocks, model)
    shares = spark.createDataFrame(facts, "component int, explained double, residual double")
    out = project(clean, model).join(F.broadcast(shares), "component")  # a row per component
    return out.select(
        F.col("key").alias(key), "component", F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        "explained", F.lit(error).alias("identity_error"), "residual",
    )
