"""Document quality from boosted trees over statistics of the text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloop.llm import gbt

# Labelled rows that a fit takes at most, in an order drawn by hash.
FIT_ROWS = 20_000
FEATURES = (
    "bytes words word_bytes longest_word upper digit space newline ascii_punct other symbols stops commas pipes bangs "
    "capital_words distinct_words repeated_next top_word lines distinct_lines top_line line_words short_lines wordless "
    "ends_odd entropy"
).split()
# Byte classes that the statistics count.
_UPPER, _LOWER, _DIGIT = np.arange(65, 91), np.arange(97, 123), np.arange(48, 58)
_PUNCT = np.array([b for b in range(33, 127) if not chr(b).isalnum()])
_SYMBOLS = np.frombuffer(b"#$%&*+/<=>@[\\]^_`{}~", np.uint8)


def statistics(text: bytes | None) -> list[float]:
    """The features of one whole text; all zero without a word."""
    text = text or b""
    words = text.split()
    if not words:
        return [0.0] * len(FEATURES)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    size, n = len(text), len(words)
    lengths = np.fromiter(map(len, words), np.int64, n)
    seen: dict[bytes, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    repeats = sum(map(bytes.__eq__, words, words[1:]))
    capital = sum(map(bytes.isupper, words))
    odd = sum(1 for w in words if w[-1] in b"#$%&*!|")
    wordless = sum(1 for w in words if len(w) < 4 and not w.isalnum() and w[0] < 128)
    lines = [line for line in text.split(b"\n") if line.strip()]
    met: dict[bytes, int] = {}
    for line in lines:
        met[line] = met.get(line, 0) + 1
    share = counts[counts > 0] / size
    return [
        np.log1p(size), np.log1p(n), lengths.mean(), np.log1p(lengths.max()),
        counts[_UPPER].sum() / max(1, counts[_UPPER].sum() + counts[_LOWER].sum()), counts[_DIGIT].sum() / size,
        (counts[32] + counts[9:14].sum()) / size, counts[10] / n, counts[_PUNCT].sum() / n, counts[128:].sum() / size,
        counts[_SYMBOLS].sum() / n, counts[46] / n, counts[44] / n, counts[124] / n, counts[33] / n,
        capital / n, len(seen) / n, repeats / n, max(seen.values()) / n, np.log1p(len(lines)), len(met) / len(lines),
        max(met.values()) / len(lines), n / len(lines), sum(1 for x in lines if len(x) < 20) / len(lines), wordless / n,
        odd / n, float(-(share * np.log(share)).sum()),
    ]


def features(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, x)`` per row: the statistics of the whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [statistics(t) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.float64()))], names=["key", "x"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, x array<double>").withColumnRenamed("key", key)


def held_out(key: str | Column = "doc_id", folds: int = 5) -> Column:
    """True for the rows that never teach: crc32 of the key as text, modulo ``folds``, is 0 (a null key: never)."""
    column = F.col(key) if isinstance(key, str) else key
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % folds == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", rows: int = FIT_ROWS) -> gbt.Trees:
    """Fit on at most ``rows`` labelled, not held-out rows.

    Rows with a null text, key or label do not teach. The sample is drawn by a hash
    of the key, so it does not depend on how the tables are stored.
    """
    known = labels.select(F.col(key).alias("_key"), F.col(label).alias("_label")).dropna().distinct()
    known = known.filter(~held_out("_key"))
    share = min(1.0, rows / max(1, known.count()))
    taught = known.filter(F.pmod(F.xxhash64("_key", F.lit("fit")), F.lit(1 << 30)) < int(share * (1 << 30)))
    texts = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).dropna()
    sample = features(texts.join(taught, "_key", "left_semi"), "_key", "_text").join(taught, "_key")
    found = sample.orderBy(F.xxhash64("_key", F.lit("fit")), "_key", "_label").limit(rows).select("x", "_label").toArrow()
    x = np.array(found.column("x").to_pylist(), float).reshape(-1, len(FEATURES))
    y = np.array(found.column("_label").to_pylist(), float)
    return gbt.fit(x, y)


def score(docs: DataFrame, model: gbt.Trees, text: str = "text", name: str = "score") -> DataFrame:
    """All columns of ``docs`` and ``name``, the probability that its quality is 1.

    The score depends on the text alone: null, empty and blank texts get the score of
    a text without words. A column that already has that name is replaced.
    """
    names = [c for c in docs.columns if c != name]
    schema = docs.select(*names, F.lit(0.0).alias(name)).schema
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(place).cast(pa.string()).cast(pa.binary()).to_pylist()
            x = np.array([statistics(t) for t in texts]).reshape(-1, len(FEATURES))
            rest = [batch.column(i) for i, c in enumerate(batch.schema.names) if c != name]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(model.score(x))], names=[*names, name])

    return docs.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, held_out, score, predicted)`` for every row of ``docs``; the model is fitted first."""
    model = fit(docs, labels, key, text)
    scored = score(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), model)
    return scored.select(
        F.col("key").alias(key), held_out("key").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, with all their columns."""
    model = fit(docs, labels, key, text)
    return score(docs, model, text, "_score").filter(F.col("_score") >= threshold).select(*docs.columns)
