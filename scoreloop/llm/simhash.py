"""SimHash near-duplicates, found through Golay-code keys of fingerprint segments.

A 64-bit fingerprint is cut into three segments. Two fingerprints that differ
in at most two bits have, in cyclic order, one segment without an error followed
by one with at most one error, or with two where the rest has none. So the key
"this segment exactly, the next one fuzzily" meets in at least one of three
positions.

The fuzzy half is a codeword of the perfect (23,12) Golay code. Every 23-bit word
lies within three errors of one codeword; a word at distance three also has five
codewords at distance four. A word's keys are all codewords within distance four:
one or six of them. Any two words at most two bits apart share one (a pair at
distance 3 from different codewords shares the block through the error positions),
so no pair is missed; every candidate is then verified by its bit count.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreloop.llm.common import components, stored

# The code's generator polynomial and the widths of the segments.
GOLAY = 0b101011100011
SEGMENTS = (22, 21, 21)
SEED = 42
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprint(text: bytes | None, width: int = 3) -> int:
    """The fingerprint of one text, as an unsigned integer; 0 without words."""
    import xxhash

    words = (text or b"").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    width = min(width, len(words))
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - width + 1].tolist()
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    spans = list(zip(starts, ends[width - 1 :].tolist()))
    for at in range(0, len(spans), 1 << 16):
        part = np.array([digest(line[s:e], SEED) for s, e in spans[at : at + (1 << 16)]], "<u8").view(np.uint8).reshape(-1, 8)
        for k in range(8):
            counts[8 * k : 8 * k + 8] += np.bincount(part[:, k], minlength=256) @ _BITS
    return sum(1 << int(b) for b in np.flatnonzero(2 * counts > len(spans)))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """``(key, fp)`` per row: the SimHash of the whole text over word shingles, as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            found = np.array([fingerprint(t, width) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], names=["key", "fp"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, fp long").withColumnRenamed("key", key)


@lru_cache(1)
def _golay() -> tuple[np.ndarray, np.ndarray]:
    """Syndromes of single bits, and per syndrome the error patterns of its codewords (-1: none)."""
    single = []
    for bit in range(23):
        value = 1 << bit
        for top in range(22, 10, -1):
            if value >> top & 1:
                value ^= GOLAY << (top - 11)
        single.append(value)
    patterns = np.full((2048, 6), -1, np.int64)
    filled = np.zeros(2048, np.int64)
    weight = np.zeros(2048, np.int64)
    for size in range(5):
        for bits in combinations(range(23), size):
            syndrome = 0
            for b in bits:
                syndrome ^= single[b]
            if size < 4 or weight[syndrome] == 3:
                patterns[syndrome, filled[syndrome]] = sum(1 << b for b in bits)
                filled[syndrome] += 1
            if size < 4:
                weight[syndrome] = size
    return np.array(single, np.int64), patterns


def codewords(words: np.ndarray) -> np.ndarray:
    """Indices of the codewords within distance four of 23-bit words: six columns, -1 where there is none."""
    single, patterns = _golay()
    syndromes = np.zeros(len(words), np.int64)
    for bit in range(23):
        syndromes ^= np.where(words >> bit & 1, single[bit], 0)
    errors = patterns[syndromes]
    return np.where(errors >= 0, (words[:, None] ^ errors) >> 11, -1)


def fuzzy_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and join keys of 64-bit fingerprints."""
    parts, shift = [], 0
    for width in SEGMENTS:
        parts.append((fps >> np.uint64(shift)).astype(np.int64) & ((1 << width) - 1))
        shift += width
    rows, keys = [], []
    for k in range(3):
        words = codewords(parts[(k + 1) % 3])
        row, col = np.nonzero(words >= 0)
        rows.append(row)
        keys.append((k << 40) | (parts[k][row] << 12) | words[row, col])
    return np.concatenate(rows), np.concatenate(keys)


def linked_fingerprints(fps: DataFrame, bits: int = 2) -> DataFrame:
    """Pairs ``(src, dst)`` of different fingerprints that differ in at most ``bits`` (0 to 2) bits.

    ``fps`` has distinct non-null values in ``fp``. The join emits verified
    pairs only, of which a fingerprint has at most 2,080.
    """
    if not 0 <= bits <= 2:
        raise ValueError("the keys meet for at most two differing bits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False)
            row, keys = fuzzy_keys(values.astype(np.int64).view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(values[row])], names=["k", "fp"])

    keys = fps.select("fp").mapInArrow(run, "k long, fp long")
    left, right = keys.select("k", F.col("fp").alias("src")), keys.select("k", F.col("fp").alias("dst"))
    near = (F.col("src") < F.col("dst")) & (F.bit_count(F.col("src").bitwiseXOR(F.col("dst"))) <= bits)
    return left.join(right, "k").filter(near).select("src", "dst").distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, bits: int = 2) -> DataFrame:
    """``(key, fingerprint, component_id)`` for every row.

    ``component_id`` is the smallest key among all rows reachable over links of
    at most ``bits`` differing bits. Null and empty texts have fingerprint zero
    and link like any other; repeated rows stay repeated; a null key is
    nobody's smallest. Other columns are ignored. An empty table gives none.
    """
    prints = stored(fingerprints(docs, key, text, width), "fingerprints")
    classes = stored(prints.groupBy("fp").agg(F.min(key).alias("least")), "classes")
    roots = stored(components(linked_fingerprints(classes, bits)), "roots")
    joined = classes.join(roots.withColumnRenamed("node", "fp"), "fp")
    groups = joined.groupBy("root").agg(F.min("least").alias("component"))
    # One row per fingerprint: its own smallest key, or its group's.
    labels = classes.join(
        roots.join(groups, "root").select(F.col("node").alias("fp"), "component"), "fp", "left"
    ).select("fp", F.coalesce("component", "least").alias("component_id"))
    return prints.join(labels, "fp", "left").select(
        key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose key is the smallest of their group; all columns as they are.

    Rows that repeat a kept key are kept with it. Rows with a null key stay only
    where their whole group has none.
    """
    kept = near_duplicates(docs, key, text).filter(F.col(key).eqNullSafe(F.col("component_id"))).select(key).distinct()
    marked = kept.withColumnRenamed(key, "kept_key")
    return docs.join(marked, docs[key].eqNullSafe(marked["kept_key"]), "left_semi")
