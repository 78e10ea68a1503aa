"""Importance resampling towards a target's word distribution, counted on deduplicated segments.

Line breaks cut texts into segments. Each distinct segment (its words, joined by one space)
has its features counted once, for all its occurrences in all documents: corpus counts are
segment counts times occurrences, and a document's sum of gains is the sum over its segments.
Only runs of words across line breaks belong to a single document; they are counted beside.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloop.llm.common import row_key, stored
from scoreloop.llm.vectors import numbered

# Bytes that no word holds become spaces, A-Z become a-z. All bytes of other
# code points above 0x7F stay, so the rule works on UTF-8 bytes.
WORD_BYTES = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
# Fixed value: the range of the hash that draws a document's noise.
HASHES = 4294967296
# Segments that a task remembers having handed on, and bytes of segments counted at a time.
MEMORY, CHUNK = 1 << 20, 1 << 22


def segments(text: bytes) -> list[list[bytes]]:
    """The words of every line that has any."""
    return [words for line in text.split(b"\n") if (words := line.translate(WORD_BYTES).split())]


def crossing_runs(lines: list[list[bytes]], n_max: int) -> Iterator[bytes]:
    """Runs of two to ``n_max`` consecutive words that cross a line break, joined by one space."""
    if n_max < 2:
        return
    words = [w for line in lines for w in line]
    line = [i for i, own in enumerate(lines) for _ in own]
    for n in range(2, n_max + 1):
        for at in range(len(words) - n + 1):
            if line[at] != line[at + n - 1]:
                yield b" ".join(words[at : at + n])


def _counted(owner: np.ndarray, bucket: np.ndarray, n: int, buckets: int) -> tuple[pa.Array, pa.Array]:
    """Per owner (0 to n - 1) the buckets with their counts, as list columns."""
    cells, counts = np.unique(owner * buckets + bucket, return_counts=True)
    at = pa.array(np.searchsorted(cells // buckets, np.arange(n + 1)), pa.int32())
    return (
        pa.ListArray.from_arrays(at, pa.array(cells % buckets, pa.int32())),
        pa.ListArray.from_arrays(at, pa.array(counts, pa.int64())),
    )


def _features(lines: list[bytes], n_max: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Owner (line) and bucket of every feature of some segments."""
    column = pa.array(lines, pa.large_binary()).view(pa.large_string())
    split = pc.split_pattern(column, " ")
    coded = split.flatten().dictionary_encode()
    known = coded.dictionary.view(pa.large_binary()).to_pylist()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(lines)), pc.list_value_length(split).to_numpy(zero_copy_only=False))
    sums = np.array([zlib.crc32(w) for w in known], np.int64)[codes]
    owners, found = [owner], [sums % buckets]
    spaced = [b" " + w for w in known]
    for n in range(2, n_max + 1):
        # A checksum goes on over the next word, so runs of n come from runs of n - 1.
        inside = owner[: len(owner) - n + 1] == owner[n - 1 :]
        at = np.flatnonzero(inside)
        longer = np.zeros(len(codes), np.int64)
        longer[at] = [zlib.crc32(spaced[c], s) for c, s in zip(codes[at + n - 1].tolist(), sums[at].tolist())]
        sums = longer
        owners.append(owner[at])
        found.append(sums[at] % buckets)
    return np.concatenate(owners), np.concatenate(found)


def _cut(docs: DataFrame, n_max: int, buckets: int, key: str, text: str) -> DataFrame:
    """Per document a head (``h1`` null; with the buckets of its crossing runs) and a row per distinct segment; stored.

    A segment's words come along where the task sees it first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        seen: set[bytes] = set()
        names = ["row", "key", "n_words", "crossing", "crossing_counts", "h1", "h2", "times", "words"]
        for batch in batches:
            texts = batch.column(2).cast(pa.binary())
            n_words, owners, found = [], [], []
            row, digests, times, first = [], [], [], []
            for i in range(len(texts)):
                lines = segments(texts[i].as_py() or b"")
                n_words.append(sum(map(len, lines)))
                for run_ in crossing_runs(lines, n_max):
                    owners.append(i)
                    found.append(zlib.crc32(run_) % buckets)
                own: dict[bytes, int] = {}
                for line in map(b" ".join, lines):
                    own[line] = own.get(line, 0) + 1
                for line, count in own.items():
                    digest = xxhash.xxh3_128_digest(line)
                    row.append(i)
                    digests.append(digest)
                    times.append(count)
                    first.append(None if digest in seen else line)
                    seen.add(digest)
                if len(seen) > MEMORY:
                    seen.clear()
            n = len(texts)
            cross = _counted(np.array(owners, np.int64), np.array(found, np.int64), n, buckets)
            none = [pa.nulls(n, t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n_words, pa.int64()), *cross, *none], names=names)
            halves = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            lists = [pa.nulls(len(row), pa.list_(t)) for t in (pa.int32(), pa.int64())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row, pa.int64())), pa.nulls(len(row), batch.column(1).type), pa.nulls(len(row), pa.int64()), *lists,
                 pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(times, pa.int64()), pa.array(first, pa.binary())], names=names,
            )

    rows = docs.select(row_key().alias("row"), F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    schema = f"row long, key {kind}, n_words long, crossing array<int>, crossing_counts array<long>, h1 long, h2 long, times long, words binary"
    return stored(rows.mapInArrow(run, schema), "segments")


def _distinct(cut: DataFrame, n_max: int, buckets: int) -> DataFrame:
    """Every distinct segment once: ``h1, h2, times`` (in all documents) and its features' ``bucket`` and ``count`` lists; stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines, at = batch.column(3).to_pylist(), 0
            while at < len(lines):
                end, total = at, 0
                while end < len(lines) and (end == at or total < CHUNK):
                    total += len(lines[end])
                    end += 1
                lists = _counted(*_features(lines[at:end], n_max, buckets), end - at, buckets)
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(at, end - at) for i in range(3)), *lists], names=["h1", "h2", "times", "bucket", "count"])
                at = end

    own = cut.filter("h1 is not null")
    times = own.groupBy("h1", "h2").agg(F.sum("times").alias("times"))
    words = own.filter("words is not null").select("h1", "h2", "words").dropDuplicates(["h1", "h2"])
    both = times.join(words, ["h1", "h2"]).select("h1", "h2", "times", "words")
    return stored(both.mapInArrow(run, "h1 long, h2 long, times long, bucket array<int>, count array<long>"), "features")


def _bucket_sums(rows: DataFrame, buckets: int) -> np.ndarray:
    """Counts by bucket from rows ``(times, bucket, count)``: each task adds up its own, Spark adds those."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            sizes = batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
            times = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), sizes)
            np.add.at(total, batch.column(1).flatten().to_numpy(), times * batch.column(2).flatten().to_numpy())
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["at", "v"])

    found = rows.mapInArrow(run, "at long, v long").groupBy("at").agg(F.sum("v").alias("v")).toArrow()  # a row per bucket at most
    out = np.zeros(buckets, np.int64)
    out[found.column("at").to_numpy()] = found.column("v").to_numpy()
    return out


def _corpus(docs: DataFrame, n_max: int, buckets: int, key: str, text: str) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """Cut documents, distinct segments, and all features by bucket."""
    cut = _cut(docs, n_max, buckets, key, text)
    known = _distinct(cut, n_max, buckets)
    crossing = cut.filter("h1 is null and size(crossing) > 0").select(F.lit(1).cast("long").alias("times"), "crossing", "crossing_counts")
    total = _bucket_sums(known.select("times", "bucket", "count"), buckets)
    return cut, known, total + _bucket_sums(crossing, buckets) if n_max > 1 else total


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of every bucket's smoothed odds of the target against the raw corpus."""
    n, s_all, t_all = len(raw), float(raw.sum()), float(target.sum())
    odds = [(float(t) + 1) * (s_all + n) / ((float(s) + 1) * (t_all + n)) for s, t in zip(raw.tolist(), target.tolist())]
    return np.array([math.floor(1000 * math.log(v)) for v in odds], np.int64)


def _gain_sums(rows: DataFrame, names: list[str], gain: np.ndarray) -> DataFrame:
    """Rows ``(*names, bucket, count)`` to ``(*names, n, gain)``: number of features and sum of their gains."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(names)
        for batch in batches:
            sizes = batch.column(k).value_lengths().to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(batch.num_rows), sizes)
            count = batch.column(k + 1).flatten().to_numpy()
            n, total = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            np.add.at(n, owner, count)
            np.add.at(total, owner, count * gain[batch.column(k).flatten().to_numpy()])
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(k)), pa.array(n), pa.array(total)], names=[*names, "n", "gain"])

    return rows.mapInArrow(run, ", ".join(f"{c} long" for c in names) + ", n long, gain long")


def noise(key: Column, seed: int) -> Column:
    """floor(-1000 ln(-ln u)) with u from the first 32 bits of a document's digest: Gumbel noise in thousandths."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    u = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / float(HASHES)
    return F.floor(-1000.0 * F.log(-F.log(u)))


def resample(
    docs: DataFrame, target: DataFrame, n_max: int = 1, buckets: int = 10_000, percent: int = 10, min_words: int = 20,
    seed: int = 2024, key: str = "doc_id", text: str = "text", target_text: str = "text",
) -> DataFrame:
    """Every document's ``key, n_features, weight, score, rank``.

    Features are runs of 1 to ``n_max`` words, by bucket of their checksum. ``weight`` is the
    floored mean gain of a document's features (none: 0), ``score`` adds its noise. Of the N
    rows with at least ``min_words`` words the floor(percent N / 100) highest scores are
    drawn; ``rank`` is their place, ties by smaller key (nulls last); null elsewhere. Null
    texts have no words; the noise of a null key is that of an empty one. Every row counts
    as a document, repeated ones too; an empty table gives none. 128-bit hashes stand for
    segments.
    """
    cut, known, raw = _corpus(docs, n_max, buckets, key, text)
    wanted = _corpus(target.select(F.lit(0).cast("long").alias("key"), F.col(target_text).alias("text")), n_max, buckets, "key", "text")[2]
    gain = gains(raw, wanted)
    valued = _gain_sums(known.select("h1", "h2", "bucket", "count"), ["h1", "h2"], gain)
    lines = cut.filter("h1 is not null").select("row", "h1", "h2", "times").join(valued, ["h1", "h2"])
    parts = lines.select("row", (F.col("times") * F.col("n")).alias("n"), (F.col("times") * F.col("gain")).alias("gain"))
    heads = cut.filter("h1 is null")
    if n_max > 1:
        parts = parts.unionByName(_gain_sums(heads.select("row", "crossing", "crossing_counts"), ["row"], gain))
    sums = parts.groupBy("row").agg(F.sum("n").alias("n"), F.sum("gain").alias("gain"))
    weight = F.expr("case when n > 0 then (gain - pmod(gain, n)) div n else 0L end")
    found = heads.select("row", "key", "n_words").join(sums, "row", "left").select(
        "row", "key", "n_words", F.coalesce("n", F.lit(0)).cast("long").alias("n_features"), weight.alias("weight")
    )
    found = found.withColumn("score", F.col("weight") + noise(F.col("key"), seed))
    found = found.select(
        (F.col("n_words") < min_words).alias("short"), (-F.col("score")).alias("down"), F.col("key").isNull().alias("none"),
        "key", "row", "n_features", "weight", "score",
    )
    placed = numbered(found, ["short", "down", "none", "key", "row"])
    drawn = cut.filter((F.col("h1").isNull()) & (F.col("n_words") >= min_words)).count() * percent // 100
    return placed.select(
        F.col("key").alias(key), "n_features", "weight", "score", F.when(F.col("pos") < drawn, F.col("pos") + 1).alias("rank")
    )
