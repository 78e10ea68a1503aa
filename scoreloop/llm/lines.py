"""Line dedup: lines that many documents share go, as one keep bitmap per document.

Every distinct line of a document becomes a narrow record (hash, document, positions). The
records are dealt out by ranges of (hash, document) and sorted there, so that a line which a
third of all documents hold spreads over many tasks. Each task streams its ranges: the first
occurrences of a line count documents, rows of a line with enough of them pass on at once,
and only the first and the last line of a task, which may go on in a neighbour's range, wait
for the sum over tasks. What returns to a document is the list of its dropped positions,
packed into a bitmap; texts never travel with the lines.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloop.llm.common import row_key, stored

# Bytes of text that are split at a time.
CHUNK = 1 << 22
# Parts that equal rows may be dealt out by.
SALTS = 1 << 12
# States of a streamed record: the sum over tasks decides, dropped, summary of an outer line.
OPEN, SURE, SUMMARY = 0, 1, 2


def tags(key: str, text: str) -> tuple[Column, Column]:
    """128 bits that stand for a document: its key and whole text."""
    whole = F.col(text).cast("string")
    return F.xxhash64(F.col(key), whole).alias("t1"), F.xxhash64(F.lit("second"), whole, F.col(key)).alias("t2")


def pack_keep(n_lines: int, dropped: np.ndarray) -> bytes:
    """A compressed bitmap with one bit per line, set where it stays."""
    keep = np.ones(n_lines, bool)
    keep[dropped] = False
    return zlib.compress(np.packbits(keep, bitorder="little").tobytes(), 6)


def unpack_keep(n_lines: int, bitmap: bytes) -> np.ndarray:
    bits = np.frombuffer(zlib.decompress(bitmap), np.uint8)
    return np.unpackbits(bits, count=n_lines, bitorder="little").astype(bool)


def kept_text(text: bytes, n_lines: int, bitmap: bytes) -> bytes:
    """The lines that stay, joined by line breaks."""
    lines = text.split(b"\n")
    return b"\n".join(lines[i] for i in np.flatnonzero(unpack_keep(n_lines, bitmap)))


def _pieces(texts: list[bytes | None]) -> Iterator[tuple[int, list[bytes]]]:
    """Some whole texts at a time, about ``CHUNK`` bytes, with the first one's place."""
    at, held, total = 0, [], 0
    for i, text in enumerate(texts):
        held.append(text or b"")
        total += len(held[-1])
        if total >= CHUNK or i + 1 == len(texts):
            yield at, held
            at, held, total = i + 1, [], 0


def _line_hashes(texts: list[bytes], min_chars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lines per text; and of each line with a key long enough: its text, its place there and 128 bits of its key."""
    import xxhash

    split = pc.split_pattern(pa.array(texts, pa.large_binary()).view(pa.large_string()), "\n")
    n_lines = pc.list_value_length(split).to_numpy(zero_copy_only=False)
    keys = pc.ascii_lower(pc.ascii_trim_whitespace(split.flatten())).dictionary_encode()
    known = keys.dictionary
    long_enough = pc.greater_equal(pc.utf8_length(known), min_chars).to_numpy(zero_copy_only=False)
    digests = b"".join(xxhash.xxh3_128_digest(v) for v in known.view(pa.large_binary()).to_pylist())
    halves = np.frombuffer(digests, "<i8").reshape(-1, 2)
    codes = keys.indices.to_numpy(zero_copy_only=False)
    doc = np.repeat(np.arange(len(texts)), n_lines)
    place = np.arange(len(codes)) - np.repeat(np.cumsum(n_lines) - n_lines, n_lines)
    fits = long_enough[codes] if len(codes) else np.zeros(0, bool)
    return n_lines, doc[fits], place[fits], halves[codes[fits]]


def _records(docs: DataFrame, min_chars: int, key: str, text: str) -> DataFrame:
    """Per document a head (``h1`` null) and a record per distinct line; stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "t1", "t2", "salt", "n_lines", "h1", "h2", "at"]
        for batch in batches:
            whole = batch.column(4).cast(pa.binary()).to_pylist()
            for first, texts in _pieces(whole):
                n_lines, doc, place, halves = _line_hashes(texts, min_chars)
                own = [batch.column(i).slice(first, len(texts)) for i in range(4)]
                none = pa.nulls(len(texts), pa.int64())
                lists = pa.nulls(len(texts), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*own, pa.array(n_lines, pa.int32()), none, none, lists], names=names)
                order = np.lexsort((place, halves[:, 1], halves[:, 0], doc))
                doc, place, halves = doc[order], place[order], halves[order]
                if len(doc):
                    fresh = np.r_[True, (doc[1:] != doc[:-1]) | (halves[1:] != halves[:-1]).any(1)]
                    at = np.flatnonzero(fresh)
                    owner = pa.array(doc[at])
                    places = pa.ListArray.from_arrays(pa.array(np.r_[at, len(doc)], pa.int32()), pa.array(place, pa.int32()))
                    yield pa.RecordBatch.from_arrays(
                        [*(c.take(owner) for c in own), pa.nulls(len(at), pa.int32()), pa.array(halves[at, 0]), pa.array(halves[at, 1]), places], names=names
                    )

    salt = F.pmod(row_key(), F.lit(SALTS)).cast("int").alias("salt")
    rows = docs.select(F.col(key).alias("key"), *tags(key, text), salt, F.col(text).cast("string").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    return stored(rows.mapInArrow(run, f"key {kind}, t1 long, t2 long, salt int, n_lines int, h1 long, h2 long, at array<int>"), "lines")


def _streamed(records: DataFrame, min_docs: int) -> DataFrame:
    """Records of lines in ``min_docs`` documents or more, and those that neighbours have to decide; stored.

    ``lead`` marks the line's first document within the task, ``edge`` a line that may have
    begun in an earlier task. Memory: a batch and ``min_docs`` records.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        name, docs, head, held, outer = None, 0, None, [], True

        def marked(rows: pa.RecordBatch, state: int, lead: np.ndarray, edge: bool, docs: int = 0) -> pa.RecordBatch:
            n = rows.num_rows
            more = [pa.array(np.full(n, v, t)) for v, t in ((state, np.int32), (docs, np.int64), (part, np.int32))]
            flags = [pa.array(lead), pa.array(np.full(n, edge))]
            return pa.RecordBatch.from_arrays([*rows.columns, *more, *flags], names=[*rows.schema.names, "state", "docs", "part", "lead", "edge"])

        def leading(rows: pa.RecordBatch) -> np.ndarray:
            same = [rows.column(i).to_numpy() == head.column(i)[0].as_py() for i in (4, 5)]
            return same[0] & same[1]

        def closed(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal outer
            if name is not None and (outer or last):
                for rows in held:
                    yield marked(rows, OPEN, leading(rows), outer)
                yield marked(head, SUMMARY, np.ones(1, bool), outer, docs)
            outer = outer and name is None

        def fed(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            nonlocal name, docs, head, held
            own = (rows.column(0)[0].as_py(), rows.column(1)[0].as_py())
            if own != name:
                yield from closed(False)
                name, docs, head, held = own, 0, rows.slice(0, 1), []
            docs += rows.num_rows
            held.append(rows)
            if docs >= min_docs:
                for some in held:
                    yield marked(some, SURE, leading(some), outer)
                held = []

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            h = np.stack([batch.column(i).to_numpy() for i in (0, 1)])
            starts = np.flatnonzero(np.r_[True, (h[:, 1:] != h[:, :-1]).any(0)])
            ends = np.r_[starts[1:], n]
            yield from fed(batch.slice(0, int(ends[0])))
            if len(starts) == 1:
                continue
            # Lines that begin and end within the batch; the last one may go on.
            long_ = np.flatnonzero((ends - starts >= min_docs)[1:-1]) + 1
            if len(long_):
                sizes = (ends - starts)[long_]
                first = np.repeat(starts[long_], sizes)
                at = first + np.arange(len(first)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                t = [batch.column(i).to_numpy() for i in (4, 5)]
                yield marked(batch.take(pa.array(at)), SURE, (t[0][at] == t[0][first]) & (t[1][at] == t[1][first]), False)
            yield from fed(batch.slice(int(starts[-1])))
        yield from closed(True)

    names = ["h1", "h2", "none", "key", "t1", "t2"]
    order = [*names, "salt"]
    ranged = records.filter("h1 is not null").withColumn("none", F.col("key").isNull()).select(*order, "at")
    ranged = ranged.repartitionByRange(*order).sortWithinPartitions(*order)
    kind = ranged.schema["key"].dataType.simpleString()
    schema = f"h1 long, h2 long, none boolean, key {kind}, t1 long, t2 long, salt int, at array<int>, state int, docs long, part int, lead boolean, edge boolean"
    return stored(ranged.mapInArrow(run, schema), "streamed")


def keep_bitmaps(docs: DataFrame, min_docs: int = 2, keep_first: bool = False, min_chars: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per distinct document: ``key, t1, t2, n_lines, n_dropped, keep``.

    A line's key is the line without ASCII white space at its ends, A-Z lowered; keys shorter
    than ``min_chars`` code points always stay. Keys that ``min_docs`` rows hold or more lose
    all their lines, or with ``keep_first`` all but the very first occurrence by document key
    (nulls last) and position. Each row counts as a document; rows with equal key and text
    share a bitmap, and ``t1, t2`` (see ``tags``) name it. A null or empty text has one
    empty line. 128-bit hashes stand for lines and documents.
    """
    records = _records(docs, min_chars, key, text)
    streamed = _streamed(records, max(1, min_docs))
    # At most two rows per task.
    outer = streamed.filter(f"state = {SUMMARY}").groupBy("h1", "h2").agg(
        F.sum("docs").alias("sum_docs"), F.min(F.struct("none", "key", "t1", "t2")).alias("first")
    )
    often = outer.filter(F.col("sum_docs") >= min_docs).select("h1", "h2")
    gone = streamed.filter(f"state = {SURE}").unionByName(streamed.filter(f"state = {OPEN}").join(often, ["h1", "h2"], "left_semi").select(*streamed.columns))
    if keep_first:
        here = F.struct("none", "key", "t1", "t2")
        gone = gone.join(outer.select("h1", "h2", "first"), ["h1", "h2"], "left")
        lead = F.col("lead") & (~F.col("edge") | here.eqNullSafe(F.col("first")))
        gone = gone.withColumn("at", F.when(lead, F.expr("slice(at, 2, size(at))")).otherwise(F.col("at")))
    gone = gone.select("t1", "t2", "h1", "h2", "at").dropDuplicates(["t1", "t2", "h1", "h2"])
    places = gone.groupBy("t1", "t2").agg(F.flatten(F.collect_list("at")).alias("at"))
    heads = records.filter("h1 is null").select("key", "t1", "t2", "n_lines").dropDuplicates(["t1", "t2"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_lines = batch.column(3).to_pylist()
            lists = [np.array(v or [], np.int64) for v in batch.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(n_lines, pa.int64()), pa.array([len(v) for v in lists], pa.int64()), pa.array(map(pack_keep, n_lines, lists), pa.binary())],
                names=["key", "t1", "t2", "n_lines", "n_dropped", "keep"],
            )

    kind = heads.schema["key"].dataType.simpleString()
    joined = heads.join(places, ["t1", "t2"], "left").select("key", "t1", "t2", "n_lines", "at")
    return joined.mapInArrow(run, f"key {kind}, t1 long, t2 long, n_lines long, n_dropped long, keep binary")


def drop_lines(docs: DataFrame, bitmaps: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with only the lines that stay in ``text``; other columns as they are, null texts stay null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n_lines, keep = (batch.column(i) for i in (1, 2, 3))
            texts = texts.cast(pa.binary()).to_pylist()
            done = [None if t is None else kept_text(t, n, k) for t, n, k in zip(texts, n_lines.to_pylist(), keep.to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(done, pa.binary()).view(pa.string())], names=["row", "text"])

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *tags(key, text), F.col(text).cast("string").alias("text"))
    joined = rows.join(bitmaps.drop("key"), ["t1", "t2"]).select("row", "text", "n_lines", "keep")
    kind = joined.schema["row"].dataType.simpleString()
    done = joined.mapInArrow(run, f"row {kind}, text string")
    return done.select(*[F.col("text").alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def digest(docs: DataFrame, bitmaps: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: ``key, n_lines, n_dropped, kept_sha256`` of the lines that stay (null text: empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n_lines, dropped, keep = (batch.column(i) for i in (1, 2, 3, 4))
            texts, cut = texts.cast(pa.binary()).to_pylist(), dropped.to_pylist()
            whole = [(t or b"") if not d else kept_text(t, n, k) for t, n, d, k in zip(texts, n_lines.to_pylist(), cut, keep.to_pylist())]
            sums = pa.array([hashlib.sha256(t).hexdigest() for t in whole], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), n_lines, dropped, sums], names=["key", "n_lines", "n_dropped", "kept_sha256"])

    rows = docs.select(F.col(key).alias("key"), *tags(key, text), F.col(text).cast("string").alias("text"))
    joined = rows.join(bitmaps.drop("key"), ["t1", "t2"]).select("key", "text", "n_lines", "n_dropped", "keep")
    kind = joined.schema["key"].dataType.simpleString()
    return joined.mapInArrow(run, f"key {kind}, n_lines long, n_dropped long, kept_sha256 string").withColumnRenamed("key", key)
