"""Token files of directly addressable codes, and reading any token back.

An id is split into chunks of ``bits`` bits, lowest first. Level 0 holds the first
chunk of every id; a bitmap marks the ids that go on, and level k + 1 holds the next
chunk of just those, in order. A rank directory (marked bits before each 64-bit word)
turns a position at one level into its position at the next, so any token is read with
one lookup per level and no block is decoded.

One file image, all integers little-endian:

    magic "DAC1", bits (u32), levels (u32), documents (u64), ids (u64)
    document lengths (u64 each)
    per level: chunks (u64), the chunks (u8 or u16 each), and but for the last level:
               the bitmap (u64 words) and the rank directory (u64 each)

Images are rows of a Parquet table in the shared folder, so that Spark's commit
protocol makes each one appear once and whole, in any store Spark can write.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scoreloop.llm.common import stored
from scoreloop.llm.encode import encoder

# The magic and the layout of the head.
MAGIC = b"DAC1"
HEAD = struct.Struct("<4sIIQQ")
# Ids in an image before the next one begins (a document is never split).
IMAGE_IDS = 2_000_000


def write_image(docs: list[np.ndarray], bits: int = 8) -> bytes:
    """The file image of some documents' ids."""
    ids = np.concatenate([np.asarray(d, np.uint32) for d in docs]) if docs else np.zeros(0, np.uint32)
    kind = np.dtype("u1" if bits <= 8 else "<u2")
    levels, rest = [], ids
    while True:
        more = rest >> bits
        chunks = (rest & ((1 << bits) - 1)).astype(kind)
        on = more > 0
        if not on.any():
            levels.append((chunks, None))
            break
        levels.append((chunks, on))
        rest = more[on]
    out = [HEAD.pack(MAGIC, bits, len(levels), len(docs), len(ids)), np.array([len(d) for d in docs], "<u8").tobytes()]
    for chunks, on in levels:
        out += [struct.pack("<Q", len(chunks)), chunks.tobytes()]
        if on is not None:
            packed = np.packbits(on, bitorder="little")
            words = np.frombuffer(packed.tobytes() + bytes(-len(packed) % 8), "<u8")
            marked = np.bitwise_count(words).astype("<u8")
            out += [words.tobytes(), (np.cumsum(marked, dtype=np.uint64) - marked).astype("<u8").tobytes()]
    return b"".join(out)


class Image:
    """Random access to the tokens of a file image."""

    def __init__(self, data: bytes) -> None:
        magic, self.bits, n_levels, n_docs, self.n_ids = HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token file")
        at = HEAD.size
        lengths = np.frombuffer(data, "<u8", n_docs, at).astype(np.int64)
        self.bounds = np.concatenate(([0], np.cumsum(lengths)))
        at += 8 * n_docs
        kind = np.dtype("u1" if self.bits <= 8 else "<u2")
        self.chunks, self.words, self.ranks = [], [], []
        for level in range(n_levels):
            (n,) = struct.unpack_from("<Q", data, at)
            self.chunks.append(np.frombuffer(data, kind, n, at + 8))
            at += 8 + n * kind.itemsize
            if level < n_levels - 1:
                n_words = -(-n // 64)
                self.words.append(np.frombuffer(data, "<u8", n_words, at))
                self.ranks.append(np.frombuffer(data, "<u8", n_words, at + 8 * n_words))
                at += 16 * n_words

    def tokens(self, positions: np.ndarray) -> np.ndarray:
        """The ids at any positions."""
        at = np.asarray(positions, np.int64)
        found = self.chunks[0][at].astype(np.uint32)
        owner = np.arange(len(at))
        for level, (words, ranks) in enumerate(zip(self.words, self.ranks)):
            word, bit = words[at >> 6], (at & 63).astype(np.uint64)
            on = (word >> bit & np.uint64(1)).astype(bool)
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
            at, owner = (ranks[at >> 6].astype(np.int64) + below)[on], owner[on]
            found[owner] |= self.chunks[level + 1][at].astype(np.uint32) << np.uint32(self.bits * (level + 1))
        return found

    def document(self, k: int) -> np.ndarray:
        """The ids of the k-th document."""
        return self.tokens(np.arange(self.bounds[k], self.bounds[k + 1]))

    def documents(self) -> Iterable[np.ndarray]:
        return (self.document(k) for k in range(len(self.bounds) - 1))


def write_files(docs: DataFrame, path: str, end_id: int, key: str = "doc_id", text: str = "text", bits: int = 8, image_ids: int = IMAGE_IDS) -> DataFrame:
    """Write token files in ascending key order; gives the table of files.

    Columns: ``part`` (ranges of keys in order), ``seq`` (order within a part),
    ``first`` (ids of the part before this file), ``keys`` and ``content`` (the
    image). Null texts count as empty, null keys come first, repeated rows stay
    repeated, an empty table gives no file. Memory per task: one image's ids and
    one text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        part = TaskContext.get().partitionId()
        seq = before = size = 0
        keys, pending = [], []

        def image() -> pa.RecordBatch:
            rows = [[part], [seq], [before], [keys], [write_image(pending, bits)]]
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.list_(kind), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(rows, kinds)], names=["part", "seq", "first", "keys", "content"])

        for batch in batches:
            kind = batch.schema.field(0).type
            texts = (t.as_py() for t in batch.column(1).cast(pa.binary()))
            for row, found in enumerate(encode.each(texts)):
                ids = np.append(found, np.uint32(end_id))
                keys.append(batch.column(0)[row].as_py())
                pending.append(ids)
                size += len(ids)
                if size >= image_ids:
                    yield image()
                    seq, before, size, keys, pending = seq + 1, before + size, 0, [], []
        if pending:
            yield image()

    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    ordered = rows.repartitionByRange("key").sortWithinPartitions("key", "text")
    files = ordered.mapInArrow(run, f"part int, seq long, first long, keys array<{kind}>, content binary")
    return stored(files, "token-files")


def read_documents(files: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per document, from the files: ``key, start, n_tokens, ids_crc32``.

    ``start`` counts the ids of all documents before it; the running sum is
    taken over one row per part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                image = Image(batch.column(3)[row].as_py())
                part, first = batch.column(0)[row].as_py(), batch.column(1)[row].as_py()
                sums = [zlib.crc32(ids.astype("<u4").tobytes()) for ids in image.documents()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(2)[row].values, pa.array([part] * len(sums), pa.int32()), pa.array(first + image.bounds[:-1]), pa.array(np.diff(image.bounds)), pa.array(sums, pa.int64())],
                    names=["key", "part", "local", "n_tokens", "ids_crc32"],
                )

    kind = files.schema["keys"].dataType.elementType.simpleString()
    docs = files.select("part", "first", "keys", "content").mapInArrow(run, f"key {kind}, part int, local long, n_tokens long, ids_crc32 long")
    docs = stored(docs, "token-documents")
    totals = docs.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", F.coalesce(F.sum("total").over(ahead), F.lit(0)).alias("offset"))
    return docs.join(offsets, "part").select(
        F.col("key").alias(key), (F.col("offset") + F.col("local")).alias("start"), "n_tokens", "ids_crc32"
    )
