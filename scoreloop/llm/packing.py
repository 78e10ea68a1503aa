"""Best-fit packing planned on the histogram of lengths.

Only ``(length, count)`` reaches the planner: at most ``capacity`` rows, whatever the
corpus holds. It fills sequences best-fit, longest first, whole groups of equal
sequences at a time, and gives back slots per length. Pieces then take the slots of
their length in the order of their rank.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scoreloop.llm.common import stored
from scoreloop.llm.encode import encoder

# Pieces that are ranked together; more of one length are ranked cell by cell.
CELL_ROWS = 2_000

PLAN_SCHEMA = "length long, first_rank long, last_rank long, sequence long, per_sequence long, base long"


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Slots ``(length, first_rank, last_rank, sequence, per_sequence, base)``.

    The piece of ``rank`` (from 0) in ``[first_rank, last_rank)`` goes to sequence
    ``sequence + (rank - first_rank) // per_sequence``, at ``base`` plus its number
    within that sequence times ``length``.

    A length opens at most four groups, and a group's room at least halves each time
    a length is put into it, so there are at most ``4 * capacity * log2(capacity)`` slots.
    """
    rooms: list[int] = []  # sorted rooms that some group of sequences has left
    groups: dict[int, list[tuple[int, int]]] = {}  # room -> (first sequence, how many)
    slots, opened = [], 0

    def put(first: int, n: int, room: int) -> None:
        if n and room:
            if room not in groups:
                bisect.insort(rooms, room)
                groups[room] = []
            groups[room].append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect.bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, n = groups[room].pop()
                if not groups[room]:
                    del groups[room], rooms[at]
            else:
                room, first, n = capacity, opened, -(-left // (capacity // length))
                opened += n
            each = room // length
            full, over = divmod(min(left, n * each), each)
            for begin, many, fits in ((first, full, each), (first + full, over > 0, over)):
                if many:
                    slots.append((length, rank, rank + many * fits, begin, fits, capacity - room))
                    rank += many * fits
                    left -= many * fits
                    put(begin, int(many), room - fits * length)
            used = full + (over > 0)
            put(first + used, n - used, room)
    return slots


def pieces(docs: DataFrame, path: str, end_id: int, capacity: int = 4096, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, piece, start, length, ids_crc32, ids)`` for every row's pieces.

    A document's ids end with ``end_id``; those longer than ``capacity`` are cut into
    pieces of it, of which the last may be shorter. Null texts count as empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        names = ["key", "piece", "start", "length", "ids_crc32", "ids"]
        for batch in batches:
            keys, texts = batch.column(0), (t.as_py() for t in batch.column(1).cast(pa.binary()))
            rows, cols = [], ([], [], [], [], [])
            for row, found in enumerate(encode.each(texts)):
                ids = np.append(found, np.uint32(end_id)).astype("<u4")
                for k, at in enumerate(range(0, len(ids), capacity)):
                    part = ids[at : at + capacity].tobytes()
                    rows.append(row)
                    for col, value in zip(cols, (k, at, len(part) // 4, zlib.crc32(part), part)):
                        col.append(value)
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            arrays = [pa.array(c, k) for c, k in zip(cols, kinds)]
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(rows, pa.int64())), *arrays], names=names)

    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    out = rows.mapInArrow(run, f"key {kind}, piece int, start long, length long, ids_crc32 long, ids binary")
    return out.withColumnRenamed("key", key)


def assign(items: DataFrame, keys: list[str], capacity: int, length: str = "length", cell_rows: int = CELL_ROWS) -> DataFrame:
    """``items`` with ``sequence_id`` and ``offset``: no sequence holds more than ``capacity``.

    ``items`` should be a stored table, as it is read more than once. ``keys`` order
    items of one length; items equal in all of them are interchangeable. Lengths must
    lie between 1 and ``capacity``. Ranks within a length are counted in cells of about
    ``cell_rows`` items, so a hot length spreads over many tasks.
    """
    spark = items.sparkSession
    # One row per length: the histogram is all that comes to the driver, and the
    # slots and cell counts made from it are bounded by the capacity, not by the data.
    counts = {r[0]: r[1] for r in items.groupBy(length).count().collect()}
    if any(n is None or not 1 <= n <= capacity for n in counts):
        raise ValueError(f"lengths must lie between 1 and {capacity}")
    slots = spark.createDataFrame(plan(counts, capacity), PLAN_SCHEMA)
    cells = spark.createDataFrame([(n, -(-c // cell_rows)) for n, c in counts.items()], "_of long, _cells long")
    dealt = items.join(F.broadcast(cells), F.col(length) == F.col("_of"))
    dealt = dealt.withColumn("_cell", F.pmod(F.xxhash64(*keys), F.col("_cells"))).drop("_of", "_cells")
    sizes = dealt.groupBy(length, "_cell").count()
    ahead = Window.partitionBy(length).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        F.col(length).alias("_length"), F.col("_cell").alias("_at"), F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("_ahead")
    )
    inside = Window.partitionBy(length, "_cell").orderBy(*keys)
    ranked = dealt.withColumn("_in", F.row_number().over(inside) - 1)
    ranked = ranked.join(offsets, (F.col(length) == F.col("_length")) & (F.col("_cell") == F.col("_at")))
    ranked = ranked.withColumn("_rank", F.col("_ahead") + F.col("_in")).drop("_length", "_at", "_ahead", "_in", "_cell")
    slots = slots.withColumnsRenamed({c: f"_{c}" for c in slots.columns})
    taken = ranked.join(
        F.broadcast(slots),
        (F.col(length) == F.col("_length")) & (F.col("_rank") >= F.col("_first_rank")) & (F.col("_rank") < F.col("_last_rank")),
    )
    nth = F.col("_rank") - F.col("_first_rank")
    return taken.select(
        *items.columns,
        (F.col("_sequence") + F.floor(nth / F.col("_per_sequence"))).cast("long").alias("sequence_id"),
        (F.col("_base") + nth % F.col("_per_sequence") * F.col(length)).cast("long").alias("offset"),
    )


def pack(docs: DataFrame, path: str, end_id: int, capacity: int = 4096, key: str = "doc_id", text: str = "text", keep_ids: bool = True, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Pack all rows of ``docs`` into sequences of at most ``capacity`` ids.

    Gives a row per piece: ``key, piece, start, length, ids_crc32, sequence_id,
    offset`` and, with ``keep_ids``, the ids themselves (little-endian unsigned
    32-bit). Null and empty texts are one ``end_id``; repeated rows are packed
    as often as they occur; an empty table gives no rows.
    """
    cut = pieces(docs, path, end_id, capacity, key, text)
    cut = stored(cut if keep_ids else cut.drop("ids"), "pieces")
    return assign(cut, [key, "piece", "ids_crc32"], capacity, cell_rows=cell_rows)


def sequences(packed: DataFrame) -> DataFrame:
    """The training sequences themselves: ``sequence_id, ids`` from a result of ``pack``."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id",
        F.aggregate("parts", F.lit(b""), lambda acc, p: F.concat(acc, p["ids"])).alias("ids"),
    )
