"""Links between sets of a high Jaccard similarity, and documents without near copies.

Sets that share a MinHash band are compared with the exact Jaccard similarity of their hashed
shingles. Every member meets its band's centre, and other centres after it while components
still differ; members that remain apart are compared block by block. So the components hold all
similar pairs that share a band, a large group of near copies falls together without its pairs,
and a band of unlike sets never makes a row per pair.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloop.llm.common import components, stored

SHINGLE = 5
# Centres a band has one after another at most; a turn goes on to the next if one in so many of its pairs is a link.
TURNS, GAIN = 8, 10
# Items of a block of sets, and of a matrix at a time.
BLOCK_ITEMS, COLUMNS = 1 << 16, 4096
_ODD = [np.uint64(v) for v in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def bands_for(similarity: float, recall: float, rows: int = 1) -> int:
    """The fewest bands of ``rows`` hashes that find a pair of ``similarity`` with probability ``recall``."""
    if similarity >= 1:
        return 1
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows)))


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _ODD[1]
    h = (h ^ (h >> np.uint64(27))) * _ODD[2]
    return h ^ (h >> np.uint64(31))


def salt(k: int) -> np.uint64:
    return np.uint64((k + 1) * 0x5851F42D4C957F2D & 0xFFFFFFFFFFFFFFFF)


def linked(star: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Verified links ``(src, dst)``; their components hold all similar pairs that share a band.

    ``star`` has ``(band, h, centre)`` for each member that is not its band's centre, and
    ``sets`` one row ``(h, items)`` per member, ``items`` without repeats in one order for all.

    A round compares every member of a band with one centre, unless both are in the same
    component by then, and takes another centre next time, so a large group of near copies
    falls into one component after a few rounds of one pair per member. Rounds end when they
    link few of their pairs: what is still apart then, in bands of more than one component, is
    compared in full in blocks of bounded size, and only links leave a task, one for a set and
    a component on the other side.
    """

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(i) for i in (2, 3)]
            fits = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                one, two = (c[i].values.to_numpy(zero_copy_only=False) for c in columns)
                both = len(np.intersect1d(one, two, assume_unique=True))
                fits[i] = both >= similarity * (len(one) + len(two) - both)
            mask = pa.array(fits)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["src", "dst"])

    def verified(pairs: DataFrame) -> DataFrame:
        a = sets.select(F.col("h").alias("src"), F.col("items").alias("a"))
        b = sets.select(F.col("h").alias("dst"), F.col("items").alias("b"))
        return pairs.join(a, "src").join(b, "dst").select("src", "dst", "a", "b").mapInArrow(similar, "src long, dst long")

    def ordered(one: str, two: str) -> list[Column]:
        return [F.least(one, two).alias("src"), F.greatest(one, two).alias("dst")]

    def close(n: str, m: str) -> Column:
        """Sets whose sizes are further apart cannot be that similar."""
        return F.least(n, m) >= similarity * F.greatest(n, m)

    def merged(members: DataFrame, links: DataFrame) -> DataFrame:
        """Members with their components after more links; only components that change are looked at."""
        part = members.select("h", "part").distinct()
        ends = links.join(part.select(F.col("h").alias("src"), F.col("part").alias("p")), "src")
        ends = ends.join(part.select(F.col("h").alias("dst"), F.col("part").alias("q")), "dst")
        roots = components(ends.select(F.col("p").alias("src"), F.col("q").alias("dst"))).select(F.col("node").alias("part"), "root")
        grown = members.join(roots, "part", "left").select("band", "h", "n", F.coalesce("root", "part").alias("part"))
        # Bands of one component are done.
        split = grown.groupBy("band").agg(F.min("part").alias("low"), F.max("part").alias("high")).filter("low <> high").select("band")
        return stored(grown.join(split, "band", "left_semi"), "members")

    members = star.select("band", "h").union(star.select("band", "centre")).distinct()
    members = members.join(sets.select("h", F.size("items").alias("n")), "h").select("band", "h", "n", F.col("h").alias("part"))
    members = stored(members, "members")
    first = star.select(*ordered("centre", "h")).distinct()
    found, compared = [], [stored(first, "pairs")]
    for turn in range(1, TURNS + 1):
        found.append(stored(verified(compared[-1]), "found_links"))
        members = merged(members, found[-1])
        # A turn that links few of its pairs shows bands of unlike sets, which more turns do not merge.
        tried, linked_now = compared[-1].count(), found[-1].count()
        if linked_now * GAIN < tried or turn == TURNS:
            break
        order = F.struct(F.xxhash64("h", F.lit(turn)).alias("x"), "h", "n", "part")
        centre = members.groupBy("band").agg(F.min(order).alias("m")).select(
            "band", F.col("m.h").alias("_h"), F.col("m.n").alias("_n"), F.col("m.part").alias("_part")
        )
        pairs = members.join(centre, "band").filter((F.col("part") != F.col("_part")) & close("n", "_n")).select(*ordered("h", "_h")).distinct()
        compared.append(stored(pairs.join(reduce(DataFrame.union, compared), ["src", "dst"], "left_anti"), "pairs"))
    # What is still apart is compared in blocks of a bounded number of items, band by band.
    spread = members.groupBy("band").agg(F.greatest(F.lit(1), F.ceil(F.sum("n") / float(BLOCK_ITEMS)).cast("int")).alias("k"))
    rows = members.join(spread, "band").select("band", "h", "part", F.pmod(F.xxhash64("h", F.lit("block")), F.col("k")).cast("int").alias("block"))
    rows = rows.join(sets, "h").groupBy("band", "block").agg(F.collect_list(F.struct("h", "part", "items")).alias("rows"))
    blocks = stored(rows, "set_blocks")
    pairs = spread.select("band", "k", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("a"))
    pairs = pairs.select("band", "a", F.explode(F.sequence(F.col("a"), F.col("k") - 1)).alias("b"))
    side = lambda s: blocks.select("band", F.col("block").alias(s), F.col("rows").alias(f"rows_{s}"))
    met = pairs.join(side("a"), ["band", "a"]).join(side("b"), ["band", "b"]).select("rows_a", "rows_b")

    def crossed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one, two = (_unpacked(batch.column(c)[i].values) for c in (0, 1))
                src, dst = _similar_across(one, two, similarity)
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(src, dst)), pa.array(np.maximum(src, dst))], names=["src", "dst"])

    return reduce(DataFrame.union, [*found, met.mapInArrow(crossed, "src long, dst long").distinct()])


def _unpacked(rows: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Nodes, components, sizes, and all items of a block one set after another."""
    lists = rows.field("items")
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    own = (rows.field(c).to_numpy(zero_copy_only=False) for c in ("h", "part"))
    return *own, sizes, lists.flatten().to_numpy(zero_copy_only=False)


def _similar_across(one: tuple, two: tuple, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Links between sets of two blocks in different components, one per set and component on the other side.

    Shared items are counted by products of 0-1 matrices over the items both blocks have.
    """
    (h1, p1, n1, i1), (h2, p2, n2, i2) = one, two
    common = np.intersect1d(i1, i2)
    both = np.zeros((len(h1), len(h2)), np.float32)
    where = []
    for items, sizes in ((i1, n1), (i2, n2)):
        at = np.minimum(np.searchsorted(common, items), max(0, len(common) - 1))
        hit = common[at] == items if len(common) else np.zeros(len(items), bool)
        where.append((np.repeat(np.arange(len(sizes)), sizes)[hit], at[hit]))
    for low in range(0, len(common), COLUMNS):
        held = []
        for (row, at), h in zip(where, (h1, h2)):
            here = (at >= low) & (at < low + COLUMNS)
            m = np.zeros((len(h), min(COLUMNS, len(common) - low)), np.float32)
            m[row[here], at[here] - low] = 1
            held.append(m)
        both += held[0] @ held[1].T
    # Sums of ones are exact in single precision up to 16 million shared items.
    shared = both.astype(np.float64)
    fits = (shared >= similarity * (n1[:, None] + n2[None, :] - shared)) & (p1[:, None] != p2[None, :])
    a, b = np.nonzero(fits)
    _, first = np.unique(np.stack((a, p2[b])), axis=1, return_index=True)
    return h1[a[first]], h2[b[first]]


def shingles(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed five-word shingles of some whole texts, and where each text's begin (one entry more than texts).

    Words are split at ASCII white space, A-Z lowered. A text of one to four words has one
    shingle, of all its words; one without words has none.
    """
    import xxhash

    column = pa.array([t or b"" for t in texts], pa.large_binary()).view(pa.large_string())
    split = pc.ascii_split_whitespace(pc.ascii_lower(column))
    coded = split.flatten().dictionary_encode()
    known = coded.dictionary.view(pa.large_binary()).to_pylist()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    doc = np.repeat(np.arange(len(texts)), pc.list_value_length(split).to_numpy(zero_copy_only=False))
    real = np.array([w != b"" for w in known], bool)[codes] if known else np.zeros(0, bool)
    codes, doc = codes[real], doc[real]
    hashes = np.array([xxhash.xxh64_intdigest(w, 42) for w in known], np.uint64)[codes] if known else np.zeros(0, np.uint64)
    n = len(hashes)
    begin = np.searchsorted(doc, np.arange(len(texts) + 1))
    words = np.diff(begin)
    left = np.repeat(begin[1:], words) - np.arange(n)
    rolled = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        part = np.zeros(n, np.uint64)
        part[: max(n - k, 0)] = hashes[k:]
        rolled = mix(rolled * _ODD[0] + np.where(left > k, part, np.uint64(k)))
    keep = (left >= SHINGLE) | (np.arange(n) == np.repeat(begin[:-1], words))
    return rolled[keep], np.concatenate(([0], np.cumsum(keep)))[begin]


def keep_first(
    docs: DataFrame, similarity: float = 0.8, recall: float = 0.999, band_rows: int = 6, key: str = "doc_id", text: str = "text",
    also: Callable[[DataFrame, str, str], DataFrame] | None = None,
) -> DataFrame:
    """One row of each group of near copies; all columns as they are.

    Two texts are linked where their sets of five-word shingles have a Jaccard similarity of
    ``similarity`` or more; a pair just that similar shares a band with probability
    ``recall``, texts of equal sets always meet. A group is a component over links. The row
    with the smallest key stays (null keys last), then by the text's hash, then the smallest
    row, so repeated keys and repeated rows leave one row too. Texts without words are copies
    of each other. 64-bit hashes stand for shingles, sets and texts.

    ``also`` is another way to find candidates: given rows and the names of their key and text it
    returns the key with a ``component_id``, and rows of one component are compared like those of a band.
    """
    bands = bands_for(similarity, recall, band_rows)
    halves = -(-bands * band_rows // 2)
    tag = F.xxhash64(F.col(key), F.col(text))
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"), tag.alias("tag"))
    kind = rows.schema["key"].dataType.simpleString()

    def parts(texts: list[bytes | None], size: int = 1 << 22) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Shingles and borders of about ``size`` bytes of text at a time, with the first text's place."""
        at, total = 0, 0
        for i, t in enumerate(texts):
            total += len(t or b"")
            if total >= size or i + 1 == len(texts):
                yield (at, *shingles(texts[at : i + 1]))
                at, total = i + 1, 0

    def node(own: np.ndarray) -> int:
        import xxhash

        return xxhash.xxh64_intdigest(own.tobytes(), 42)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, values = [], []
            for _, found, at in parts(batch.column(1).cast(pa.binary()).to_pylist()):
                some = np.flatnonzero(np.diff(at))
                own = np.zeros((len(at) - 1, bands), np.uint64)
                least = np.zeros((2 * halves, len(some)), np.uint64)
                for k in range(halves if len(some) else 0):
                    # The halves of one mix are two hash functions.
                    mixed = mix(found ^ salt(k))
                    least[2 * k] = np.minimum.reduceat(mixed >> np.uint64(32), at[some])
                    least[2 * k + 1] = np.minimum.reduceat(mixed & np.uint64(0xFFFFFFFF), at[some])
                for b in range(bands):
                    value = np.full(len(some), b, np.uint64)
                    for r in range(band_rows):
                        value = mix(value * _ODD[0] + least[b * band_rows + r])
                    own[some, b] = value
                nodes += [node(np.unique(found[s:e])) for s, e in zip(at, at[1:])]
                values.append(own)
            flat = np.concatenate(values).view(np.int64).ravel() if values else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(nodes) + 1) * bands, pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(np.array(nodes, np.uint64).view(np.int64)), lists], names=["key", "tag", "h", "bands"]
            )

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sets = [], []
            for _, found, at in parts(batch.column(0).cast(pa.binary()).to_pylist()):
                own = [np.unique(found[s:e]) for s, e in zip(at, at[1:])]
                nodes += [node(v) for v in own]
                sets += [v.view(np.int64) for v in own]
            yield pa.RecordBatch.from_arrays([pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(sets, pa.list_(pa.int64()))], names=["h", "items"])

    signed = stored(rows.mapInArrow(sign, f"key {kind}, tag long, h long, bands array<long>"), "signed")
    order = F.struct(F.col("key").isNull().alias("none"), "key", "tag")
    classes = signed.groupBy("h").agg(F.min(order).alias("least"), F.first("bands").alias("bands"))
    classes = stored(classes, "classes")
    shared = classes.select("h", F.explode("bands").alias("band"))
    if also:
        found = also(rows.select("tag", "text"), "tag", "text").select("tag", F.xxhash64(F.lit("also"), "component_id").alias("band"))
        more = signed.select("tag", "h").join(found.distinct(), "tag").select("h", "band").distinct()
        shared = stored(shared.union(more), "shared")
    # One order for all bands, so that a group mostly has one centre.
    centre = F.struct(F.xxhash64("h").alias("x"), "h")
    centres = shared.groupBy("band").agg(F.min(centre)["h"].alias("centre"), F.min("h").alias("low"), F.max("h").alias("high"))
    centres = centres.filter("low <> high").select("band", "centre")
    star = stored(shared.join(centres, "band").filter("h <> centre").select("band", "h", "centre"), "star")
    needed = star.select("h").union(star.select("centre")).distinct()
    # One row of each class has its text read again.
    needed = classes.join(needed, "h", "left_semi").select(F.col("least.tag").alias("tag")).distinct()
    sets = rows.join(needed, "tag", "left_semi").select("text").mapInArrow(gather, "h long, items array<long>")
    sets = stored(sets, "sets").dropDuplicates(["h"])
    roots = components(linked(star, sets, similarity)).select(F.col("node").alias("h"), "root")
    grouped = classes.join(roots, "h", "left").groupBy(F.coalesce("root", "h").alias("root")).agg(F.min("least").alias("least"))
    kept = stored(grouped.select(F.col("least.key").alias("_key"), F.col("least.tag").alias("_tag")), "kept")
    same = docs[key].eqNullSafe(F.col("_key")) & (tag == F.col("_tag"))
    counts = signed.groupBy("key", "tag").count().filter("count > 1")
    again = kept.join(counts, F.col("_key").eqNullSafe(F.col("key")) & (F.col("_tag") == F.col("tag"))).select("_key", "_tag")
    again = stored(again, "again")
    once = kept.join(again.select(F.col("_key").alias("k"), F.col("_tag").alias("t")), F.col("_key").eqNullSafe(F.col("k")) & (F.col("_tag") == F.col("t")), "left_anti")
    single = docs.join(once, same, "left_semi")
    if again.isEmpty():
        return single
    repeated = docs.join(again, same).groupBy("_key", "_tag").agg(F.min(F.struct(*docs.columns)).alias("row"))
    return single.unionByName(repeated.select("row.*"))
