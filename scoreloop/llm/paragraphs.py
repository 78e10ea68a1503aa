"""Substring dedup: repeated paragraphs by MinHash bands, exact Jaccard and components.

A paragraph here is a stretch of text between two cuts that depend on nearby content only,
so a passage is cut alike wherever it stands: after a sentence or line of at least five words
(short ones go on with the next), and inside pieces of over ``LONG`` words where the hash of
two neighbouring words is the lowest within ``REACH`` words on either side. Equal paragraphs have one digest and are one node from the start. Nodes
that share a band of several hashes are compared, first with the band's centre, then with each
other where they are not yet in one component (see ``near_sets``), by the exact Jaccard
similarity of five-word shingles; verified pairs are clustered by components. A cluster found in several documents is a repeat. Stretches of repeated paragraphs
of at least ``run_words`` words are reported; in them all paragraphs but those of their
cluster's first document are removals, so each cluster keeps a copy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scoreloop.llm.common import components, stored
from scoreloop.llm.near_sets import _ODD, bands_for, linked, salt
from scoreloop.llm.near_sets import mix as _mix

SHINGLE, LONG, REACH = 5, 36, 8
# Digests that a task remembers, to send each band of equal paragraphs once.
MEMORY = 500_000
_LINE = "\x1e"


class Cut:
    """The paragraphs of some whole texts (null: empty), in arrays over all of them.

    ``doc``, ``start`` (its first word in its text), ``words``, ``digest``, ``hashes`` of the
    words with ``first``, the paragraph's first word in them.
    """

    def __init__(self, texts: list[bytes | None]) -> None:
        import xxhash

        column = pa.array([t or b"" for t in texts], pa.large_binary()).view(pa.large_string())
        split = pc.ascii_split_whitespace(pc.replace_substring(pc.ascii_lower(column), "\n", f" {_LINE} "))
        coded = split.flatten().dictionary_encode()
        known = coded.dictionary.view(pa.large_binary()).to_pylist()
        codes = coded.indices.to_numpy(zero_copy_only=False)
        counts = pc.list_value_length(split).to_numpy(zero_copy_only=False)
        doc = np.repeat(np.arange(len(texts)), counts)
        digest = np.array([xxhash.xxh64_intdigest(w, 42) for w in known], np.uint64)
        stops = np.array([w[-1:] in (b".", b"!", b"?") for w in known], bool)
        line = np.array([w == _LINE.encode() for w in known], bool)[codes] if known else np.zeros(0, bool)
        empty = np.array([w == b"" for w in known], bool)[codes] if known else np.zeros(0, bool)
        real = ~(line | empty)
        # A word before a line break ends its line.
        nth = np.cumsum(real)
        breaks = np.zeros(int(nth[-1]) if len(nth) else 0, bool)
        at = nth[line] - 1
        breaks[at[at >= 0]] = True
        codes, doc = codes[real], doc[real]
        n = len(codes)
        self.hashes = digest[codes] if n else np.zeros(0, np.uint64)
        last = np.ones(n, bool)
        last[:-1] = doc[1:] != doc[:-1]
        ends = np.flatnonzero((stops[codes] if n else np.zeros(0, bool)) | breaks | last)
        lengths = np.diff(ends, prepend=-1)
        cuts = np.zeros(n, bool)
        ends = ends[(lengths >= SHINGLE) | last[ends]]
        cuts[ends] = True
        lengths = np.diff(ends, prepend=-1)
        # Within such a piece, not so close to its ends that what is cut off could match nothing.
        long, at = np.repeat(lengths > LONG, lengths), np.arange(n)
        inner = (at - np.repeat(ends - lengths, lengths) >= SHINGLE) & (np.repeat(ends, lengths) - at >= SHINGLE)
        cuts |= long & inner & self._lowest(doc)
        to = np.flatnonzero(cuts) + 1
        self.first = np.concatenate(([0], to[:-1])).astype(np.int64) if len(to) else np.zeros(0, np.int64)
        self.words = to - self.first
        self.doc = doc[self.first] if n else np.zeros(0, np.int64)
        begin = np.searchsorted(doc, np.arange(len(texts)))
        self.start = self.first - begin[self.doc]
        # Shingles start at every word; those that would leave the paragraph are masked.
        rolled = np.zeros(n, np.uint64)
        for k in range(SHINGLE):
            part = np.zeros(n, np.uint64)
            part[: max(0, n - k)] = self.hashes[k:]
            rolled = _mix(rolled * _ODD[0] + part)
        inside = np.repeat(to - SHINGLE, self.words) >= np.arange(n)
        self.shingles = np.where(inside, rolled, np.uint64(0xFFFFFFFFFFFFFFFF))
        places = np.arange(n) - np.repeat(self.first, self.words)
        mixed = _mix(self.hashes + (places.astype(np.uint64) + np.uint64(1)) * _ODD[0])
        self.digest = _mix(np.add.reduceat(mixed, self.first) + self.words.astype(np.uint64)) if n else np.zeros(0, np.uint64)

    def _lowest(self, doc: np.ndarray) -> np.ndarray:
        """Words whose pair with the word before has the lowest hash among its neighbours in the text."""
        before = np.roll(self.hashes, 1)
        before[np.flatnonzero(np.diff(doc, prepend=-1))] = 0
        pair = _mix(self.hashes * _ODD[0] + before)
        low = np.ones(len(doc), bool)
        for k in range(1, min(REACH, len(doc) - 1) + 1):
            other = doc[k:] != doc[:-k]
            low[k:] &= other | (pair[k:] < pair[:-k])
            low[:-k] &= other | (pair[:-k] < pair[k:])
        return low

    def minima(self, k: int) -> np.ndarray:
        """The smallest shingle of each paragraph under the k-th hash (paragraphs of five words or more)."""
        top = np.uint64(0xFFFFFFFFFFFFFFFF)
        return np.minimum.reduceat(np.where(self.shingles == top, top, _mix(self.shingles ^ salt(k))), self.first)

    def matchable(self, similarity: float) -> np.ndarray:
        """Paragraphs that a different one can be similar to.

        Without a word twice, n shingles stand in one order only, so that a different paragraph has
        another set; the most similar one has one shingle more, and n of n + 1 may be too few.
        """
        n = self.words - SHINGLE + 1
        short = (n > 0) & (n < similarity * (n + 1))
        owner = np.repeat(np.arange(len(n)), self.words)
        at = np.flatnonzero(short[owner])
        at = at[np.lexsort((self.hashes[at], owner[at]))]
        twice = (owner[at[1:]] == owner[at[:-1]]) & (self.hashes[at[1:]] == self.hashes[at[:-1]])
        short[owner[at[1:][twice]]] = False
        return (n > 0) & ~short


def _texts(batch: pa.RecordBatch, size: int = 1 << 22) -> Iterator[tuple[int, list[bytes | None]]]:
    """The texts of the second column in groups of about ``size`` bytes, with the first one's row."""
    held, total, at = [], 0, 0
    for row, text in enumerate(batch.column(1).cast(pa.binary())):
        held.append(text.as_py())
        total += len(held[-1] or b"")
        if total >= size:
            yield at, held
            held, total, at = [], 0, row + 1
    if held:
        yield at, held


def _star(shared: DataFrame) -> DataFrame:
    """``(band, h, centre)`` for each member of a band that is not its centre, from ``(band, h)``.

    Bands are dealt out by themselves first: in one step with the window, the struct that orders
    them would go through the shuffle too, and make its rows more than twice as wide.
    """
    # Every band has a centre of its own, so that two bands of the same nodes differ in it.
    centre = F.min(F.struct(F.xxhash64("band", "h"), "h")).over(Window.partitionBy("band"))["h"]
    return shared.repartition("band").withColumn("centre", centre).filter("h <> centre").distinct()


def repeats(docs: DataFrame, similarity: float = 0.8, run_words: int = 24, recall: float = 0.99, band_rows: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, start_word, n_words, first_id, removed)``: each run of repeated paragraphs.

    Words are counted over the whole text, split at ASCII white space, A-Z lowered. A passage
    of 50 words has about 40 in whole paragraphs; ``run_words`` leaves room for its ragged
    ends and excludes lone common lines. Each paragraph is ``removed`` where the smallest key
    that holds one of its cluster is another document. A stretch whose paragraphs differ in
    that gives a run for each part; ``run_words`` holds for the whole stretch, so a part may
    be shorter. ``first_id`` is the smallest such key of the run's paragraphs. Paragraphs
    under five words match nothing, and go with the repeats on both sides of them; repeats inside one document alone are no repeats. Null
    keys and null texts take no part; rows that repeat a key count as one document; 64-bit
    digests stand for paragraphs. An empty table gives no rows.
    """
    bands = bands_for(similarity, recall, band_rows)
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).dropna()
    kind = rows.schema["key"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in _texts(batch):
                c = Cut(texts)
                keep = c.words >= SHINGLE
                keys = batch.column(0).take(pa.array(at + c.doc[keep]))
                cols = [c.digest.view(np.int64), c.start.astype(np.int32), c.words.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([keys, *(pa.array(v[keep]) for v in cols)], names=["key", "h", "start", "words"])

    def band(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()
        for batch in batches:
            for _, texts in _texts(batch):
                c = Cut(texts)
                _, once = np.unique(c.digest, return_index=True)
                once = once[c.matchable(similarity)[once]]
                fresh = [i for i, h in zip(once.tolist(), c.digest[once].tolist()) if h not in sent]
                if len(sent) > MEMORY:
                    sent.clear()
                sent.update(c.digest[fresh].tolist())
                if not fresh:
                    continue
                for b in range(bands):
                    value = np.full(len(fresh), b, np.uint64)
                    for r in range(band_rows):
                        value = _mix(value * _ODD[0] + c.minima(b * band_rows + r)[fresh])
                    yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(c.digest[fresh].view(np.int64))], names=["band", "h"])

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sets = [], []
            for at, texts in _texts(batch):
                c = Cut(texts)
                here = {(d, s, w): i for i, (d, s, w) in enumerate(zip(c.doc.tolist(), c.start.tolist(), c.words.tolist()))}
                digest = c.digest.view(np.int64)
                for row, wanted in enumerate(batch.column(2).slice(at, len(texts)).to_pylist()):
                    for p in wanted:
                        i = here.get((row, p["start"], p["words"]))
                        # Another row may hold other text under the same key.
                        if i is not None and digest[i] == p["h"]:
                            nodes.append(p["h"])
                            sets.append(np.unique(c.shingles[c.first[i] : c.first[i] + c.words[i] - SHINGLE + 1]).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["h", "items"])

    found = stored(rows.mapInArrow(cut, f"key {kind}, h long, start int, words int"), "paragraphs")
    shared = rows.mapInArrow(band, "band long, h long")
    star = stored(_star(shared), "star")
    nodes = star.select("h").union(star.select("centre")).distinct()
    # One place of each node, and its shingles from there.
    place = F.min(F.struct("key", "start", "words")).alias("p")
    places = found.join(nodes, "h", "left_semi").groupBy("h").agg(place)
    places = places.groupBy("p.key").agg(F.collect_list(F.struct("h", "p.start", "p.words")).alias("place"))
    sets = rows.join(places, "key").select("key", "text", "place").mapInArrow(spell, "h long, items array<long>")
    sets = stored(sets, "sets").dropDuplicates(["h"])
    roots = stored(components(linked(star, sets, similarity)).select(F.col("node").alias("h"), "root"), "roots")
    # Per node the documents it spans, then per cluster.
    spans = found.groupBy("h").agg(F.min("key").alias("low"), F.max("key").alias("high"))
    spans = spans.join(roots, "h", "left").withColumn("cluster", F.coalesce("root", "h"))
    spans = stored(spans.filter("low <> high OR root IS NOT NULL"), "spans")
    whole = spans.groupBy("cluster").agg(F.min("low").alias("first_id"), F.max("high").alias("high")).filter("first_id <> high")
    repeated = spans.select("h", "cluster").join(whole, "cluster").select("h", "first_id")
    hits = found.join(repeated, "h")
    hits = hits.withColumn("removed", F.col("first_id") < F.col("key"))
    # Paragraphs that follow each other make a stretch, and what lies between may be pieces too short to match; a run is a part of it that stays or goes as a whole.
    order = Window.partitionBy("key").orderBy("start", "words", "removed", "h")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    gap = F.coalesce(F.col("start") >= F.lag(F.col("start") + F.col("words") + SHINGLE).over(order), F.lit(True))
    turn = F.coalesce(F.col("removed") != F.lag("removed").over(order), F.lit(True))
    marked = hits.withColumns({"gap": gap, "fresh": gap | turn})
    marked = marked.withColumns({"stretch": F.sum(F.col("gap").cast("int")).over(so_far), "run": F.sum(F.col("fresh").cast("int")).over(so_far)})
    end = F.max(F.col("start") + F.col("words"))
    runs = marked.groupBy("key", "stretch", "run", "removed").agg(F.min("start").alias("start_word"), end.alias("end"), F.min("first_id").alias("first_id"))
    whole_stretch = Window.partitionBy("key", "stretch")
    joined = F.max("end").over(whole_stretch) - F.min("start_word").over(whole_stretch)
    return runs.withColumn("joined", joined).filter(F.col("joined") >= run_words).select(
        F.col("key").alias(key), "start_word", (F.col("end") - F.col("start_word")).alias("n_words"), "first_id", "removed"
    )
