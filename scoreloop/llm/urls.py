"""URL filters: all glob rules at once with a multiword Shift-And automaton.

A pattern of m items takes m + 1 bits: bit i says "the first i items match what was
read". A byte moves all bits one up, where the byte's mask lets them, and a star keeps
its bit alive over the bytes it admits:

    state = ((state << 1) & step[byte]) | (state & loop[byte])

All patterns lie side by side in 64-bit words, and a batch of URLs is advanced together,
one byte position at a time.

Glob items: ``*`` any run of bytes, ``%`` any run without a slash, ``?`` one byte, all
else itself. A pattern covers the whole canonical text, which is a dot, the lower-cased
host and the path.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_ONE = np.uint64(1)


@dataclass(frozen=True)
class Automaton:
    """Packed patterns: start bits, masks per byte, and the end bit of each pattern."""

    start: np.ndarray
    step: np.ndarray
    loop: np.ndarray
    ends: np.ndarray

    def match(self, texts: list[bytes]) -> np.ndarray:
        """Texts by patterns: which pattern covers which text."""
        order = np.argsort([-len(t) for t in texts], kind="stable")
        lengths = np.array([len(texts[i]) for i in order], np.int64)
        state = np.tile(self.start, (len(texts), 1))
        flat = np.frombuffer(b"".join(texts[i] for i in order), np.uint8)
        begins = np.cumsum(lengths) - lengths
        for at in range(int(lengths[0]) if len(lengths) else 0):
            live = int(np.searchsorted(-lengths, -at, "left"))  # the first ones are the longest
            byte = flat[begins[:live] + at]
            now = state[:live]
            moved = now << _ONE
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            state[:live] = (moved & self.step[byte]) | (now & self.loop[byte])
        found = np.zeros((len(texts), len(self.ends)), bool)
        found[order] = (state[:, self.ends >> 6] >> (self.ends & 63).astype(np.uint64) & _ONE).astype(bool)
        return found


def compile_globs(globs: list[str]) -> Automaton:
    """Pack glob patterns (by their UTF-8 bytes) into one automaton."""
    parsed: list[list[int | None]] = []
    stars: list[dict[int, bool]] = []  # state -> whether its star admits a slash
    for glob in globs:
        items, loops = [], {}
        for byte in glob.encode():
            if byte in b"*%":
                loops[len(items)] = loops.get(len(items), False) or byte == ord("*")
            else:
                items.append(None if byte == ord("?") else byte)
        parsed.append(items)
        stars.append(loops)
    size = sum(len(p) + 1 for p in parsed)
    words = max(1, -(-size // 64))
    start = np.zeros(words, np.uint64)
    step, loop = np.zeros((256, words), np.uint64), np.zeros((256, words), np.uint64)
    ends, first = [], 0
    slash = np.arange(256) == ord("/")
    for items, loops in zip(parsed, stars):
        start[first >> 6] |= _ONE << np.uint64(first & 63)
        for i, item in enumerate(items, first + 1):
            step[slice(None) if item is None else item, i >> 6] |= _ONE << np.uint64(i & 63)
        for i, any_byte in loops.items():
            loop[slice(None) if any_byte else ~slash, first + i >> 6] |= _ONE << np.uint64(first + i & 63)
        ends.append(first + len(items))
        first += len(items) + 1
    return Automaton(start, step, loop, np.array(ends, np.int64))


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; empty if there is none."""
    found = F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path(url: Column) -> Column:
    """What follows the host up to ``? #`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


@dataclass(frozen=True)
class Rule:
    """``verdict`` for a host, its subdomains, and the paths that begin with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def glob(self) -> str:
        if set("*%?") & set(self.name):
            raise ValueError("a rule's host and path are literal")
        return f"%.{self.host}{self.path}*"


def judge(pages: DataFrame, rules: list[Rule], block_globs: list[str], url: str = "url") -> DataFrame:
    """All columns of ``pages`` and ``host, path, rule, verdict``.

    The longest rule that fits decides; where none does, ``rule`` is null and the
    verdict is ``block`` if any of ``block_globs`` covers the canonical text, else
    ``allow``. Null and odd URLs have an empty host and path, which no rule fits.
    Columns of the four names are replaced. Each distinct URL of a batch is run once.
    """
    ranked = sorted(rules, key=lambda r: (-len(r.name), r.name))
    added = ["host", "path", "rule", "verdict"]
    names = [c for c in pages.columns if c not in added]
    # The automaton works on bytes; the columns it needs are cut by SQL functions.
    cut = pages.select(*names, host(F.col(url).cast("string")).alias("host"), path(F.col(url).cast("string")).alias("path"))
    schema = cut.select("*", F.lit("").cast("string").alias("rule"), F.lit("").alias("verdict")).schema
    for field in schema.fields[-4:]:
        field.nullable = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = compile_globs([r.glob for r in ranked] + list(block_globs))
        for batch in batches:
            hosts, paths = batch.column(len(names)), batch.column(len(names) + 1)
            texts = [f".{h}{p}".encode() for h, p in zip(hosts.to_pylist(), paths.to_pylist())]
            distinct = {t: i for i, t in enumerate(dict.fromkeys(texts))}
            hits = machine.match(list(distinct))
            fits, blocked = hits[:, : len(ranked)], hits[:, len(ranked) :].any(1)
            first = np.where(fits.any(1), fits.argmax(1), -1) if ranked else np.full(len(distinct), -1)
            which = [(int(first[k]), bool(blocked[k])) for k in map(distinct.__getitem__, texts)]
            rule = pa.array([ranked[k].name if k >= 0 else None for k, _ in which], pa.string())
            verdict = pa.array([ranked[k].verdict if k >= 0 else "block" if b else "allow" for k, b in which], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, rule, verdict], names=schema.names)

    return cut.mapInArrow(run, schema)
