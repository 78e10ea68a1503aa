"""Partitioned rows whose versions are small manifests over immutable folders.

A write makes a new folder of Parquet files and then publishes a manifest that names it, in
one rename that never replaces a file. A reader takes the newest manifest and its folders,
none of which ever changes, so it sees one version whatever is written meanwhile; a writer
that fails before the rename leaves nothing visible. Rows come in as deltas, so a write
costs what its rows cost; reading merges only the partitions that several folders hold, and
``compact`` folds the deltas into their partitions.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable, Mapping
from dataclasses import asdict, dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scoreloop.session import shuffle_files_removed
from scoreloop.sources.files import child_dirs, child_files, delete, publish_text, read_text

COMMIT = "row_commit"
# Place of a folder among the writes: later ones win.
SEQ = "row_seq"
BASE = "base"
# Writers that met on one version try again so often.
ATTEMPTS = 20

Merge = Callable[[Mapping[str, DataFrame]], DataFrame]


@dataclass(frozen=True)
class Delta:
    """One write: its folder, what its rows are, the version that brought it, its partition folders."""

    commit: str
    kind: str
    version: int
    partitions: tuple[str, ...]


@dataclass(frozen=True)
class Manifest:
    """One version: partition folder to the commit with its merged rows, then deltas in order."""

    version: int = 0
    base: Mapping[str, str] = field(default_factory=dict)
    deltas: tuple[Delta, ...] = ()
    # Last batch taken in from each source.
    batches: Mapping[str, int] = field(default_factory=dict)
    # Partition folders a commit wrote.
    sizes: Mapping[str, int] = field(default_factory=dict)

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> Manifest:
        found = json.loads(text)
        deltas = tuple(Delta(d["commit"], d["kind"], d["version"], tuple(d["partitions"])) for d in found["deltas"])
        return Manifest(found["version"], found["base"], deltas, found["batches"], found["sizes"])

    @property
    def commits(self) -> set[str]:
        return {*self.base.values(), *(d.commit for d in self.deltas)}

    def taken(self, batch: tuple[str, int] | None) -> bool:
        return batch is not None and self.batches.get(batch[0], -1) >= batch[1]


class VersionedRows:
    """Rows of one schema under ``path``, partitioned by one column.

    ``whole`` names the kinds of delta whose rows need no merge where their folder is the only
    one of a partition.
    """

    def __init__(self, spark: SparkSession, path: str, partition: str, schema: T.StructType, whole: Iterable[str] = ()):
        self.spark, self.path, self.partition, self.schema = spark, path.rstrip("/"), partition, schema
        self.whole = {BASE, *whole}

    # ---- versions ---------------------------------------------------------

    def _manifest_path(self, version: int) -> str:
        return f"{self.path}/manifests/{version:020d}.json"

    def versions(self) -> list[int]:
        return [int(name.removesuffix(".json")) for name in child_files(self.spark, f"{self.path}/manifests") if name.endswith(".json")]

    def manifest(self, version: int | None = None) -> Manifest:
        """A version, the newest unless named; version 0 is the empty table."""
        if version is None:
            version = max(self.versions(), default=0)
        if version == 0:
            return Manifest()
        return Manifest.from_json(read_text(self.spark, self._manifest_path(version)))

    def _publish(self, change: Callable[[Manifest], Manifest | None]) -> Manifest | None:
        """Make ``change`` of the newest version the next one; again on it if another writer was first."""
        for _ in range(ATTEMPTS):
            now = self.manifest()
            after = change(now)
            if after is None:
                return None
            after = replace(after, version=now.version + 1, sizes={c: n for c, n in after.sizes.items() if c in after.commits})
            if publish_text(self.spark, self._manifest_path(after.version), after.to_json()):
                return after
        raise RuntimeError(f"{ATTEMPTS} other writes came first: {self.path}")

    # ---- writes -----------------------------------------------------------

    def _write(self, *rows: DataFrame) -> tuple[str, tuple[str, ...]]:
        """Rows as a new folder nobody reads yet, and its partition folders; several parts one after the other."""
        commit = f"w{uuid.uuid4().hex}"
        # Rebalancing gathers each partition's rows into files of the advisory size and
        # splits a partition that is much larger than the others.
        path = f"{self.path}/rows/{COMMIT}={commit}"
        for part in rows:
            names = [F.col(f"`{f.name}`").cast(f.dataType) if f.name in part.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema.fields]
            mode = "append" if len(rows) > 1 else "errorifexists"
            with shuffle_files_removed(self.spark):
                part.select(*names).hint("rebalance", self.partition).write.mode(mode).partitionBy(self.partition).parquet(path)
        return commit, tuple(d for d in child_dirs(self.spark, path) if d.startswith(f"{self.partition}="))

    def append(self, rows: DataFrame | list[DataFrame], kind: str, batch: tuple[str, int] | None = None) -> bool:
        """Add rows, or parts of them, as one delta. False, and no new version, when there are none or the batch came before.

        ``batch`` is a source and its rising batch number; the manifest remembers the last one,
        so a batch that is run again changes nothing.
        """
        if self.manifest().taken(batch):
            return False
        commit, partitions = self._write(*(rows if isinstance(rows, list) else [rows]))
        if not partitions and batch is None:
            return False

        def change(now: Manifest) -> Manifest | None:
            if now.taken(batch):
                return None
            batches = {**now.batches, **({batch[0]: batch[1]} if batch else {})}
            delta = (Delta(commit, kind, now.version + 1, partitions),) if partitions else ()
            return replace(now, deltas=now.deltas + delta, batches=batches, sizes={**now.sizes, commit: len(partitions)})

        return self._publish(change) is not None and bool(partitions)

    def replace_all(self, rows: DataFrame) -> None:
        """A version of these rows alone."""
        commit, partitions = self._write(rows)
        self._publish(lambda now: Manifest(now.version, dict.fromkeys(partitions, commit), (), now.batches, {commit: len(partitions)}))

    # ---- reads ------------------------------------------------------------

    def _scan(self, folders: list[tuple[str, str, int]], sizes: Mapping[str, int]) -> DataFrame:
        """Rows of some (partition folder, commit, place) with their place in ``SEQ``."""
        root = f"{self.path}/rows"
        of: dict[str, list[str]] = {}
        for part, commit, _ in folders:
            of.setdefault(commit, []).append(part)
        paths = []
        for commit, parts in of.items():
            own = f"{root}/{COMMIT}={commit}"
            paths += [own] if len(parts) == sizes[commit] else [f"{own}/{p}" for p in parts]
        schema = T.StructType([*self.schema.fields, T.StructField(COMMIT, T.StringType())])
        df = self.spark.read.schema(schema).option("basePath", root).parquet(*paths)
        places = sorted({(commit, seq) for _, commit, seq in folders})
        seq = F.create_map(*[F.lit(v) for pair in places for v in pair])[F.col(COMMIT)]
        return df.select(*[F.col(f"`{n}`") for n in self.schema.fieldNames()], seq.cast("long").alias(SEQ))

    def _folders(self, now: Manifest) -> dict[str, list[tuple[str, str, int]]]:
        """Partition folder to the (commit, kind, place) that hold rows of it."""
        held = {part: [(commit, BASE, 0)] for part, commit in now.base.items()}
        for d in now.deltas:
            for part in d.partitions:
                held.setdefault(part, []).append((d.commit, d.kind, d.version))
        return held

    def _merged(self, now: Manifest, merge: Merge, held: dict[str, list[tuple[str, str, int]]]) -> DataFrame:
        kinds: dict[str, list[tuple[str, str, int]]] = {}
        for part, entries in held.items():
            for commit, kind, seq in entries:
                kinds.setdefault(kind, []).append((part, commit, seq))
        parts = {kind: self._scan(folders, now.sizes) for kind, folders in kinds.items()}
        return merge(parts).select(*[F.col(f"`{n}`") for n in self.schema.fieldNames()])

    def read(self, merge: Merge, version: int | None = None) -> DataFrame:
        """All rows of one version; ``merge`` gets the rows by kind (the base is one) with their ``SEQ``."""
        now = self.manifest(version)
        held = self._folders(now)
        alone = {p: e for p, e in held.items() if len(e) == 1 and e[0][1] in self.whole}
        rest = {p: e for p, e in held.items() if p not in alone}
        parts = []
        if alone:
            parts.append(self._scan([(p, e[0][0], e[0][2]) for p, e in alone.items()], now.sizes).drop(SEQ))
        if rest:
            parts.append(self._merged(now, merge, rest))
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], self.schema)

    # ---- upkeep -----------------------------------------------------------

    def compact(self, merge: Merge) -> bool:
        """Fold all deltas into the partitions they touch; others keep their files.

        Deltas that arrive meanwhile stay deltas. False when there was nothing to fold, or
        another compaction was first.
        """
        now = self.manifest()
        touched = {p for d in now.deltas for p in d.partitions}
        if not touched:
            return False
        held = {p: e for p, e in self._folders(now).items() if p in touched}
        commit, partitions = self._write(self._merged(now, merge, held))
        done = {d.commit for d in now.deltas}

        def change(then: Manifest) -> Manifest | None:
            if any(then.base.get(p) != now.base.get(p) for p in touched) or not done <= {d.commit for d in then.deltas}:
                return None
            base = {**{p: c for p, c in then.base.items() if p not in touched}, **dict.fromkeys(partitions, commit)}
            return replace(then, base=base, deltas=tuple(d for d in then.deltas if d.commit not in done), sizes={**then.sizes, commit: len(partitions)})

        return self._publish(change) is not None

    def expire(self, keep: int = 10, before: int | None = None) -> int:
        """Delete all versions but the newest ``keep``, and row folders only they name.

        Folders modified at ``before`` (milliseconds since 1970) or later stay, as a write in
        progress may have made them; the default is a day ago. Returns the number of folders deleted.
        """
        versions = sorted(self.versions())
        named = set().union(*(self.manifest(v).commits for v in versions[-keep:])) if versions else set()
        for v in versions[:-keep]:
            delete(self.spark, self._manifest_path(v))
        loose = [d for d in child_dirs(self.spark, f"{self.path}/rows", before=before) if d.removeprefix(f"{COMMIT}=") not in named]
        for d in loose:
            delete(self.spark, f"{self.path}/rows/{d}")
        return len(loose)
