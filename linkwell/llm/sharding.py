"""Shards of a table: arrivals are appended as small immutable files and compacted by size tiers.

A store is a folder with ``shards/`` and ``manifests/``.  A manifest states which shards one version adds to its
base and removes from it (each sixteenth lists all) and is committed by renaming a finished file to its version's name,
which fails if another writer took that version first; readers see the old list or the new one, never a part.  The file
system's rename must be atomic and must not overwrite.  A writer that loses the race applies its change to the
version that won.  Compaction merges shards of a similar size (one tier: sizes within a factor ``fanout``) into files of
about ``target_bytes``, tiers at the same time, and commits the result as one version.  Shards that recent
manifests don't list stay until ``vacuum``.

Rows are copied as they are: nulls, empty and very long texts, ties and repeated rows stay; columns beside those of the
schema are left out, whatever their names.

Rows move through DataFrame readers and writers only.  Merging reads a tier's files and coalesces
them, so it needs no shuffle.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Each so many versions the manifest lists all shards.
WHOLE_EVERY = 16


@dataclass(frozen=True)
class Shard:
    path: str
    bytes: int


class ShardStore:
    def __init__(self, spark: SparkSession, root: str, schema: StructType, target_bytes: int = 128 << 20, fanout: int = 4, smallest: int = 1 << 20):
        """``smallest``: all shards below this size are of tier 0."""
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema
        self.target_bytes, self.fanout, self.smallest = target_bytes, fanout, smallest
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(conf)
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.root).toUri(), conf)
        self._keep = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        self._keep[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        for d in ("shards", "manifests"):
            self._fs.mkdirs(self._path(f"{self.root}/{d}"))

    # manifests

    def version(self) -> int:
        """The newest committed version; 0 before the first."""
        names = [x.getPath().getName() for x in self._fs.listStatus(self._path(f"{self.root}/manifests"))]
        return max((int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json")), default=0)

    def _manifest(self, version: int) -> dict:
        stream = self._fs.open(self._path(f"{self.root}/manifests/v{version:08d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def shards(self, version: int | None = None) -> list[Shard]:
        version, changes = self.version() if version is None else version, []
        while version:
            changes.append(found := self._manifest(version))
            version = 0 if found["whole"] else found["base"]
        listed: dict[str, Shard] = {}
        for c in reversed(changes):
            for path in c["remove"]:
                del listed[path]
            listed |= {x["path"]: Shard(**x) for x in c["add"]}
        return list(listed.values())

    def commit(self, add: list[Shard], remove: list[Shard], base: int) -> int:
        """Make the change version ``base`` + 1, or raise FileExistsError if that version exists already."""
        version = base + 1
        gone, whole = {s.path for s in remove}, version % WHOLE_EVERY == 0
        if whole:
            add = [s for s in self.shards(base) if s.path not in gone] + add
        text = json.dumps({"version": version, "base": base, "whole": whole, "add": [vars(s) for s in add], "remove": [] if whole else sorted(gone)})
        draft, name = self._path(f"{self.root}/manifests/.draft-{uuid.uuid4().hex}"), self._path(f"{self.root}/manifests/v{version:08d}.json")
        out = self._fs.create(draft, False)
        out.write(bytearray(text.encode()))
        out.close()
        try:
            self._context.rename(draft, name, self._keep)
        except Exception as e:
            self._fs.delete(draft, False)
            if self._fs.exists(name):
                raise FileExistsError(str(name)) from e
            raise
        return version

    def _change(self, add: list[Shard], remove: list[Shard], base: int | None = None) -> int | None:
        """Commit a change to the newest version, however often another writer is faster; None if a shard to remove is gone."""
        while True:
            base = self.version() if base is None else base
            if remove and not {s.path for s in remove} <= {s.path for s in self.shards(base)}:
                return None
            try:
                return self.commit(add, remove, base)
            except FileExistsError:
                base = None

    # writing

    def _files(self, folder: str, before: float = math.inf) -> list[Shard]:
        """The folder's shards that were written before a time."""
        found, files = [], self._fs.listFiles(self._path(folder), True)
        while files.hasNext():
            f = files.next()
            if f.getPath().getName().endswith(".parquet") and f.getModificationTime() <= before * 1000:
                found.append(Shard(f.getPath().toString(), f.getLen()))
        return sorted(found, key=lambda s: s.path)

    def append(self, df: DataFrame, arrival: F.Column | None = None) -> int:
        """Write rows as new small shards, one commit for each arrival; the newest version.

        ``arrival``: an expression that numbers the arrivals which ``df`` holds.  All are written in
        one pass.  An empty frame commits nothing.
        """
        folder = f"{self.root}/shards/{uuid.uuid4().hex}"
        name = "_arrival" + uuid.uuid4().hex[:8]
        rows = df.select(*[df[c] for c in self.schema.names])
        if arrival is None:
            if rows.isEmpty():  # an empty frame would still leave a file
                return self.version()
            rows.write.option("compression", "zstd").parquet(folder)
            groups = [self._files(folder)]
        else:
            rows.withColumn(name, arrival).write.option("compression", "zstd").partitionBy(name).parquet(folder)
            by: dict[str, list[Shard]] = {}
            for s in self._files(folder):
                by.setdefault(s.path.rsplit("/", 2)[1], []).append(s)
            groups = [by[k] for k in sorted(by, key=lambda k: (len(k), k))]
        version = None
        for new in filter(None, groups):
            version = self._change(new, [], version)
        return self.version() if version is None else version

    def tier(self, size: int) -> int:
        return max(0, math.floor(math.log(max(size, 1) / self.smallest, self.fanout)) + 1) if size >= self.smallest else 0

    def plan(self, shards: list[Shard]) -> list[list[Shard]]:
        """The tiers to merge: those with at least ``fanout`` shards that are well below the target."""
        tiers: dict[int, list[Shard]] = {}
        for s in shards:
            if s.bytes < self.target_bytes * 3 // 4:
                tiers.setdefault(self.tier(s.bytes), []).append(s)
        return [t for _, t in sorted(tiers.items()) if len(t) >= self.fanout]

    def _merge(self, run: list[Shard]) -> list[Shard]:
        files = max(1, min(len(run) // self.fanout, math.ceil(sum(s.bytes for s in run) / self.target_bytes)))
        folder = f"{self.root}/shards/{uuid.uuid4().hex}"
        self._frame(run).coalesce(files).write.option("compression", "zstd").parquet(folder)
        return self._files(folder)

    def compact(self) -> int:
        """Merge tiers until none has ``fanout`` shards; the newest version.

        Each merge of a tier makes at most a ``fanout``-th of its files, so the loop ends.  If another writer
        has removed a shard that was merged, the merged files go and the tiers are planned anew.
        """
        while runs := self.plan(self.shards()):
            with ThreadPoolExecutor(len(runs)) as pool:
                merged = [x for part in pool.map(inheritable_thread_target(self.spark)(self._merge), runs) for x in part]
            if self._change(merged, [s for run in runs for s in run]) is None:
                self._delete(merged)
        return self.version()

    def _delete(self, shards: list[Shard]) -> None:
        for s in shards:
            self._fs.delete(self._path(s.path), False)

    def vacuum(self, keep: int = 8, least_age: float = 86_400) -> int:
        """Delete shards that none of the newest ``keep`` versions lists and that are ``least_age`` seconds old; their number.

        The age protects files that another writer has written but not committed, and readers of older versions: it
        must be longer than any write or read takes.  0 is for a store that nobody else uses.
        """
        newest = self.version()
        listed = {s.path for v in range(max(1, newest - keep + 1), newest + 1) for s in self.shards(v)}
        before = time.time() - least_age
        old = [s for s in self._files(f"{self.root}/shards", before) if s.path not in listed]
        self._delete(old)
        return len(old)

    # reading

    def _frame(self, shards: list[Shard]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*[s.path for s in shards])

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version, the newest by default; rows that repeat stay repeated."""
        shards = self.shards(version)
        return self._frame(shards) if shards else self.spark.createDataFrame([], self.schema)
