"""Size-tiered compaction of immutable shards under a versioned manifest.

Arrivals are appended as small Parquet shards.  Shards of one size tier are
merged, in order, into files of the target size; a merge reads its own shards
only and writes one file, so nothing is shuffled.  A manifest lists the live
shards; a new version becomes visible by one rename that fails if the version
exists, so readers see all of a change or nothing, and a lost race or a dead
driver leaves only files that no manifest names.  The rename is atomic where the
file system's is (HDFS, local disks); on a plain object store the folder needs a
single writer.
"""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from .workspace import delete

TARGET_BYTES = 128 << 20
ARRIVAL_ROWS = 10_000
FAN_IN = 4


@dataclass(frozen=True)
class Shard:
    """A file of the store: path below the root, bytes, and merges behind it."""

    path: str
    size: int
    merges: int = 0


class CommitConflict(RuntimeError):
    """Another writer committed this version first."""


class ShardStore:
    """Shards below ``root``; every method works through the file system that the path belongs to."""

    def __init__(self, spark: SparkSession, root: str, target: int = TARGET_BYTES, fan_in: int = FAN_IN):
        self.spark, self.root, self.target, self.fan_in = spark, root.rstrip("/"), target, fan_in
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _list(self, name: str) -> list[tuple[str, int]]:
        path = self._path(name)
        fs = path.getFileSystem(self._conf)
        if not fs.exists(path):
            return []
        return sorted((f.getPath().getName(), f.getLen()) for f in fs.listStatus(path))

    def version(self) -> int:
        """The newest committed version, 0 if there is none."""
        return max((int(n[1:-5]) for n, _ in self._list("manifest") if n.startswith("v") and n.endswith(".json")), default=0)

    def shards(self, version: int | None = None) -> list[Shard]:
        """The live shards of a version."""
        version = self.version() if version is None else version
        if not version:
            return []
        path = self._path(f"manifest/v{version:09d}.json")
        stream = path.getFileSystem(self._conf).open(path)
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return [Shard(**x) for x in json.loads(text)["shards"]]

    def commit(self, base: int, shards: list[Shard]) -> int:
        """Make ``shards`` version base + 1; raises CommitConflict if that version is there."""
        name = f"manifest/v{base + 1:09d}.json"
        draft, final = self._path(f"manifest/.draft-{self._jvm.java.util.UUID.randomUUID()}"), self._path(name)
        out = draft.getFileSystem(self._conf).create(draft, False)
        out.write(bytearray(json.dumps({"version": base + 1, "shards": [asdict(s) for s in shards]}).encode()))
        out.close()
        files = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self._conf)
        plain = self.spark.sparkContext._gateway.new_array(getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            files.rename(draft, final, plain)
        except Exception as e:
            draft.getFileSystem(self._conf).delete(draft, False)
            if "FileAlreadyExists" in str(e):
                raise CommitConflict(name) from e
            raise
        return base + 1

    def _written(self, folder: str, merges: int) -> list[Shard]:
        return [Shard(f"{folder}/{n}", size, merges) for n, size in self._list(folder) if n.endswith(".parquet")]

    @staticmethod
    def _write(df: DataFrame, path: str) -> None:
        df.write.option("compression", "zstd").option("parquet.block.size", str(16 << 20)).parquet(path)

    def append(self, df: DataFrame, rows: int = ARRIVAL_ROWS) -> int:
        """Write ``df`` as shards of at most ``rows`` rows and commit them.

        Defined cases: nulls, empty and very long texts, repeated rows and
        further columns are kept as they are; an empty table commits its one
        empty shard; a lost race raises CommitConflict and leaves the store as it was.
        """
        base = self.version()
        folder = f"data/a{base + 1:09d}-{self._jvm.java.util.UUID.randomUUID()}"
        df.write.option("compression", "zstd").option("maxRecordsPerFile", str(rows)).option("parquet.block.size", str(16 << 20)).parquet(f"{self.root}/{folder}")
        return self.commit(base, self.shards(base) + self._written(folder, 0))

    def merges_due(self, shards: list[Shard]) -> list[list[Shard]]:
        """Runs of similarly sized shards to merge, each into about one target-sized file.

        A tier holds sizes within a factor of ``fan_in``; its shards are dealt
        in order into runs of at most the target size.  A run is due if it has
        ``fan_in`` shards or fills at least half a target.
        """
        tiers: dict[int, list[Shard]] = {}
        for s in sorted(shards, key=lambda s: s.path):
            if s.size < self.target // 2:
                tier = 0
                while s.size * self.fan_in ** (tier + 1) < self.target:
                    tier += 1
                tiers.setdefault(tier, []).append(s)
        due = []
        for tier in sorted(tiers, reverse=True):
            run: list[Shard] = []
            for s in [*tiers[tier], None]:
                if run and (s is None or sum(x.size for x in run) + s.size > self.target):
                    if len(run) >= self.fan_in or (len(run) > 1 and 2 * sum(x.size for x in run) >= self.target):
                        due.append(run)
                    run = []
                if s is not None:
                    run.append(s)
        return due

    def compact(self, at_once: int = 8) -> int:
        """Merge until no run is due; retired shards stay for readers of older versions until ``vacuum``.

        Defined cases: rows stay as they are, in the order of their shards; an
        empty shard is merged as the smallest tier; a store without a run that is
        due keeps its version.
        """
        while due := self.merges_due(shards := self.shards(base := self.version())):
            folder = f"data/m{base + 1:09d}-{self._jvm.java.util.UUID.randomUUID()}"

            def merge(job: tuple[int, list[Shard]], folder: str = folder) -> list[Shard]:
                k, run = job
                source = self.spark.read.parquet(*[f"{self.root}/{s.path}" for s in run])
                self._write(source.coalesce(1), f"{self.root}/{folder}/{k:06d}")
                return self._written(f"{folder}/{k:06d}", 1 + max(s.merges for s in run))

            with ThreadPoolExecutor(at_once) as pool:
                merged = [s for new in pool.map(merge, enumerate(due)) for s in new]
            gone = {s.path for run in due for s in run}
            self.commit(base, [s for s in shards if s.path not in gone] + merged)
        return self.version()

    def vacuum(self, older_than: int | None = None, at_once: int = 8) -> list[int]:
        """Delete versions below ``older_than`` (the newest unless given) and the shards that only they name; returns them.

        Readers of those versions must have ended.
        """
        newest = self.version()
        keep_from = newest if older_than is None else min(older_than, newest)
        versions = sorted(int(n[1:-5]) for n, _ in self._list("manifest") if n.startswith("v") and n.endswith(".json"))
        live = {s.path for v in versions if v >= keep_from for s in self.shards(v)}
        old = [v for v in versions if v < keep_from]
        gone = {s.path for v in old for s in self.shards(v)} - live
        with ThreadPoolExecutor(at_once) as pool:
            list(pool.map(lambda path: delete(self.spark, f"{self.root}/{path}"), sorted(gone)))
        for v in old:
            delete(self.spark, f"{self.root}/manifest/v{v:09d}.json")
        return old

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version's shards."""
        return self.spark.read.parquet(*[f"{self.root}/{s.path}" for s in self.shards(version)])

    def listing(self, id_col: str) -> DataFrame:
        """(id_col, shard, shard_bytes, merges, version) for every live row."""
        version = self.version()
        shards = self.shards(version)
        names = self.spark.createDataFrame([(s.path, i, s.size, s.merges) for i, s in enumerate(shards)], "path string, shard int, shard_bytes long, merges int")
        rows = self.read(version).select(F.col(id_col), F.regexp_extract(F.col("_metadata.file_path"), r"(data/[am]\d{9}-.*)$", 1).alias("path"))
        return rows.join(names, "path").select(id_col, "shard", "shard_bytes", "merges", F.lit(version).alias("version"))


def shard(docs: DataFrame, root: str, target: int = TARGET_BYTES, arrival_rows: int = ARRIVAL_ROWS, fan_in: int = FAN_IN) -> ShardStore:
    """Append ``docs`` to the store below ``root`` and compact it.

    Every row is kept as it is: nulls, empty and very long texts, repeated rows
    and further columns included; rows aren't ordered, so ties don't arise.  An
    empty table gives a store with one empty shard.
    """
    store = ShardStore(docs.sparkSession, root, target, fan_in)
    store.append(docs, arrival_rows)
    store.compact()
    return store
