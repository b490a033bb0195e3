"""Structured Streaming counterparts: keep-best upserts and windowed counts."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.curation import keep_best
from ..sources import files

BUCKETS = 64


class BucketedTable:
    """A keyed table in buckets by key hash, whose versions are manifests that name a folder for each bucket.

    A batch reads and rewrites the buckets that its keys fall into and leaves
    the others' files in place.  A version becomes visible by one rename, so
    readers see all of a batch or nothing; a batch number that is there already
    changes nothing, so a repeated batch does no harm.  A manifest has an entry
    for each bucket, however many rows there are.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: str, buckets: int = BUCKETS):
        self.spark, self.path, self.schema, self.key, self.buckets = spark, path.rstrip("/"), schema, key, buckets

    def versions(self) -> list[int]:
        return [int(n[1:-5]) for n in files.names(self.spark, f"{self.path}/manifest") if n.startswith("v") and n.endswith(".json")]

    def manifest(self, version: int | None = None) -> dict:
        """{version, batch, buckets: folder by bucket} of a version, the last unless given; empty before the first."""
        known = self.versions()
        if not known:
            return {"version": -1, "batch": -1, "count": self.buckets, "buckets": {}}
        found = json.loads(files.read(self.spark, f"{self.path}/manifest/v{max(known) if version is None else version:09d}.json"))
        if found["count"] != self.buckets:
            raise ValueError(f"the table has {found['count']} buckets")
        return found

    def _read(self, folders: dict[str, str]) -> DataFrame:
        paths = [f"{self.path}/{folder}/_bucket={b}" for b, folder in sorted(folders.items())]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the last unless given."""
        return self._read(self.manifest(version)["buckets"])

    def merge(self, batch: DataFrame, number: int, best: Callable[[DataFrame], DataFrame]) -> dict:
        """Merge batch ``number`` by ``best``, which keeps a row of each key; returns the manifest that holds it.

        Rows of late batches compete as any others; a number up to the last
        merged one is taken for a repetition.  Raises files.Taken if another
        writer made the next version.
        """
        now = self.manifest()
        if number <= now["batch"]:
            return now
        placed = batch.select(*self.schema.names).withColumn("_bucket", F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int"))
        touched = [str(r[0]) for r in placed.select("_bucket").distinct().collect()]  # at most one for each bucket
        version, folder = now["version"] + 1, f"data/v{now['version'] + 1:09d}-{number}"
        if touched:
            old = self._read({b: f for b, f in now["buckets"].items() if b in set(touched)})
            merged = best(old.unionByName(batch.select(*self.schema.names)))
            merged = merged.withColumn("_bucket", F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int"))
            merged.repartition(min(len(touched), 4096), "_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.path}/{folder}")
        made = {"version": version, "batch": number, "count": self.buckets, "buckets": now["buckets"] | dict.fromkeys(touched, folder)}
        files.commit(self.spark, f"{self.path}/manifest/v{version:09d}.json", json.dumps(made, sort_keys=True))
        return made

    def expire(self, keep: int = 1) -> list[str]:
        """Forget all but the last ``keep`` versions and delete the folders that none of these names; returns what was deleted."""
        known = self.versions()
        kept, gone = known[-keep:], known[:-keep]
        used = {f for v in kept for f in self.manifest(v)["buckets"].values()}
        for v in gone:
            files.delete(self.spark, f"{self.path}/manifest/v{v:09d}.json")
        last = max(kept, default=-1)
        unused = [n for n in files.names(self.spark, f"{self.path}/data") if f"data/{n}" not in used and int(n[1:].split("-")[0]) <= last]
        for n in unused:
            files.delete(self.spark, f"{self.path}/data/{n}")
        return unused


def keep_best_sink(path: str, key: str, score: str, position: str, buckets: int = BUCKETS, keep: int = 2) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that keeps the best row of each key in a BucketedTable at ``path`` and its last ``keep`` versions."""

    def upsert(batch: DataFrame, n: int) -> None:
        table = BucketedTable(batch.sparkSession, path, batch.schema, key, buckets)
        table.merge(batch, n, lambda rows: keep_best(rows, [key], score, position))
        table.expire(keep)

    return upsert


def windowed_counts(events: DataFrame, ts: str, label: str, width: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """(start, end, label, n, total) in tumbling or sliding windows under a watermark; works on streams and tables."""
    timed = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    window = F.window("_ts", width, slide) if slide else F.window("_ts", width)
    return timed.groupBy(window.alias("w"), label).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("w.start", "w.end", label, "n", "total")


def sessions(events: DataFrame, ts: str, user: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(user, start, end, n) sessions that end after a gap; works on streams and tables."""
    timed = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    return timed.groupBy(F.session_window("_ts", gap).alias("w"), user).agg(F.count("*").alias("n")).select(user, "w.start", "w.end", "n")


def first_seen(events: DataFrame, key: str, value: str) -> DataFrame:
    """(key, n, best): a running count and maximum of each key, as custom state."""
    kind = events.schema[key].dataType.simpleString()

    def update(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, best = state.get if state.exists else (0, float("-inf"))
        for part in parts:
            n, best = n + len(part), max(best, float(part[value].max()))
        state.update((n, best))
        yield pd.DataFrame({key: [k[0]], "n": [n], "best": [best]})

    return events.groupBy(key).applyInPandasWithState(update, f"{key} {kind}, n long, best double", "n long, best double", "update", GroupStateTimeout.NoTimeout)
