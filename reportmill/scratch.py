"""Tables that a query writes and reads back, in the folder that ``spark.checkpoint.dir`` names."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Rows of a narrow table that may be broadcast.
BROADCAST_ROWS = 50_000
_written: list[tuple[weakref.ref, str]] = []


def new_folder(spark: SparkSession) -> str:
    """A folder that nothing else uses and that is removed when the driver ends.

    A folder of our own is taken only in one local process without the setting.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="reportmill-")
        spark.sparkContext.setCheckpointDir(root)
    path = f"{root.rstrip('/')}/reportmill/{uuid.uuid4().hex}"
    _written.append((weakref.ref(spark), path))
    return path


def written(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write ``df`` and return the table that reads it back: read more than once it is computed once, and its lineage ends."""
    path = f"{new_folder(df.sparkSession)}/{name}"
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, a written narrow table, marked for broadcast if it has at most ``rows`` rows, else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def same_key(left: DataFrame, right: DataFrame, keys: list[str]) -> list:
    """Conditions under which the rows of two tables have equal keys, null being equal to null."""
    return [left[k].eqNullSafe(right[k]) for k in keys]


def _sweep() -> None:
    while _written:
        session, path = _written.pop()
        spark = session()
        try:
            if spark is not None and spark.sparkContext._jsc is not None:
                target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
                target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # noqa: BLE001  the session may be going down already
            return


atexit.register(_sweep)
