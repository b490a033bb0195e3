"""Intermediate tables in the shared folder that the session names in ``spark.checkpoint.dir``.

Executors can be lost at any time, so anything that is read more than once or
that ends an iteration is written there as Parquet and read again: that cuts
the lineage and leaves nothing on one machine only.
"""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid
import weakref
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[weakref.ref, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; one of our own only in a single local process without one, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="reportmill-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def bound_batches(spark: SparkSession, rows: int = 500, size: int = 4 << 20) -> None:
    """Hold what one Arrow batch brings to a Python worker to ``rows`` rows and about ``size`` bytes.

    Rows here carry whole texts or sets, so the default of 10,000 rows is too
    many.  A smaller setting of the session stands.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = re.fullmatch(r"(\d+)([bkm]?)b?", str(spark.conf.get(key)).lower())
        if not now or not 0 < int(now[1]) * {"k": 1 << 10, "m": 1 << 20}.get(now[2], 1) <= most:
            spark.conf.set(key, str(most))


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses; it is removed when the driver ends."""
    path = f"{shared_folder(spark)}/reportmill/{uuid.uuid4().hex}/{name}"
    _written.append((weakref.ref(spark), path.rsplit("/", 1)[0]))
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the table that reads it back."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table that ``materialize`` returned, once nothing reads it any more."""
    delete(df.sparkSession, df._written_to.rsplit("/", 1)[0])


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete every table that is written inside, when it ends; what outlives it must have its path from before."""
    mark = len(_written)
    try:
        yield
    finally:
        for _, path in _written[mark:]:
            delete(spark, path)
        del _written[mark:]


def delete(spark: SparkSession, path: str) -> None:
    """Delete a path by the file system it belongs to, whichever that is."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def sweep() -> None:
    """Remove every intermediate table of sessions that are still open."""
    while _written:
        session, path = _written.pop()
        spark = session()
        try:
            if spark is not None and spark.sparkContext._jsc is not None:
                delete(spark, path)
        except Exception:  # noqa: BLE001  the session may be going down already
            return


atexit.register(sweep)
