"""Writers: CSV, JSON lines, Markdown tables, plot data and resumable appends."""

from __future__ import annotations

import hashlib
import json
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

from .tables import exists


def write_csv(df: DataFrame, path: str, columns: list[str], files: int | None = 1) -> None:
    """CSV with a header in the declared column order, values with their outer white space; an undeclared or missing column is an error."""
    if set(df.columns) != set(columns):
        raise ValueError(f"columns differ: {sorted(set(df.columns) ^ set(columns))}")
    out = df.select(*columns)
    keep = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    (out.coalesce(files) if files else out).write.mode("overwrite").options(header=True, escape='"', **keep).csv(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """JSON lines with top-level keys in alphabetical order."""
    df.select(*sorted(df.columns)).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def markdown(df: DataFrame, columns: list[str], limit: int = 1000) -> str:
    """A Markdown table of a small result."""
    rows = df.select(*columns).limit(limit).collect()
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    lines = ["| " + " | ".join(columns) + " |", "| " + " | ".join("---" for _ in columns) + " |"]
    return "\n".join(lines + ["| " + " | ".join(cell(v) for v in r) + " |" for r in rows])


def plot_lines(df: DataFrame, *columns: str) -> DataFrame:
    """(value): space-joined columns, ready for ``write.text``."""
    return df.select(F.concat_ws(" ", *[F.replace(F.col(c).cast("string"), F.lit(" "), F.lit("_")) for c in columns]).alias("value"))


def append_new(df: DataFrame, path: str, key: str) -> DataFrame:
    """Append rows whose key the Parquet table at ``path`` lacks; returns the table."""
    spark: SparkSession = df.sparkSession
    if exists(spark, path):
        df = df.join(spark.read.parquet(path).select(key).distinct(), key, "left_anti")
    df.write.mode("append").parquet(path)
    return spark.read.parquet(path)


def blind_and_review(df: DataFrame, hidden: list[str]) -> tuple[DataFrame, DataFrame]:
    """(blind, review): the same rows without and with the hidden columns."""
    return df.drop(*hidden), df


def bundle(root: str, files: list[str], target: str) -> dict[str, str]:
    """Zip the listed files below a local ``root`` with a MANIFEST.json of their digests; missing ones are an error."""
    digests = {f: hashlib.sha256((Path(root) / f).read_bytes()).hexdigest() for f in sorted(files)}
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
        for f in digests:
            out.write(Path(root) / f, f)
        out.writestr("MANIFEST.json", json.dumps(digests, indent=1, sort_keys=True))
    return digests
