"""Readers: CSV, JSON lines, JSON arrays, context files, diffs and recorded searches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window, functions as F, types as T

from ..functions.text import changed_files
from . import files


def csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """CSV with a header and quoted line breaks; a byte order mark before the first name is dropped.

    Without a schema every column is a string.
    """
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    df = (reader.schema(schema) if schema is not None else reader).csv(path)
    first = df.columns[0] if df.columns else ""
    return df.withColumnRenamed(first, first.lstrip("\ufeff")) if first.startswith("\ufeff") else df


def exists(spark: SparkSession, path: str) -> bool:
    """Whether the path exists in its own file system."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def optional_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """CSV, or an empty table of the schema if the file is missing."""
    return csv(spark, path, schema) if exists(spark, path) else spark.createDataFrame([], schema)


def json_arrays(spark: SparkSession, paths: list[str], schema: T.StructType | str) -> DataFrame:
    """Rows of JSON array files, with ``source_file`` and ``position`` (root, file name, place in the file)."""
    out = None
    for i, p in enumerate(paths):
        files = spark.read.text(p, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("source_file"), "value")
        kind = schema if isinstance(schema, str) else schema.simpleString()
        rows = files.select("source_file", F.posexplode(F.from_json("value", f"array<{kind if kind.startswith('struct') else f'struct<{kind}>'}>")).alias("at", "row"))
        rows = rows.select("row.*", "source_file", F.struct(F.lit(i).alias("root"), F.col("source_file").alias("file"), "at").alias("position"))
        out = rows if out is None else out.unionByName(rows)
    return out


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank lines are skipped, malformed ones have their text in ``_corrupt``."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    return lines.select(F.from_json("value", f"{schema}, _corrupt string", options).alias("row")).select("row.*")


def corrupt_count(lines: DataFrame) -> int:
    """How many lines of ``json_lines`` were malformed, by a pass of its own."""
    return lines.where("_corrupt is not null").count()


def observed(df: DataFrame, **conditions: Column) -> tuple[DataFrame, Observation]:
    """(rows, counts): ``df``, and an observation of its ``rows`` and of how many meet each condition.

    The counts are made in the pass that first reads the rows; ``counts.get``
    has them once an action on the rows is over.
    """
    seen = Observation()
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *[F.count_if(c).alias(n) for n, c in conditions.items()]), seen


def counted_json_lines(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, Observation]:
    """(well-formed rows, counts): ``json_lines`` without the malformed ones, which are counted as ``malformed`` in the same pass."""
    lines, seen = observed(json_lines(spark, path, schema), malformed=F.col("_corrupt").isNotNull())
    return lines.where("_corrupt is null").drop("_corrupt"), seen


def contexts(spark: SparkSession, folder: str, comments: int | None = None) -> DataFrame:
    """(stem, title, body, comments, comment_count) from <stem>.issue.json and <stem>.comments.json.

    A report without a comment file has no comments; personal fields are not read.
    """
    stem = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.(issue|comments)\.json$", 1)
    issues = spark.read.schema("title string, body string, state string, created_at string").option("multiLine", True).option("pathGlobFilter", "*.issue.json").json(folder)
    issues = issues.select(stem.alias("stem"), F.coalesce("title", F.lit("")).alias("title"), F.coalesce("body", F.lit("")).alias("body"), "state", "created_at")
    notes = spark.read.schema("body string, created_at string, id long").option("multiLine", True).option("pathGlobFilter", "*.comments.json").json(folder)
    notes = notes.select(stem.alias("stem"), F.coalesce("body", F.lit("")).alias("body"), "created_at", "id")
    if comments:
        notes = notes.withColumn("_r", F.row_number().over(Window.partitionBy("stem").orderBy("created_at", "id"))).where(F.col("_r") <= comments).drop("_r")
    joined = join_thread(notes.withColumnRenamed("body", "part"), "stem", ["created_at", "id"], "part")
    return issues.join(joined.select("stem", F.col("text").alias("comments"), F.col("parts").alias("comment_count")), "stem", "left").na.fill({"comments": "", "comment_count": 0})


def join_thread(rows: DataFrame, key: str, order: list[str], part: str, joint: str = "\n") -> DataFrame:
    """(key, text, parts): a thread's parts joined in order."""
    sorted_parts = F.array_sort(F.collect_list(F.struct(*order, part)))
    return rows.groupBy(key).agg(F.array_join(F.transform(sorted_parts, lambda s: s[part]), joint).alias("text"), F.count("*").alias("parts"))


def diffs(spark: SparkSession, path: str) -> DataFrame:
    """(file_name, changed_files, bytes) of diff files."""
    files = spark.read.text(path, wholetext=True)
    return files.select(F.col("_metadata.file_name").alias("file_name"), changed_files(F.col("value")).alias("changed_files"), F.octet_length("value").alias("bytes"))


def recorded_search(spark: SparkSession, folder: str, queries: list[str]) -> DataFrame:
    """(query, url, title, body, state): search results from recorded JSON lines, <folder>/<query>.jsonl.

    The recordings of all queries are one read, which Spark plans and splits;
    the query is taken from the path.  The folder may lie in any file system
    that Spark reads.  A query without a recording gives no rows; other queries
    are a parameter, not another source.
    """
    fields = "url string, title string, body string, state string"
    there = set(files.names(spark, folder))
    paths = [f"{folder}/{q}.jsonl" for q in dict.fromkeys(queries) if f"{q}.jsonl" in there]
    if not paths:
        return spark.createDataFrame([], f"query string, {fields}")
    of_file = F.url_decode(F.replace(F.regexp_extract(F.col("_metadata.file_path"), r"/([^/]+)\.jsonl(?:/[^/]*)?$", 1), F.lit("+"), F.lit("%2B")))
    lines = spark.read.text(paths).where(F.trim("value") != "").select(of_file.alias("query"), "value")
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    rows = lines.select("query", F.from_json("value", f"{fields}, _corrupt string", options).alias("row"))
    return rows.where("row._corrupt is null").select("query", "row.url", "row.title", "row.body", "row.state")
