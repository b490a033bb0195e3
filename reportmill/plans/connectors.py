"""Registered queries of sources, sinks and clients: tables are written and read back, clients are stubs."""

from __future__ import annotations

import json
import re

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import scorers, taxonomy
from ..scratch import new_folder, written
from ..sources import search, sinks, tables
from .catalogue import query, table

# Tables that are written and read back.


@query("OP-01 OP-14", "SELECT doc_id, source, lang, text FROM documents")
def csv_round_trip(spark, sf):
    path = new_folder(spark)
    sinks.write_csv(table(spark, sf, "documents").select("text", "lang", "source", "doc_id"), path, ["doc_id", "source", "lang", "text"], files=None)
    return tables.csv(spark, path, "doc_id long, source string, lang string, text string")


@query("OP-02", "SELECT n_nationkey::VARCHAR AS n_nationkey, n_name FROM nation")
def csv_byte_order_mark(spark, sf):
    path = new_folder(spark)
    lines = table(spark, sf, "nation").select(F.lit(1).alias("at"), F.concat_ws(",", "n_nationkey", "n_name").alias("value"))
    lines = spark.createDataFrame([(0, "﻿n_nationkey,n_name")], lines.schema).union(lines)
    lines.coalesce(1).sortWithinPartitions("at").select("value").write.text(path)
    return tables.csv(spark, path)


@query("OP-03", "SELECT s_suppkey, s_name FROM supplier")
def csv_optional(spark, sf):
    path, schema = new_folder(spark), "s_suppkey long, s_name string"
    sinks.write_csv(table(spark, sf, "supplier").select("s_suppkey", "s_name"), path, ["s_suppkey", "s_name"], files=None)
    return tables.optional_csv(spark, path, schema).union(tables.optional_csv(spark, f"{path}-missing", schema))


@query("OP-04", "SELECT CASE WHEN n_regionkey < 3 THEN 0 ELSE 1 END AS root, n_regionkey, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) - 1 AS place FROM nation")
def json_array_roots(spark, sf):
    """Nations as one array file a region, in two roots; an empty file is an empty array."""
    path = new_folder(spark)
    nations = table(spark, sf, "nation").select("n_regionkey", F.struct("n_name", "n_regionkey").alias("row"))
    arrays = nations.groupBy("n_regionkey").agg(F.to_json(F.array_sort(F.collect_list("row"))).alias("value"))
    arrays = arrays.union(spark.createDataFrame([(3, "[]")], arrays.schema)).repartition(8, "value")
    arrays.withColumn("root", F.when(F.col("n_regionkey") < 3, 0).otherwise(1)).drop("n_regionkey").write.option("maxRecordsPerFile", 1).partitionBy("root").text(path)
    rows = tables.json_arrays(spark, [f"{path}/root=0", f"{path}/root=1"], "n_name string, n_regionkey int")
    return rows.select("position.root", "n_regionkey", "n_name", F.col("position.at").alias("place"))


@query("OP-05 OP-15", "SELECT doc_id, lang, source, text FROM documents")
def jsonl_round_trip(spark, sf):
    path = new_folder(spark)
    sinks.write_jsonl(table(spark, sf, "documents").select("text", "doc_id", "source", "lang"), path)
    return tables.json_lines(spark, path, "doc_id long, lang string, source string, text string").drop("_corrupt")


@query("OP-06", "SELECT count(*) FILTER (WHERE event_type <> 'error') AS read, count(*) FILTER (WHERE event_type = 'error') AS malformed FROM events")
def jsonl_malformed(spark, sf):
    """Error events lose their last brace on the way; blank lines lie between."""
    path = new_folder(spark)
    line = F.to_json(F.struct("event_id", "event_type"))
    broken = F.when(F.col("event_type") == "error", F.substring_index(line, "}", 1)).otherwise(line)
    table(spark, sf, "events").select(F.concat(broken, F.lit("\n")).alias("value")).write.text(path)
    rows = tables.json_lines(spark, path, "event_id long, event_type string")
    return rows.agg(F.count_if(F.col("_corrupt").isNull()).alias("read"), F.count_if(F.col("_corrupt").isNotNull()).alias("malformed"))


@query("OP-09", "SELECT string_agg('nation/' || n_name, '|' ORDER BY n_name) AS changed FROM nation GROUP BY n_regionkey")
def diff_files(spark, sf):
    path = new_folder(spark)
    name = F.concat(F.lit("nation/"), "n_name")
    hunk = F.concat(F.lit("diff --git a/"), name, F.lit(" b/"), name, F.lit("\n+1"))
    nations = table(spark, sf, "nation").select("n_regionkey", hunk.alias("value"))
    nations.union(nations).repartition("n_regionkey").write.partitionBy("n_regionkey").text(path)
    return tables.diffs(spark, path).select(F.array_join("changed_files", "|").alias("changed"))


@query("OP-10 OP-13", "SELECT c_mktsegment AS query, 'https://example.org/' || c_custkey AS url, c_name AS title, NULL::VARCHAR AS body, 'open' AS state FROM customer")
def recorded_search(spark, sf):
    """A recording for each segment; the search runs for all of them and for a term without a recording."""
    folder, segments = new_folder(spark), ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    rows = table(spark, sf, "customer").select("c_mktsegment", F.concat(F.lit("https://example.org/"), "c_custkey").alias("url"), F.col("c_name").alias("title"), F.lit("open").alias("state"))
    for s in segments:
        sinks.write_jsonl(rows.where(F.col("c_mktsegment") == s).drop("c_mktsegment"), f"{folder}/{s}.jsonl")
    return tables.recorded_search(spark, folder, [*segments, "NOTHING"])


@query("OP-10 OP-13", "SELECT c_mktsegment AS query, 'https://example.org/' || c_custkey AS url, c_name AS title, NULL::VARCHAR AS body, 'open' AS state FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def search_source(spark, sf):
    """Recordings read as a data source; two of its terms are asked for, which the source is told."""
    folder, segments = new_folder(spark), ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    rows = table(spark, sf, "customer").select("c_mktsegment", F.concat(F.lit("https://example.org/"), "c_custkey").alias("url"), F.col("c_name").alias("title"), F.lit("open").alias("state"))
    for s in segments:
        sinks.write_jsonl(rows.where(F.col("c_mktsegment") == s).drop("c_mktsegment"), f"{folder}/{s}.jsonl")
    search.register(spark, search.Recordings(folder))
    return spark.read.format(search.FORMAT).option("terms", json.dumps([*segments, "NOTHING"])).load().where(F.col("query").isin("BUILDING", "MACHINERY"))


@query("OP-06 OP-34", "SELECT count(*) AS rows, count(*) FILTER (WHERE event_type = 'error') AS malformed, count(*) FILTER (WHERE event_type NOT IN ('error', 'click', 'view')) AS unknown, count(*) FILTER (WHERE event_type <> 'error') AS kept FROM events")
def counts_beside_rows(spark, sf):
    """Malformed lines and unknown types are counted in the pass that writes the well-formed rows."""
    path = new_folder(spark)
    line = F.to_json(F.struct("event_id", "event_type"))
    broken = F.when(F.col("event_type") == "error", F.substring_index(line, "}", 1)).otherwise(line)
    table(spark, sf, "events").select(broken.alias("value")).write.text(path)
    lines, read = tables.counted_json_lines(spark, path, "event_id long, event_type string")
    rows, seen = taxonomy.checked(lines, "event_type", ["click", "view"])
    kept = written(rows, "rows").count()
    return spark.createDataFrame([(read.get["rows"], read.get["malformed"], seen.get["invalid"], kept)], "rows long, malformed long, unknown long, kept long")


@query("OP-16", "SELECT '| r_regionkey | r_name |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || r_regionkey || ' | ' || r_name || ' |', chr(10) ORDER BY r_regionkey) AS report FROM region")
def markdown_report(spark, sf):
    return spark.createDataFrame([(sinks.markdown(table(spark, sf, "region").orderBy("r_regionkey"), ["r_regionkey", "r_name"]),)], "report string")


# Clients.


def _origin(url: str, most: int) -> str:
    """A server that refuses fragments and answers with the url twice."""
    if "#" in url:
        raise ConnectionError("refused")
    return (url * 2)[:most]


_FETCHED = """SELECT page_id, s AS status, CASE s WHEN 'cached' THEN 'kept' WHEN 'fetched' THEN url || url ELSE '' END AS body, CASE s WHEN 'failed' THEN 'ConnectionError: refused' ELSE '' END AS error
FROM (SELECT *, CASE WHEN contains(url, '?') THEN 'cached' WHEN contains(url, '#') THEN 'failed' WHEN 2 * strlen(url) > 70 THEN 'skipped_large' ELSE 'fetched' END AS s FROM pages)"""


@query("OP-11 OP-12", _FETCHED)
def capped_fetch(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "url")
    cached = pages.where(F.col("url").contains("?")).select("page_id", F.lit("kept").alias("body"))
    return scorers.fetch(pages, "page_id", "url", _origin, largest=70, cached=cached)


@query("OP-11 OP-12 OP-18", _FETCHED.replace("WHEN contains(url, '?') THEN 'cached' ", "").replace("WHEN 'cached' THEN 'kept' ", ""))
def resumed_fetch(spark, sf):
    """A first run over half of the pages, then one over all, which takes up its log."""
    pages, log = table(spark, sf, "pages").select("page_id", "url"), f"{new_folder(spark)}/log"
    scorers.logged_fetch(pages.where("page_id % 2 = 0"), "page_id", "url", _origin, log, largest=70)
    return scorers.logged_fetch(pages, "page_id", "url", _origin, log, largest=70).drop("host")


def _judge(prompt: str) -> str:
    """A model that fails on line breaks, fences its answer to short prompts and chats about long ones."""
    if "\n" in prompt:
        raise RuntimeError("retry in 0s")
    return '```json\n{"primary_failure_label": "short"}\n```' if len(prompt) < 400 else "It is long."


_JUDGED = """SELECT doc_id, CASE k WHEN 0 THEN 'needs_review' WHEN 1 THEN 'short' ELSE 'long' END AS label, CASE k WHEN 0 THEN 'RuntimeError: retry in 0s' ELSE '' END AS error,
CASE k WHEN 0 THEN '' WHEN 1 THEN '```json' || chr(10) || '{"primary_failure_label": "short"}' || chr(10) || '```' ELSE 'It is long.' END AS raw_response
FROM (SELECT doc_id, CASE WHEN contains(text, chr(10)) THEN 0 WHEN coalesce(length(text), 0) < 400 THEN 1 ELSE 2 END AS k FROM documents)"""


@query("OP-97 OP-154 OP-155", _JUDGED)
def model_per_row(spark, sf):
    return scorers.score_rows(table(spark, sf, "documents"), "doc_id", "text", _judge, ["short", "long"], retries=1).drop("elapsed_seconds")


def _batch_judge(prompt: str) -> str:
    """Answers a batch with a JSON list that leaves out Spanish rows."""
    found = re.findall(r"^\[(\d+)\] (\w+)$", prompt, re.M)
    return "Here: " + json.dumps([{"blind_id": k, "primary_failure_label": v} for k, v in found if v != "es"])


@query("OP-156", "SELECT doc_id, CASE WHEN lang IN ('de', 'en') THEN lang ELSE 'needs_review' END AS label FROM documents")
def model_per_batch(spark, sf):
    docs = table(spark, sf, "documents").withColumn("batch", F.floor(F.col("doc_id") / 20))
    return scorers.score_batches(docs, "doc_id", "lang", "batch", _batch_judge, ["de", "en"]).select("doc_id", "label")


@query("OP-153", "SELECT event_id, least(60.0, CASE WHEN event_type = 'error' THEN k + 0.5 ELSE 2.0 * 2 ** (k // 10) END)::DOUBLE AS delay FROM (SELECT event_id, event_type, (props::JSON ->> 'k')::BIGINT AS k FROM events)")
def retry_delays(spark, sf):
    """Error events name their delay, the others wait twice as long for each attempt."""
    k = F.get_json_object("props", "$.k").cast("long")
    message = F.when(F.col("event_type") == "error", F.concat(F.lit('{"retryDelay": "'), k, F.lit('.5s"}'))).otherwise("HTTP 500")
    events = table(spark, sf, "events").select("event_id", message.alias("message"), F.floor(k / 10).alias("attempt"))
    return events.select("event_id", scorers.retry_delays(F.col("message"), F.col("attempt")).alias("delay"))


# References and snippets in text.

_REFS = """SELECT page_id, array_to_string(regexp_extract_all(t, '(?:^|[^0-9A-Za-z_/])#([0-9]+)', 1), '|') AS refs, array_to_string(regexp_extract_all(t, '\\b([0-9a-f]{7,40})\\b', 1), '|') AS commits,
array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(t, '(?:^|[^0-9A-Za-z_/])#([0-9]+)', 1), lambda x: 'https://github.com/o/r/pull/' || x))), '|') AS pulls
FROM (SELECT page_id, '#' || page_id || ' closes #7 (#12, #7), not a/b#13 or x#14, at ' || substr(md5(url), 1, 12) || ' ' || url AS t FROM pages)"""


@query("OP-140 OP-141", _REFS)
def issue_and_commit_refs(spark, sf):
    t = F.concat(F.lit("#"), "page_id", F.lit(" closes #7 (#12, #7), not a/b#13 or x#14, at "), F.substring(F.md5("url"), 1, 12), F.lit(" "), "url")
    refs = tx.issue_refs(F.col("t"))
    pages = table(spark, sf, "pages").select("page_id", t.alias("t"))
    return pages.select("page_id", F.array_join(refs, "|").alias("refs"), F.array_join(tx.commit_refs(F.col("t")), "|").alias("commits"), F.array_join(tx.pull_urls_of(F.lit("o/r"), refs), "|").alias("pulls"))


_SNIPPETS = """SELECT doc_id, CASE WHEN text IS NULL THEN NULL WHEN lang = 'en' THEN text || chr(10) WHEN lang = 'de' THEN 'diff --git a/x b/x' || chr(10) || '+' || string_split(text, chr(10) || chr(10))[1] ELSE '' END AS snippet FROM documents"""


@query("OP-142", _SNIPPETS)
def diff_snippets(spark, sf):
    """English texts in a fenced block, German ones behind a diff header, the others plain."""
    fenced = F.concat(F.lit("See\n```DIFF\n"), "text", F.lit("\n```\nand ```patch\nno\n```"))
    headed = F.concat(F.lit("See\ndiff --git a/x b/x\n+"), "text")
    t = F.when(F.col("lang") == "en", fenced).when(F.col("lang") == "de", headed).otherwise(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", tx.fenced_diff(t).alias("snippet"))
