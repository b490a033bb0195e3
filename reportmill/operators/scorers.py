"""External scorers and fetchers as partition operators with an injectable client.

The client is any picklable callable; tests and offline runs pass a stub.  A
failing call gives a row with the error, never a failed job, and done keys are
left out by an anti join, so a run can be taken up again.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..scratch import written
from ..sources.tables import exists
from .sampling import ranked

Client = Callable[[str], str]


NAMED_DELAY = r"retry(?:Delay)?[^0-9]{0,20}([0-9]+(?:\.[0-9]+)?)\s*s"


def retry_delays(message: Column, attempt: Column, base: float = 2.0, longest: float = 60.0) -> Column:
    """Seconds to wait: what the error message names, else exponential; as ``retry_delay``, for columns."""
    named = F.regexp_extract(F.coalesce(message, F.lit("")), f"(?i){NAMED_DELAY}", 1)
    return F.least(F.lit(longest), F.when(named != "", named.cast("double")).otherwise(F.lit(base) * F.pow(F.lit(2.0), attempt)))


def retry_delay(message: str, attempt: int, base: float = 2.0, longest: float = 60.0) -> float:
    """Seconds to wait: what the error message names, else exponential."""
    named = re.search(NAMED_DELAY, message, re.I)
    return min(longest, float(named[1]) if named else base * 2**attempt)


def call(client: Client, prompt: str, retries: int = 2, sleep: Callable[[float], None] = time.sleep) -> tuple[str, str]:
    """(answer, error) of a call with retries."""
    error = ""
    for attempt in range(retries + 1):
        try:
            return client(prompt), ""
        except Exception as e:  # noqa: BLE001  any client error becomes a row
            error = f"{type(e).__name__}: {e}"
            if attempt < retries:
                sleep(retry_delay(error, attempt))
    return "", error


def parse_json(text: str) -> dict | list | None:
    """The JSON object or list in an answer: as it is, without fences, or from the first brace or bracket to its last; None if none parses."""
    bare = re.sub(r"^\s*```[a-zA-Z]*|```\s*$", "", text or "")
    pieces = [text or "", bare]
    starts = sorted((bare.find(o), o, c) for o, c in ("{}", "[]") if o in bare)
    pieces += [bare[at : bare.rfind(c) + 1] for at, _, c in starts]
    for piece in pieces:
        try:
            found = json.loads(piece)
        except ValueError:
            continue
        if isinstance(found, (dict, list)):
            return found
    return None


def parse_answer(text: str) -> dict:
    """The JSON object in an answer; empty if there is none."""
    found = parse_json(text)
    return found if isinstance(found, dict) else {}


def batch_answers(text: str, key: str, label: str) -> dict[str, str]:
    """Label by id of a batch's answer: a list of objects, an object that holds it under ``predictions``, or labels by id."""
    found = parse_json(text)
    if isinstance(found, dict):
        found = found.get("predictions", [{key: k, label: v} for k, v in found.items()])
    rows = [r for r in found or () if isinstance(r, dict) and r.get(key)] if isinstance(found, list) else []
    return {str(r[key]): str(r.get(label, "")).strip() for r in rows}


def normal_label(text: str, labels: list[str], default: str = "needs_review") -> str:
    """The label an answer means: exact, from its JSON, or the first of ``labels`` it contains."""
    plain = text.strip().lower()
    if plain in labels:
        return plain
    named = str(parse_answer(text).get("primary_failure_label", "")).strip().lower()
    if named in labels:
        return named
    return next((x for x in labels if x in plain), default)


def pending(rows: DataFrame, done: DataFrame | None, key: str) -> DataFrame:
    """Rows whose key is not done yet."""
    return rows if done is None else rows.join(done.select(key).distinct(), key, "left_anti")


def score_rows(rows: DataFrame, key: str, prompt: str, client: Client, labels: list[str], retries: int = 2) -> DataFrame:
    """(key, label, raw_response, error, elapsed_seconds), one call a row; an error labels the row needs_review."""
    kind = rows.schema[key].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for k, p in part[[key, prompt]].itertuples(index=False):
                began = time.monotonic()
                answer, error = call(client, p or "", retries)
                out.append((k, normal_label(answer, labels) if not error else "needs_review", answer, error, time.monotonic() - began))
            yield pd.DataFrame(out, columns=[key, "label", "raw_response", "error", "elapsed_seconds"])

    return rows.select(key, prompt).mapInPandas(run, f"{key} {kind}, label string, raw_response string, error string, elapsed_seconds double")


def score_batches(rows: DataFrame, key: str, prompt: str, batch: str, client: Client, labels: list[str], id_field: str = "blind_id", label_field: str = "primary_failure_label", retries: int = 0) -> DataFrame:
    """(key, label, error): one call for each batch, whose answer ``batch_answers`` reads; a row without one is needs_review."""
    kind = rows.schema[key].dataType.simpleString()

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(key)
        text = "\n".join(f"[{k}] {p}" for k, p in part[[key, prompt]].itertuples(index=False))
        answer, error = call(client, text, retries)
        found = batch_answers(answer, id_field, label_field)
        error = error or ("" if found else "parse_error")
        labelled = [found[str(k)] if found.get(str(k)) in labels else "needs_review" for k in part[key]]
        return pd.DataFrame({key: part[key], "label": labelled, "error": ["" if str(k) in found else error for k in part[key]]})

    return rows.select(key, prompt, batch).groupBy(batch).applyInPandas(run, f"{key} {kind}, label string, error string")


def fetch(rows: DataFrame, key: str, url: str, client: Callable[[str, int], str | bytes], largest: int = 5_000_000, pause: float = 0.0, cached: DataFrame | None = None) -> DataFrame:
    """(key, body, status, error): a body for each url that ``cached`` (key, body) lacks.

    The client gets the most bytes that it may read, one over ``largest``; a
    body of more is skipped and never held.  Status is cached, fetched,
    skipped_large or failed.
    """
    kind = rows.schema[key].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for k, u in part[[key, url]].itertuples(index=False):
                body, error = call(lambda u: client(u, largest + 1), u, retries=0)
                raw = body.encode() if isinstance(body, str) else body
                large = len(raw) > largest
                out.append((k, "" if large else raw.decode("utf-8", "replace"), "failed" if error else "skipped_large" if large else "fetched", error))
                if pause:
                    time.sleep(pause)
            yield pd.DataFrame(out, columns=[key, "body", "status", "error"])

    got = pending(rows, cached, key).select(key, url).mapInPandas(run, f"{key} {kind}, body string, status string, error string")
    if cached is None:
        return got
    known = rows.select(key).join(cached.select(key, "body"), key).select(key, "body", F.lit("cached").alias("status"), F.lit("").alias("error"))
    return known.unionByName(got)


def logged_fetch(rows: DataFrame, key: str, url: str, client: Callable[[str, int], str | bytes], log: str, largest: int = 5_000_000, pause: float = 0.0, batch: int = 1000, retry_failed: bool = False) -> DataFrame:
    """(key, host, body, status, error): every row's fetch, from the Parquet log at ``log``, which a restart takes up.

    Keys in the log are not asked for again (failed ones only with
    ``retry_failed``).  The others go in batches of at most ``batch`` rows of
    each host; a host's rows of a batch are one task's, ``pause`` seconds apart,
    so a host sees one pace however large the cluster is, and hosts run beside
    each other.  A batch is appended to the log when it is done: a run that
    dies loses the batch it was in.  Rows of one key are fetched once, by the
    smallest url; null keys and urls are left out.
    """
    spark = rows.sparkSession
    kind = rows.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, host string, body string, status string, error string"

    def logged() -> DataFrame:
        return spark.read.schema(schema).parquet(log) if exists(spark, log) else spark.createDataFrame([], schema)

    once = rows.where(F.col(key).isNotNull() & F.col(url).isNotNull()).groupBy(key).agg(F.min(url).alias("_url"))
    done = logged() if not retry_failed else logged().where("status <> 'failed'")
    left = pending(once, done, key).withColumn("host", F.coalesce(F.lower(F.try_parse_url("_url", F.lit("HOST"))), F.lit("")))
    left = written(ranked(left, ["host"], [key]).select(key, "_url", "host", F.floor((F.col("_rank") - 1) / batch).alias("_batch")), "pending")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: dict[str, float] = {}
        for part in parts:
            out = []
            for k, u, host in part[[key, "_url", "host"]].itertuples(index=False):
                wait = last.get(host, float("-inf")) + pause - time.monotonic()
                if wait > 0:
                    time.sleep(wait)
                last[host] = time.monotonic()
                body, error = call(lambda u: client(u, largest + 1), u, retries=0)
                raw = body.encode() if isinstance(body, str) else body
                large = len(raw) > largest
                out.append((k, host, "" if large else raw.decode("utf-8", "replace"), "failed" if error else "skipped_large" if large else "fetched", error))
            yield pd.DataFrame(out, columns=[key, "host", "body", "status", "error"])

    last_batch = left.agg(F.max("_batch")).first()[0]
    for n in range(0 if last_batch is None else last_batch + 1):
        now = left.where(F.col("_batch") == n)
        hosts = now.select("host").distinct().count()
        now.repartition(min(max(hosts, 1), 10_000), "host").sortWithinPartitions("host", key).mapInPandas(run, schema).write.mode("append").parquet(log)
    latest = F.max_by(F.struct("host", "body", "status", "error"), F.col("status") != "failed").alias("r")
    return logged().join(once.select(key), key, "left_semi").groupBy(key).agg(latest).select(key, "r.*")


def packets(rows: DataFrame, key: str, system: str, user: str, *meta: str) -> DataFrame:
    """(key, messages, metadata) chat packets."""
    role = lambda r, c: F.struct(F.lit(r).alias("role"), c.alias("content"))
    return rows.select(key, F.array(role("system", F.lit(system)), role("user", F.col(user))).alias("messages"), F.struct(*sorted(meta)).alias("metadata"))
