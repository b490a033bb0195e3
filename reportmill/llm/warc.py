"""WARC archives written from, and read back as, a chunked record table.

A payload is never held whole beside its row: it is written as segments of a
bounded size, each a WARC record of its own (the first ``response``, the others
``continuation``, numbered by WARC-Segment-Number), and read back as rows of
record identifier and chunk number with the digest carried along from chunk to
chunk.  Archives are gzip text files made by Spark's own writer, so they live
in any file system that Spark knows, and one file is read by one task in order.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .workspace import bound_batches, materialize

CHUNK_BYTES = 256 << 10
URN = "urn:x-page:"
END = "\r\n"


def digest32(sha1: bytes) -> str:
    """Bare upper-case base32 of a digest."""
    return base64.b32encode(sha1).decode()


def _payload(value: pa.Scalar) -> memoryview:
    """A string or binary value's own bytes, without a copy; a null has none."""
    return memoryview(value.as_buffer()) if value.is_valid else memoryview(b"")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, digests = [], []
        for value in batch.column(1):
            raw, sha = _payload(value), hashlib.sha1()
            for at in range(0, len(raw), CHUNK_BYTES):
                sha.update(raw[at : at + CHUNK_BYTES])
            sizes.append(len(raw))
            digests.append(digest32(sha.digest()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(sizes, pa.int64()), pa.array(digests, pa.string())], names=["page_id", "k1", "k2", "payload_bytes", "payload_digest"])


def _hashes(page: Column) -> list[Column]:
    """128 bits that pair a page's row with its planned record."""
    return [F.xxhash64(page.cast("string")).alias("k1"), F.xxhash64(F.lit("page"), page.cast("string")).alias("k2")]


def plan_records(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", least: int = 0) -> DataFrame:
    """(page_id, k1, k2, payload_bytes, payload_digest, refers_to): what each page's record is.

    Of payloads of equal digest and length, of at least ``least`` bytes, the
    largest id answers and the others refer to it.  The payloads are read but
    not shuffled; maxima are combined before the shuffle.
    """
    kind = pages.schema[id_col].dataType.simpleString()
    found = pages.select(F.col(id_col).alias("page_id"), F.encode(F.col(html_col).cast("string"), "UTF-8").alias("html"), *_hashes(F.col(html_col)))
    found = materialize(found.mapInArrow(_digests, f"page_id {kind}, k1 long, k2 long, payload_bytes long, payload_digest string"), "digests")
    shared = found.where(F.col("payload_bytes") >= least).groupBy("payload_digest", "payload_bytes").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).where("n > 1").drop("n")
    joined = found.join(shared, ["payload_digest", "payload_bytes"], "left")
    refers = F.when(F.col("keeper").isNotNull() & F.col("page_id").isNotNull() & (F.col("page_id") != F.col("keeper")), F.col("keeper"))
    return joined.select("page_id", "k1", "k2", "payload_bytes", "payload_digest", refers.alias("refers_to"))


def _chunks(raw: memoryview, size: int) -> Iterator[memoryview]:
    """Pieces of at most ``size`` bytes (4 at least) of UTF-8, cut between characters; one empty piece of nothing."""
    size = max(4, size)
    if not len(raw):
        yield raw
    at = 0
    while at < len(raw):
        to = min(len(raw), at + size)
        while to < len(raw) and raw[to] & 0xC0 == 0x80:
            to -= 1
        if to < len(raw) and to - at > 1 and raw[to - 1 : to + 1] == END.encode():  # a line end stays whole
            to -= 1
        yield raw[at:to]
        at = to


def _name(page: object) -> str:
    """A page's id in a record's."""
    return URN + quote("" if page is None else str(page), safe="")


def _page(record_id: str) -> str:
    return unquote(record_id.strip("<>").removeprefix(URN).split("#")[0])


def _records(chunk: int):
    """Rows of page to the text of their WARC records, one row a record.

    A segment is named by its page and number; of pages in several equal rows
    each row has a mark of its own as well, so that no two records share an id.
    """

    def head(fields: list[tuple[str, object]], body: str, size: int) -> str:
        lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in fields if v is not None), f"Content-Length: {size}"]
        return END.join(lines) + END + END + body + END

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, turn = TaskContext.get(), 0
        for batch in batches:
            out: list[str] = []
            held = 0
            for page, url, page_html, size, digest, refers, copies in zip(*(batch.column(i) for i in range(7)), strict=True):
                turn += 1
                own = _name(page.as_py()) + (f"#{task.partitionId() if task else 0}.{turn}" if copies.as_py() > 1 else "")
                base = [("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Target-URI", " ".join((url.as_py() or "").split()) or None), ("WARC-Payload-Digest", f"sha1:{digest.as_py()}"), ("X-Payload-Length", size.as_py())]
                if refers.is_valid:
                    records = iter([head([("WARC-Type", "revisit"), ("WARC-Record-ID", f"<{own}>"), *base, ("WARC-Refers-To", f"<{_name(refers.as_py())}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")], "", 0)])
                else:
                    records = (
                        head([("WARC-Type", "continuation" if n else "response"), ("WARC-Record-ID", f"<{own}{'#' * (own.count('#') == 0)}/{n + 1}>" if n else f"<{own}>"), *base, ("WARC-Segment-Number", n + 1), ("WARC-Segment-Origin-ID", f"<{own}>" if n else None), ("Content-Type", "text/html; charset=utf-8")], str(piece, "utf-8"), len(piece))
                        for n, piece in enumerate(_chunks(_payload(page_html), chunk))
                    )
                for r in records:
                    out.append(r)
                    held += len(r)
                    if held > 4 * chunk:
                        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])
                        out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])

    return run


def write_archives(pages: DataFrame, plan: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", chunk: int = CHUNK_BYTES) -> None:
    """Write a record for every page below ``path``, as planned.

    Defined cases: a null page is an empty payload, a null url an empty one; a
    null id and repeated rows have records of their own; payloads of any length
    go in segments; an empty table writes no record; other columns are ignored.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"), *_hashes(F.col(html_col)))
    once = plan.groupBy("page_id", "k1", "k2").agg(*[F.first(c).alias(c) for c in ("payload_bytes", "payload_digest", "refers_to")], F.count("*").alias("copies"))
    once = once.withColumnsRenamed({"page_id": "_id", "k1": "_k1", "k2": "_k2"})
    full = rows.join(once, rows["page_id"].eqNullSafe(once["_id"]) & (rows["k1"] == once["_k1"]) & (rows["k2"] == once["_k2"]))
    records = full.select("page_id", "url", "html", "payload_bytes", "payload_digest", "refers_to", "copies").mapInArrow(_records(chunk), "value string")
    records.write.option("compression", "gzip").option("lineSep", END).text(path)


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of archives to rows of the chunk table."""
    fields: dict[str, str] = {}
    state, left, body = "between", 0, []
    for batch in batches:
        out = []
        for value in batch.column(0):
            line = value.as_py()
            if state == "between":
                if line == "WARC/1.1":
                    state, fields = "head", {}
            elif state == "head":
                if line:
                    key, _, rest = line.partition(": ")
                    fields[key] = rest
                    continue
                state, left, body = "body", int(fields["Content-Length"]), []
            else:
                raw = line.encode()
                body.append(raw)
                left -= len(raw)
                if left > 0:
                    body.append(END.encode())
                    left -= len(END)
                if left > 0 or (left == 0 and body[-1:] == [END.encode()]):
                    continue
                text = b"".join(body)
                if len(text) != int(fields["Content-Length"]):
                    raise ValueError(f"record {fields.get('WARC-Record-ID')} is cut short")
                out.append((fields["WARC-Segment-Origin-ID" if "WARC-Segment-Origin-ID" in fields else "WARC-Record-ID"].strip("<>").removeprefix(URN), fields["WARC-Type"], int(fields.get("WARC-Segment-Number", 1)), text, fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(fields["X-Payload-Length"]), _page(fields["WARC-Refers-To"]) if "WARC-Refers-To" in fields else None))
                state = "between"
        if out:
            kinds = [pa.string(), pa.string(), pa.int32(), pa.binary(), pa.string(), pa.int64(), pa.string()]
            names = ["record_id", "record_type", "chunk_no", "chunk", "header_digest", "header_length", "refers_to"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
    if state != "between":
        raise ValueError("an archive ends within a record")



def _lines(spark: SparkSession, path: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.option("lineSep", END).text(path)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """The chunk table of the archives: (record_id, record_type, chunk_no, chunk, header_digest, header_length, refers_to).

    Files are read as lines by CR LF and put together by Content-Length; a row
    holds at most a segment.
    """
    return _lines(spark, path).mapInArrow(_assemble, "record_id string, record_type string, chunk_no int, chunk binary, header_digest string, header_length long, refers_to string")


def read_records(spark: SparkSession, path: str, id_type: str = "long") -> DataFrame:
    """One row per record: (page_id, payload_bytes, payload_digest, record_type, refers_to).

    Defined cases: a record without a page has a null page_id; archives without
    records give an empty result; repeated records give repeated rows; an id that
    is no ``id_type`` is an error.  Digests and sizes of responses are computed again from their chunks, which
    follow each other in their file; a difference from the header is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha, size = None, None, 0

        def done() -> tuple:
            record_id, kind, header_digest, header_length, refers = now
            if kind == "response" and (digest32(sha.digest()), size) != (header_digest, header_length):
                raise ValueError(f"record {record_id} does not match its digest")
            return _page(record_id) or None, header_length, header_digest, kind, refers

        for batch in _assemble(batches):
            out = []
            for r in batch.to_pylist():
                if r["record_type"] != "continuation":
                    if now:
                        out.append(done())
                    now, sha, size = (r["record_id"], r["record_type"], r["header_digest"], r["header_length"], r["refers_to"]), hashlib.sha1(), 0
                sha.update(r["chunk"])
                size += len(r["chunk"])
            if out:
                yield _table(out)
        if now:
            yield _table([done()])

    def _table(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    rows = _lines(spark, path).mapInArrow(run, "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string")
    return rows.select(F.col("page_id").cast(id_type).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(id_type).alias("refers_to"))


def archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", chunk: int = CHUNK_BYTES, least: int = 0) -> DataFrame:
    """Write the archives below ``path`` and return their records, read back.

    Payloads of at least ``least`` bytes that equal another's become revisits of
    the page of largest id.  Defined cases: a null page is an empty payload; a
    null id has a response record of its own; repeated rows are all responses if
    theirs is the largest id; an empty table gives no record; other columns are
    ignored.
    """
    bound_batches(pages.sparkSession, rows=200)
    plan = materialize(plan_records(pages, id_col, html_col, least), "records")
    write_archives(pages, plan, path, id_col, url_col, html_col, chunk)
    return read_records(pages.sparkSession, path, pages.schema[id_col].dataType.simpleString())


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), m AS (SELECT h, max(page_id) AS top FROM p GROUP BY h), x AS (SELECT page_id, top, strlen(h)::BIGINT AS payload_bytes, sha1(h) AS x FROM p JOIN m USING (h)),
t AS (SELECT *, list_transform(range(0, 40), lambda i: strpos('0123456789abcdef', substr(x, i + 1, 1)) - 1) AS d FROM x)
SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (((16 * d[5 * i // 4 + 1] + d[5 * i // 4 + 2]) >> (3 - 5 * i % 4)) & 31)::INT, 1)), '') AS payload_digest,
CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to FROM t
"""
