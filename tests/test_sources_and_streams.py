"""Readers, writers, scorers and streams on small files."""

import json
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from reportmill.operators import curation, scorers, taxonomy
from reportmill.sources import files, search, sinks, tables
from reportmill.streaming import upsert


def test_csv(spark, tmp_path):
    file = tmp_path / "a.csv"
    file.write_bytes('﻿id,note\n1,"two\nlines ""quoted"""\n'.encode())
    r = tables.csv(spark, str(file)).first()
    assert (r.id, r.note) == ("1", 'two\nlines "quoted"')
    empty = tables.optional_csv(spark, str(tmp_path / "none.csv"), "id string")
    assert empty.count() == 0
    sinks.write_csv(spark.createDataFrame([(1, " x\ny ")], "b int, a string"), str(tmp_path / "out"), ["a", "b"])
    back = tables.csv(spark, str(tmp_path / "out")).first()
    assert (back.a, back.b) == (" x\ny ", "1")
    with pytest.raises(ValueError, match="columns differ"):
        sinks.write_csv(spark.range(1), str(tmp_path / "bad"), ["x"])


def test_json(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1}\n\n{broken\n{"id": 2}\n')
    rows = tables.json_lines(spark, str(tmp_path / "a.jsonl"), "id int")
    assert sorted(r.id for r in rows.where("_corrupt is null").collect()) == [1, 2]
    assert tables.corrupt_count(rows) == 1
    root = tmp_path / "root"
    root.mkdir()
    (root / "b.json").write_text('[{"url": "u2"}, {"url": "u1"}]')
    (root / "a.json").write_text("[]")
    got = tables.json_arrays(spark, [str(root)], "url string").orderBy("position").collect()
    assert [r.url for r in got] == ["u2", "u1"]
    sinks.write_jsonl(spark.createDataFrame([(1, None)], "b int, a string"), str(tmp_path / "out"))
    line = "".join(p.read_text() for p in (tmp_path / "out").glob("part-*")).strip()
    assert line == '{"a":null,"b":1}'


def test_contexts_and_diffs(spark, tmp_path):
    folder = tmp_path / "ctx"
    folder.mkdir()
    (folder / "o__r__1.issue.json").write_text(json.dumps({"title": "T", "body": None, "state": "open"}))
    (folder / "o__r__1.comments.json").write_text(json.dumps([{"id": 2, "body": "late", "created_at": "2024-02"}, {"id": 1, "body": "early", "created_at": "2024-01", "user": {"login": "x"}}]))
    (folder / "o__r__2.issue.json").write_text(json.dumps({"title": "U", "body": "B"}))
    got = {r.stem: r for r in tables.contexts(spark, str(folder)).collect()}
    assert got["o__r__1"].comments == "early\nlate"
    assert (got["o__r__2"].comments, got["o__r__2"].comment_count) == ("", 0)
    (tmp_path / "x.diff").write_text("diff --git a/p b/p\n+1\ndiff --git a/q b/q\n")
    assert tables.diffs(spark, str(tmp_path / "x.diff")).first().changed_files == ["p", "q"]


def test_recorded_search(spark, tmp_path):
    (tmp_path / "nan.jsonl").write_text('{"url": "u", "title": "t"}\n')
    rows = tables.recorded_search(spark, str(tmp_path), ["nan", "missing"]).collect()
    assert [(r.query, r.url, r.title) for r in rows] == [("nan", "u", "t")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a|b", 2)], "label string, n int")
    assert sinks.markdown(df, ["label", "n"]).splitlines()[2] == "| a\\|b | 2 |"
    path = str(tmp_path / "t")
    sinks.append_new(df, path, "label")
    again = sinks.append_new(df.union(spark.createDataFrame([("c", 3)], df.schema)), path, "label")
    assert again.count() == 2


def test_bundle(tmp_path):
    (tmp_path / "a.txt").write_text("x")
    digests = sinks.bundle(str(tmp_path), ["a.txt"], str(tmp_path / "out.zip"))
    with zipfile.ZipFile(tmp_path / "out.zip") as z:
        assert json.loads(z.read("MANIFEST.json")) == digests
        assert z.read("a.txt") == b"x"
    with pytest.raises(FileNotFoundError):
        sinks.bundle(str(tmp_path), ["none"], str(tmp_path / "bad.zip"))


def stub(prompt: str) -> str:
    if "boom" in prompt:
        raise RuntimeError("retry in 0s")
    return '```json\n{"primary_failure_label": "good"}\n```' if "ok" in prompt else "I think bad"


def batch_stub(prompt: str) -> str:
    return json.dumps({str(i): "good" for i in range(2)})


def capped_stub(url: str, most: int) -> str:
    return stub(url)[:most]


def test_batch_answers():
    rows = [{"blind_id": "1", "primary_failure_label": "good"}, {"blind_id": 2, "primary_failure_label": "bad"}]
    want = {"1": "good", "2": "bad"}
    for text in (json.dumps(rows), json.dumps({"predictions": rows}), "```json\n" + json.dumps(rows) + "\n```", "Here: " + json.dumps(rows) + " done", json.dumps(want)):
        assert scorers.batch_answers(text, "blind_id", "primary_failure_label") == want
    assert scorers.batch_answers("no json", "blind_id", "primary_failure_label") == {}
    assert scorers.parse_json('x {"a": [1]} y') == {"a": [1]}


def test_scorers(spark):
    df = spark.createDataFrame([(1, "ok"), (2, "other"), (3, "boom")], "id int, p string")
    got = {r.id: (r.label, bool(r.error)) for r in scorers.score_rows(df, "id", "p", stub, ["good", "bad"], retries=0).collect()}
    assert got == {1: ("good", False), 2: ("bad", False), 3: ("needs_review", True)}
    batched = df.withColumn("b", F.lit(0))
    assert {r.id: r.label for r in scorers.score_batches(batched, "id", "p", "b", batch_stub, ["good"]).collect()} == {1: "good", 2: "needs_review", 3: "needs_review"}
    fetched = {r.id: r.status for r in scorers.fetch(df, "id", "p", capped_stub, largest=20).collect()}
    assert fetched == {1: "skipped_large", 2: "fetched", 3: "failed"}
    again = scorers.fetch(df, "id", "p", capped_stub, largest=20, cached=spark.createDataFrame([(2, "kept")], "id int, body string"))
    assert {r.id: (r.status, r.body) for r in again.collect()} == {1: ("skipped_large", ""), 2: ("cached", "kept"), 3: ("failed", "")}
    assert scorers.retry_delay("please retryDelay: 7s", 0) == 7
    packet = scorers.packets(df, "id", "S", "p", "id").first()
    assert [m.role for m in packet.messages] == ["system", "user"]


def test_streams(spark, tmp_path):
    rows = [(i, i % 3, float(i * 7 % 10), f"2024-01-01 0{i % 4}:00:00") for i in range(12)]
    df = spark.createDataFrame(rows, "event_id int, user_id int, value double, ts string").withColumn("ts", F.to_timestamp("ts"))
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = str(tmp_path / "best")
    q = stream.writeStream.foreachBatch(upsert.keep_best_sink(out, "user_id", "value", "event_id")).option("checkpointLocation", str(tmp_path / "c1")).start()
    q.processAllAvailable()
    q.stop()
    table = upsert.BucketedTable(spark, out, df.schema, "user_id")
    got = {r.user_id: r.value for r in table.read().collect()}
    assert got == {u: max(v for _, w, v, _ in rows if w == u) for u in range(3)}
    assert len(table.versions()) == 2
    q = upsert.first_seen(stream, "user_id", "value").writeStream.format("memory").queryName("seen").outputMode("update").option("checkpointLocation", str(tmp_path / "c2")).start()
    q.processAllAvailable()
    q.stop()
    top = spark.sql("select user_id, max(n) as n from seen group by user_id").collect()
    assert {r.user_id: r.n for r in top} == {0: 4, 1: 4, 2: 4}
    assert upsert.windowed_counts(df, "ts", "user_id").agg(F.sum("n")).first()[0] == 12
    assert upsert.sessions(df, "ts", "user_id", "90 minutes").agg(F.sum("n")).first()[0] == 12


def test_upserts_rewrite_only_their_buckets(spark, tmp_path):
    best = lambda rows: curation.keep_best(rows, ["k"], "s", "at")
    frame = lambda rows: spark.createDataFrame(rows, "k int, s double, at int")
    first = frame([(i, 1.0, i) for i in range(100)])
    table = upsert.BucketedTable(spark, str(tmp_path / "t"), first.schema, "k", buckets=16)
    assert table.read().collect() == []
    one = table.merge(first, 0, best)
    two = table.merge(frame([(5, 2.0, 100), (5, 3.0, 101), (200, 1.0, 102)]), 1, best)
    moved = [b for b in two["buckets"] if two["buckets"][b] != one["buckets"].get(b)]
    assert 1 <= len(moved) <= 2
    rows = {r.k: r.s for r in table.read().collect()}
    assert rows == {i: 1.0 for i in range(100)} | {5: 3.0, 200: 1.0}
    assert table.merge(frame([(5, 9.0, 0)]), 1, best) == two  # a repeated batch
    late = table.merge(frame([(5, 2.5, 7), (6, 1.0, 0)]), 2, best)  # a late one loses, or wins the tie by position
    assert {r.k: r.at for r in table.read().where("k in (5, 6)").collect()} == {5: 101, 6: 0}
    assert {r.k: r.s for r in table.read(0).collect()} == {i: 1.0 for i in range(100)}
    assert table.merge(frame([]), 3, best)["buckets"] == late["buckets"]
    table.expire(keep=2)
    assert table.versions() == [2, 3] and table.read().count() == 101
    with pytest.raises(files.Taken):
        files.commit(spark, f"{tmp_path}/t/manifest/v000000003.json", "{}")
    with pytest.raises(ValueError, match="16 buckets"):
        upsert.BucketedTable(spark, str(tmp_path / "t"), first.schema, "k", buckets=8).read()


def test_counts_beside_the_rows(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1}\n\n{broken\n{"id": 2}\n')
    rows, seen = tables.counted_json_lines(spark, str(tmp_path / "a.jsonl"), "id int")
    assert sorted(r.id for r in rows.collect()) == [1, 2]
    assert seen.get == {"rows": 3, "malformed": 1}
    base = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, v string")
    valid, bad = taxonomy.checked(base, "v", ["a"])
    assert valid.count() == 3 and bad.get == {"rows": 3, "invalid": 2}
    more = spark.createDataFrame([(3, "z"), (4, "d"), (4, "e"), (5, "")], "id int, v string")
    merged, counts = curation.observed_merge(base, more, "id", F.col("v") != "", "v")
    assert sorted(r.id for r in merged.collect()) == [1, 2, 3, 4]
    assert counts.get == {"rows": 4, "incomplete": 1, "duplicate": 2, "appended": 1}


def test_search_source(spark, tmp_path):
    (tmp_path / "nan.jsonl").write_text("".join(json.dumps({"url": f"u{i}", "title": "t", "n": 1}) + "\n" for i in range(25)) + "{broken\n\n[1]\n")
    (tmp_path / "inf.jsonl").write_text(json.dumps({"url": "x", "state": None}))
    search.register(spark, search.Recordings(str(tmp_path)))
    read = spark.read.format(search.FORMAT).option("terms", json.dumps(["nan", "inf", "none", "nan"])).load()
    assert read.count() == 26 and read.columns == ["query", "url", "title", "body", "state"]
    assert read.rdd.getNumPartitions() == 2
    one = read.where("query = 'inf'")
    assert [tuple(r) for r in one.collect()] == [("inf", "x", None, None, None)] and one.rdd.getNumPartitions() == 1
    assert read.where("query in ('nan') and url = 'u3'").count() == 1
    assert spark.read.format(search.FORMAT).load().count() == 0
    parts = search._ranges("t", 5, 25_005)
    assert [(p.start, p.stop) for p in parts] == [(5, 10_005), (10_005, 20_005), (20_005, 25_005)]


def test_search_stream_goes_on_at_its_offset(spark, tmp_path):
    file = tmp_path / "nan.jsonl"
    file.write_text('{"url": "u1"}\n')
    search.register(spark, search.Recordings(str(tmp_path)), "search_stream")

    def run():
        stream = spark.readStream.format("search_stream").option("terms", '["nan"]').load()
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).start()
        q.processAllAvailable()
        q.stop()

    run()
    file.write_text('{"url": "u1"}\n{"url": "u2"}\n')
    run()
    assert sorted(r.url for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["u1", "u2"]


def asked_client(folder, fatal=None):
    """Notes each request and its time in a file of its own; dies hard at one url."""

    def get(url, most):
        if fatal and url.endswith(fatal):
            raise SystemExit("killed")
        host = url.split("/")[2]
        with open(f"{folder}/{host}.txt", "a") as f:
            f.write(f"{url} {time.monotonic()}\n")
        if url.endswith("/3"):
            raise ConnectionError("refused")
        return url.upper()[:most]

    return get


def test_fetch_is_taken_up_where_it_died(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"https://h{i % 3}.org/{i}") for i in range(18)] + [(0, "https://h0.org/0"), (None, "https://h1.org/x"), (99, None)], "id int, url string")
    log, notes = str(tmp_path / "log"), tmp_path / "notes"
    notes.mkdir()
    with pytest.raises(Exception, match="killed|SystemExit|Python worker"):
        scorers.logged_fetch(rows, "id", "url", asked_client(notes, fatal="/17"), log, batch=2, pause=0.05)
    before = sum(len(p.read_text().splitlines()) for p in notes.iterdir())
    logged = spark.read.parquet(log).count()
    assert 0 < logged < 18 and logged == 12  # two whole batches of two rows of three hosts
    (tmp_path / "again").mkdir()
    out = {r.id: (r.host, r.body, r.status) for r in scorers.logged_fetch(rows, "id", "url", asked_client(tmp_path / "again"), log, batch=2).collect()}
    again = [x.split()[0] for p in (tmp_path / "again").iterdir() for x in p.read_text().splitlines()]
    assert len(again) == 6 and before >= 12
    assert out == {i: (f"h{i % 3}.org", "" if i == 3 else f"HTTPS://H{i % 3}.ORG/{i}", "failed" if i == 3 else "fetched") for i in range(18)}
    for p in notes.iterdir():  # one pace for each host within a batch
        times = [float(x.split()[1]) for x in p.read_text().splitlines()]
        assert all(b - a >= 0.045 for a, b in list(zip(times[:-1], times[1:], strict=True))[::2])
    third = scorers.logged_fetch(rows, "id", "url", asked_client(tmp_path / "again"), log, batch=2, retry_failed=True)
    assert third.count() == 18 and sum(len(p.read_text().splitlines()) for p in (tmp_path / "again").iterdir()) == 7
