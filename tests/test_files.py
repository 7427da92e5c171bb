"""Exchange formats and streams."""

import os
import uuid

import pytest
from pyspark.sql import functions as F

from watchbill.sources.files import read_csv, read_documents, write_csv, write_json
from watchbill.sources.tables import written
from watchbill.streaming.clicks import append, keep_latest, once_each, read_events, session_counts, window_counts


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a\"b, c\nd", 1), ("é", 2), (None, None)], "name string, n int")
    write_csv(df.coalesce(1), str(tmp_path / "x"))
    assert {tuple(r) for r in read_csv(spark, str(tmp_path / "x"), "name string, n int").collect()} >= {("a\"b, c\nd", 1), ("é", 2)}
    raw = next((tmp_path / "x").glob("*.csv")).read_bytes()
    assert raw.startswith(b"\xef\xbb\xbf") or raw.startswith(b'"\xef\xbb\xbf')
    write_json(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 3


def test_documents(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"one two")
    (tmp_path / "b.pdf").write_bytes(b"\xff")
    (tmp_path / "c.txt").write_bytes(b"no")

    def extract(path, content):
        for i, w in enumerate(content.decode().split()):
            yield {"path": path, "ord": i, "text": w}

    rows = read_documents(spark, str(tmp_path), extract, "path string, ord bigint, text string").collect()
    assert sorted((r["text"] or "") for r in rows) == ["", "one", "two"]


def test_streams(spark, tmp_path):
    schema = "event_id int, ts timestamp, kind string, v int"
    rows = [(1, "2026-01-01 00:10:00", "a", 1), (1, "2026-01-01 00:10:00", "a", 1), (2, "2026-01-01 00:20:00", "b", 2), (3, "2026-01-01 01:00:00", "a", 3)]
    df = spark.createDataFrame(rows, "event_id int, ts string, kind string, v int").withColumn("ts", F.col("ts").cast("timestamp"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    assert schema.count(",") == 3
    stream = lambda: read_events(spark, str(tmp_path / "in"))
    append(once_each(stream(), "event_id", "ts", "1 hour"), str(tmp_path / "out"), uuid.uuid4().hex).awaitTermination()
    stored = spark.read.parquet(str(tmp_path / "out"))
    assert stored.count() == 3
    assert {(str(r["window_start"]), r["kind"], r["n"]) for r in window_counts(stored, "ts", "kind", "1 hour", "1 hour").collect()} == {("2026-01-01 00:00:00", "a", 1), ("2026-01-01 00:00:00", "b", 1), ("2026-01-01 01:00:00", "a", 1)}
    assert session_counts(stored, "ts", "kind", "30 minutes", "1 hour").count() == 3
    keep_latest(stream(), ["kind"], "ts", "event_id", str(tmp_path / "latest"), uuid.uuid4().hex).awaitTermination()
    assert {(r["kind"], r["v"]) for r in spark.read.parquet(str(tmp_path / "latest/v0")).collect()} == {("a", 3), ("b", 2)}


def test_written(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "a int, b string")
    assert {tuple(r) for r in written(df).collect()} == {(1, None), (2, "x")}
    assert written(df.limit(0)).count() == 0


def test_events_of_later_files_count(spark, tmp_path, monkeypatch):
    import watchbill.streaming.clicks as C
    from watchbill.plans.reference import click_stream_counts

    for n, (id, at) in enumerate([(1, "2026-01-02 10:00:00"), (2, "2026-01-01 10:00:00"), (2, "2026-01-01 10:00:00"), (3, "2025-12-31 10:00:00")]):
        df = spark.createDataFrame([(id, at, "a")], "event_id int, ts string, event_type string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
        os.utime(max((tmp_path / "events.parquet").glob("*.parquet"), key=lambda p: p.stat().st_mtime_ns), (1_700_000_000 + n, 1_700_000_000 + n))
    read = C.read_events
    monkeypatch.setattr(C, "read_events", lambda *a: read(*a, files_per_trigger=1))
    assert sorted(str(r["window_start"])[:10] for r in click_stream_counts(spark, str(tmp_path)).collect() for _ in range(r["n"])) == ["2025-12-31", "2026-01-01", "2026-01-02"]


def test_jdbc_round_trip(spark, tmp_path):
    from watchbill.sources.files import read_jdbc, write_jdbc

    url = f"jdbc:derby:{tmp_path}/db;create=true"
    df = spark.createDataFrame([(i, f"n{i}") for i in range(50)] + [(99, None)], "id int, name string")
    write_jdbc(df, url, "people", "overwrite", 2)
    back = read_jdbc(spark, url, "people", "id", 0, 100, 3)
    assert {tuple(r) for r in back.collect()} == {tuple(r) for r in df.collect()}


def test_unreadable_documents_keep_their_error(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"x")

    def extract(path, content):
        raise ValueError("broken page")

    rows = read_documents(spark, str(tmp_path), extract, "path string, text string, error string").collect()
    assert [(r["text"], r["error"]) for r in rows] == [(None, "ValueError: broken page")]


def test_shared_folder(spark, monkeypatch):
    from watchbill.operators.store import content_key
    from watchbill.sources import tables

    df = spark.createDataFrame([("a", None), ("a", ""), (None, "a")], "x string, y string")
    assert len({r[0] for r in df.select(content_key(F.col("x"), F.col("y"))).collect()}) == 3

    class Context:
        master = "spark://somewhere:7077"

        class _jsc:
            sc = staticmethod(lambda: type("S", (), {"getCheckpointDir": staticmethod(lambda: type("O", (), {"isDefined": staticmethod(lambda: False)}))}))

    class Session:
        sparkContext = Context
        conf = {}

    with pytest.raises(RuntimeError):
        tables.shared_dir(Session)


def test_latest_state_over_batches(spark, tmp_path):
    from watchbill.streaming.clicks import latest_state

    schema = "k string, v int, at timestamp, id int"
    name = uuid.uuid4().hex
    for batch in ([("a", 1, "2026-01-02", 1), ("b", 1, "2026-01-01", 2)], [("a", 2, "2026-01-01", 3), ("b", 2, "2026-01-02", 4), ("c", 1, "2026-01-01", 5)], []):
        df = spark.createDataFrame(batch, "k string, v int, at string, id int").withColumn("at", F.col("at").cast("timestamp"))
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        keep_latest(read_events(spark, str(tmp_path / "in")), ["k"], "at", "id", str(tmp_path / "out"), name).awaitTermination()
    assert {(r["k"], r["v"]) for r in latest_state(spark, str(tmp_path / "out"), schema).collect()} == {("a", 1), ("b", 2), ("c", 1)}
    assert latest_state(spark, str(tmp_path / "none"), schema).count() == 0
