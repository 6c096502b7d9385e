"""Streams end with what a batch over the same rows gives."""

import json
import os

import pytest
from pyspark.sql import functions as F

from quillspark.operators import speech
from quillspark.streaming import capture


def drained(df, name, spark):
    query = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.table(name)


@pytest.fixture()
def state_store(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(key)


def put(folder, number, rows):
    folder.mkdir(exist_ok=True)
    path = folder / f"{number:03d}.json"
    path.write_text("\n".join(json.dumps(r, default=str) for r in rows))
    os.utime(path, (1_700_000_000 + number, 1_700_000_000 + number))  # files are taken in the order of their times


def test_window_levels_equal_the_batch(spark, tmp_path):
    schema = "stream long, ts timestamp, value double"
    for n in range(3):
        put(tmp_path / "in", n, [{"stream": s, "ts": f"2024-01-01T00:00:{n:02d}.{i:03d}Z", "value": i / 100} for s in (1, 2) for i in range(0, 100, 5)])
    live = drained(capture.window_levels(capture.read_stream(spark, str(tmp_path / "in"), schema, 1)), "window_levels", spark)
    whole = capture.window_levels(spark.read.schema(schema).json(str(tmp_path / "in")))
    # the last windows are still open when the stream stops
    a, b = ({(r.stream, r.frame.start): (r.n, round(r.energy, 9)) for r in x.collect()} for x in (live, whole))
    assert a and set(a.items()) <= set(b.items())


def test_live_chunks_equal_the_batch(spark, tmp_path, state_store):
    db = [-70.0] * 60 + [-20.0] * 100 + [-70.0] * 300 + [-20.0] * 30
    for n, at in enumerate(range(0, len(db), 123)):
        put(tmp_path / "in", n, [{"meeting_id": 1, "source": "Microphone", "frame": at + i, "db": x, "last": at + i == len(db) - 1} for i, x in enumerate(db[at : at + 123])])
    schema = "meeting_id long, source string, frame long, db double, last boolean"
    live = drained(capture.live_chunks(capture.read_stream(spark, str(tmp_path / "in"), schema, 1)), "live_chunks", spark)
    whole = speech.speech_chunks(spark.read.schema(schema).json(str(tmp_path / "in")))
    assert sorted(map(tuple, live.collect())) == sorted(map(tuple, whole.collect())) != []


def test_stalls_are_told(spark, tmp_path, state_store):
    put(tmp_path / "in", 0, [{"stream": 1, "ts": f"2024-01-01T00:00:{s:02d}Z"} for s in (0, 1, 2)])
    put(tmp_path / "in", 1, [{"stream": 1, "ts": f"2024-01-01T00:00:{s:02d}Z"} for s in (9, 10)])
    alerts = drained(capture.stall_alerts(capture.read_stream(spark, str(tmp_path / "in"), "stream long, ts timestamp", 1)), "stalls", spark)
    assert [r.gap_seconds for r in alerts.collect()] == [7.0]


def test_journal_sink_and_union(spark, tmp_path):
    put(tmp_path / "in", 0, [{"kind": "Segment", "n": i} for i in range(4)])
    entries = capture.read_stream(spark, str(tmp_path / "in"), "kind string, n long")
    capture.write_journal(capture.degraded_union(None, entries), str(tmp_path / "out"), str(tmp_path / "state"), None).awaitTermination(60)
    assert spark.read.json(str(tmp_path / "out")).agg(F.sum("n")).first()[0] == 6
    with pytest.raises(ValueError):
        capture.degraded_union(None, None)


def test_sessions(spark):
    rows = spark.sql("SELECT 1L stream, timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, s) ts FROM VALUES (0), (1), (10) t(s)")
    assert sorted(r.n for r in capture.sessions(rows, "3 seconds").collect()) == [1, 2]
