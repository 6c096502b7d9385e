"""Streams that end by the clock: what a batch over the same rows gives, without any row that marks the end."""

import time

import pytest
from pyspark.sql import functions as F
from test_streaming import drained, put, state_store  # noqa: F401

from quillspark.operators import levels, speech
from quillspark.streaming import capture, live

pytestmark = pytest.mark.usefixtures("state_store")


def at(ms):
    return f"2024-01-01T00:{ms // 60000:02d}:{ms // 1000 % 60:02d}.{ms % 1000:03d}Z"


def both(spark, folder, schema, live_of, batch_of, name):
    got = drained(live_of(capture.read_stream(spark, str(folder), schema, 1)), name, spark).collect()
    wanted = batch_of(spark.read.schema(schema).json(str(folder))).collect()
    return sorted(map(tuple, got), key=repr), sorted(map(tuple, wanted), key=repr)


def test_a_stream_that_dies_is_told_once(spark, tmp_path):
    rows = [(1, s) for s in (0, 1000, 2000)], [(2, s) for s in range(0, 6000, 500)], [(2, s) for s in range(6000, 9000, 500)] + [(1, 8000)], [(2, s) for s in range(9000, 20000, 500)]
    for n, part in enumerate(rows):
        put(tmp_path / "in", n, [{"stream": s, "ts": at(t)} for s, t in part])
    got, wanted = both(spark, tmp_path / "in", "stream long, ts timestamp", live.stall_events, live.stall_events, "stalls_by_clock")
    assert got == wanted and [(r[0], r[1], r[3]) for r in got] == [(1, "resumed", 6.0), (1, "stalled", 3.0), (1, "stalled", 3.0)]


def test_a_stall_is_told_by_the_wall_clock(spark, tmp_path):
    put(tmp_path / "in", 0, [{"stream": 1, "ts": at(0)}])
    rows = capture.read_stream(spark, str(tmp_path / "in"), "stream long, ts timestamp")
    query = live.stall_events(rows, 0.5, clock="ProcessingTime").writeStream.format("memory").queryName("wall").outputMode("append").trigger(processingTime="200 milliseconds").start()
    try:
        until = time.time() + 60
        while time.time() < until and spark.table("wall").count() == 0:
            time.sleep(0.5)
        time.sleep(2)
        assert [(r.stream, r.event) for r in spark.table("wall").collect()] == [(1, "stalled")]
    finally:
        query.stop()


def test_the_last_chunk_comes_without_a_mark(spark, tmp_path):
    db = [-70.0] * 60 + [-20.0] * 100 + [-70.0] * 300 + [-20.0] * 130
    frames = [(1, i, x) for i, x in enumerate(db)] + [(1, 1500 + i, -20.0) for i in range(80)] + [(2, i, -70.0) for i in range(2600)]
    frames.sort(key=lambda f: f[1])
    parts = [[f for f in frames if a <= f[1] < a + 217] for a in range(0, 2600, 217)]
    for n, part in enumerate(parts):
        put(tmp_path / "in", n, [{"meeting_id": m, "source": "Microphone", "frame": i, "db": x, "ts": at(i * 20)} for m, i, x in part])
    schema = "meeting_id long, source string, frame long, db double, ts timestamp"
    got, wanted = both(spark, tmp_path / "in", schema, live.idle_chunks, lambda d: speech.speech_chunks(d, idle=150), "idle_chunks")
    assert got == wanted and [(r[2], r[4]) for r in got if r[0] == 1] == [(0, 230), (1, 590), (2, 1580)]


def test_late_rows_leave_a_hole_and_the_end_is_drained(spark, tmp_path):
    epoch = 1_704_067_200_000 // 20
    row = lambda s, i, v=None: {"stream": s, "tick": epoch + i, "value": v if v is not None else i / 7, "ts": at(i * 20)}
    first = [row(1, i) for i in range(0, 40) if i not in (10, 11)] + [row(2, i) for i in range(5, 45)]
    second = [row(1, i) for i in range(40, 200)]
    late = [row(1, 10), row(1, 11)] + [row(1, i) for i in range(200, 205)]
    end = [{"stream": 0, "tick": None, "value": None, "ts": at(60_000)}]
    for n, part in enumerate((first, second, late, end)):
        put(tmp_path / "in", n, part)
    schema = "stream long, tick long, value double, ts timestamp"
    got = drained(live.live_timeline(capture.read_stream(spark, str(tmp_path / "in"), schema, 1)), "timeline", spark).collect()
    kept = spark.read.schema(schema).json(str(tmp_path / "in")).where(f"tick IS NOT NULL AND NOT (stream = 1 AND tick IN ({epoch + 10}, {epoch + 11}))")
    wanted = levels.gap_filled(kept.select("stream", (F.col("tick") * 20 + 5).alias("at"), "value"), 20).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, wanted)) and len(got) == 205 + 40
    assert [r.tick - epoch for r in got if r.inserted] == [10, 11]


def test_drift_drops_as_the_batch_does(spark, tmp_path):
    rows = [{"stream": s, "seq": i, "backlog": 300 + s * 150 + i % 7 * 10, "inserted": 5 if i == 60 else 0, "samples": [float(i)] * 20} for i in range(120) for s in (0, 1, 4)]
    for n in range(6):
        put(tmp_path / "in", n, [r for r in rows if r["seq"] // 20 == n])
    schema = "stream long, seq long, backlog long, inserted long, samples array<float>"
    drift = lambda d: live.without_drift(d, 1000, 1.0).select("stream", "seq", "dropped", F.size("samples"))
    batch = lambda d: levels.drift_corrections(d, 1000, 1.0).select("stream", "seq", "dropped", (20 - F.col("dropped")).cast("int"))
    got, wanted = both(spark, tmp_path / "in", schema, drift, batch, "drift")
    assert got == wanted and sum(r[2] for r in got) > 50 and sum(r[2] for r in got if r[0] == 0) == 0


def test_status_of_a_running_recording(spark, tmp_path):
    put(tmp_path / "in", 0, [{"samples": [0.0] * 160, "inserted": 16, "dropped": 0, "overruns": 0}] * 3)
    put(tmp_path / "in", 1, [{"samples": [0.0] * 160, "inserted": 0, "dropped": 32, "overruns": 1}])
    status = live.RecordingStatus("counts")
    spark.streams.addListener(status)
    try:
        rows = capture.read_stream(spark, str(tmp_path / "in"), "samples array<float>, inserted long, dropped long, overruns long", 1)
        drained(live.observed(rows, "counts"), "status", spark)
        until = time.time() + 30
        while time.time() < until and status.snapshot().elapsed_ms < 40:
            time.sleep(0.2)
        assert status.snapshot() == live.Status(40.0, 3.0, 2.0, 1, 1280)
    finally:
        spark.streams.removeListener(status)


def test_heartbeats_are_not_held():
    """Batches of heartbeats are let go as they come, however many there are."""
    import weakref

    import pandas as pd

    alive, most = weakref.WeakSet(), []

    class Batch(pd.DataFrame):
        __hash__ = object.__hash__
        __eq__ = object.__eq__

    def batches():
        for i in range(20):
            batch = Batch({"tick": [None if i != 7 else 3.0] * 5})
            alive.add(batch)
            most.append(len(alive))
            yield batch
            del batch

    assert len(live._came(batches(), "tick")) == 5 and max(most) <= 3
