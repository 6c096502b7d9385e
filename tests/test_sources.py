"""WAV files, journals, JSON documents, performance logs, settings, process trees."""

import json
import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.operators import journals, planning
from quillspark.sources import documents, perflog, wav


def test_wav_round_trip_over_blocks(spark, tmp_path):
    tone = np.sin(np.arange(5000) * 0.1) * 0.5
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.wav").write_bytes(wav.encode_wav(tone, 16000))
    (tmp_path / "in" / "bad.wav").write_bytes(b"RIFFxxxx")
    blocks = wav.read_blocks(spark, str(tmp_path / "in"), 2048)
    rows = blocks.orderBy("block").collect()
    assert [(r.block, r.start_sample, len(r.samples)) for r in rows] == [(0, 0, 2048), (1, 2048, 2048), (2, 4096, 904)]
    assert np.abs(np.concatenate([r.samples for r in rows]) - tone).max() < 1 / 32000
    assert wav.durations(blocks).first().duration_seconds == 5000 / 16000
    out = wav.write_wav(blocks, f"file://{tmp_path}/out").first()
    assert out.n_samples == 5000 and np.abs(np.concatenate([x for _, x in wav.mono_blocks((tmp_path / "out" / "a.wav").read_bytes())]) - tone).max() < 1 / 16000


@pytest.mark.parametrize("bits,raw,value", [(8, bytes([128 + 64]), 0.5), (16, struct.pack("<h", -16384), -0.5), (24, bytes([0, 0, 0xC0]), -0.5), (32, struct.pack("<i", 1 << 30), 0.5)])
def test_pcm_widths(bits, raw, value):
    assert wav.decode(raw, bits, False).tolist() == [value]


def test_truncated_and_extensible_files():
    head = struct.pack("<HHIIHH", wav.EXTENSIBLE, 2, 48000, 384000, 8, 32) + struct.pack("<HHIH14x", 22, 32, 3, wav.FLOAT)
    data = b"RIFF\0\0\0\0WAVEfmt " + struct.pack("<I", 40) + head + b"data" + struct.pack("<I", 10**6) + np.array([0.5, 0.25, -1, 1], "<f4").tobytes()
    assert wav.parse_head(data)["is_float"] and [x.tolist() for _, x in wav.mono_blocks(data)] == [[0.375, 0.0]]


def test_journal_with_torn_tail(spark, tmp_path):
    folder = tmp_path / "m1"
    folder.mkdir()
    entry = lambda i, kind, text: json.dumps({"kind": kind, "segment": {"id": f"s{i}", "startMs": 5000 - i * 1000, "text": text}})
    (folder / "journal.jsonl").write_text("\n".join(['{"kind":"Header","metadata":{"title":"t"}}', entry(1, "Segment", "a"), "", "nonsense", entry(2, "Segment", "b"), entry(1, "SegmentUpdate", "a2"), entry(3, "SegmentUpdate", "new"), '{"kind":"Progress","durationSeconds":12.5}', '{"kind":"Segment","segm']))
    entries = documents.read_journals(spark, str(tmp_path))
    assert [(r.segment_id, r.text) for r in journals.replayed(entries).orderBy("position").collect()] == [("s3", "new"), ("s2", "b"), ("s1", "a2")]
    state = journals.journal_states(entries).first()
    assert (state.meeting_id, state.last_kind, state.duration_seconds, state.recoverable) == ("m1", "Progress", 12.5, True)


def test_documents_are_null_where_broken(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"id": 3}')
    (tmp_path / "b.json").write_text("{")
    rows = {r.path[-6:]: r.doc for r in documents.read_documents(spark, str(tmp_path), "id int").collect()}
    assert rows["a.json"].id == 3 and (rows["b.json"] is None or rows["b.json"].id is None)


def test_manifest_upsert_ignores_case(spark):
    old = spark.createDataFrame([("A", 1), ("b", 1)], "id string, verified_at int")
    assert sorted(map(tuple, documents.upsert_manifest(old, spark.createDataFrame([("a", 2), ("A", 3)], old.schema)).collect())) == [("A", 3), ("b", 1)]


def test_performance_blocks_over_rolled_files(spark, tmp_path):
    (tmp_path / "app.1.log").write_text("x\nperf\n    a = 1\n    a = 2\nend\n    b = 3\n")
    (tmp_path / "app.log").write_text("perf\n    c   = x = y\n")
    lines = perflog.read_lines(spark, str(tmp_path)).withColumn("log", F.lit("app"))
    assert sorted((r.block, r.key, r.value) for r in perflog.blocks(lines, "perf").collect()) == [(1, "a", "1"), (2, "c", "x = y")]


def test_settings_count_values_of_their_type_only(spark):
    docs = [(1, '{"bitrate": 96, "keepAudio": "false"}'), (2, '{"version": 3, "mp3BitrateKbps": 96, "keepRecognitionAudio": false, "profile": {"mode": "Fast"}}'), (3, "not json")]
    rows = planning.migrated_settings(spark.createDataFrame(docs, "id int, doc string")).orderBy("id").collect()
    assert [tuple(r) for r in rows] == [(1, 1, 192, True, "Balanced"), (2, 3, 96, False, "Fast"), (3, 1, 192, True, "Balanced")]


def test_descendants(spark):
    tree = spark.createDataFrame([(2, 1), (3, 2), (4, 2), (5, 9)], "pid long, parent_pid long")
    assert sorted(r.pid for r in planning.descendants(tree, spark.createDataFrame([(1,)], "pid long")).collect()) == [1, 2, 3, 4]


def test_storage_rates(spark):
    rows = spark.createDataFrame([("mp3", 192, False, False, False, 1600000000), ("wav", 0, True, True, False, 1600000000)], "format string, mp3_kbps int, stt_enabled boolean, keep_audio boolean, delete_after boolean, free_bytes long")
    mp3, both = planning.storage(rows).collect()
    assert math.isclose(mp3.kept_mb_h, 86.4) and math.isclose(both.kept_mb_h, 576.0) and math.isclose(both.hours_that_fit, 1.6e9 / 5.76e8)


def test_documents_are_replaced_when_all_is_written(spark, tmp_path):
    path = str(tmp_path / "docs")
    documents.write_documents(spark.range(3).toDF("n"), path)
    broken = spark.range(3).select(F.when(F.col("id") == 2, F.raise_error(F.lit("lost")).cast("long")).otherwise(F.col("id")).alias("n"))
    with pytest.raises(Exception, match="lost"):
        documents.write_documents(broken, path)
    assert sorted(r.n for r in spark.read.json(path).collect()) == [0, 1, 2]
    documents.write_documents(spark.range(5, 7).toDF("n"), path)
    assert sorted(r.n for r in spark.read.json(path).collect()) == [5, 6] and [p.name for p in tmp_path.iterdir()] == ["docs"]
