"""WAV files by ranges of bytes, committed writes, imports, folders of meetings."""

import json
import struct

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillspark.operators import imports, journals
from quillspark.sources import documents, wav, wav_source


def tone(n, step=0.01):
    return np.sin(np.arange(n) * step) * 0.5


def stereo(x, y, bits="<i2"):
    body = np.stack([x, y], 1).reshape(-1) * 32767
    body = body.astype(bits).tobytes()
    return b"RIFF\0\0\0\0WAVELIST\5\0\0\0abcde\0fmt " + struct.pack("<IHHIIHH", 16, 1, 2, 48000, 192000, 4, 16) + b"data" + struct.pack("<I", len(body)) + body


def test_a_split_file_gives_the_blocks_of_one_task(spark, tmp_path):
    (tmp_path / "a.wav").write_bytes(wav.encode_wav(tone(30000), 16000))
    (tmp_path / "b.WAV").write_bytes(stereo(tone(5001), tone(5001, 0.02)))
    (tmp_path / "bad.wav").write_bytes(b"RIFFxxxx")
    (tmp_path / "empty.wav").write_bytes(b"")
    (tmp_path / "torn.wav").write_bytes(wav.encode_wav(tone(4000), 8000)[:5001])
    whole = wav_source.read_wav(spark, str(tmp_path), block_samples=1000)
    split = wav_source.read_wav(spark, str(tmp_path), block_samples=1000, split_bytes=777)
    assert whole.rdd.getNumPartitions() == 1 and split.rdd.getNumPartitions() > 100
    rows = [sorted((r.path[-5:], r.block, r.start_sample, r.sample_rate, r.channels, tuple(r.samples)) for r in d.collect()) for d in (whole, split)]
    assert rows[0] == rows[1] and [(r[0], sum(1 for x in rows[0] if x[0] == r[0])) for r in rows[0] if r[1] == 0] == [("a.wav", 30), ("b.WAV", 6), ("n.wav", 3)]
    old = {(r.path[-5:], r.block): r.samples for r in wav.read_blocks(spark, str(tmp_path), 1000).collect() if r.path.endswith("a.wav")}
    assert all(list(r[5]) == old[r[0], r[1]] for r in rows[0] if r[0] == "a.wav")


def test_columns_that_are_not_wanted_are_not_decoded(spark, tmp_path, monkeypatch):
    (tmp_path / "a.wav").write_bytes(wav.encode_wav(tone(3000), 16000))
    heads = wav_source.read_wav(spark, str(tmp_path), "path string, sample_rate int, start_sample long", 1000)
    assert heads.columns == ["path", "sample_rate", "start_sample"] and sorted(r.start_sample for r in heads.collect()) == [0, 1000, 2000]
    monkeypatch.setattr(wav_source, "decode", None)
    reader = wav_source.WavReader(heads.schema, {"path": str(tmp_path), "blocksamples": "1000"})
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 3


def blocks(spark, files):
    return spark.createDataFrame([(p, i, 16000, [float(v) for v in x[i * 700 : i * 700 + 700]]) for p, x in files.items() for i in range(-(-len(x) // 700))], "path string, block long, sample_rate int, samples array<double>").repartition(5)


def test_files_are_written_whole_and_replaced_together(spark, tmp_path):
    out = tmp_path / "out"
    wav_source.save_wav(blocks(spark, {"m1/a.wav": tone(5000), "b.wav": tone(100)}), str(out))
    assert (out / "m1" / "a.wav").read_bytes() == wav.encode_wav(tone(5000), 16000) and (out / "b.wav").read_bytes() == wav.encode_wav(tone(100), 16000)
    with pytest.raises(Exception, match="exist"):
        wav_source.save_wav(blocks(spark, {"c.wav": tone(9), "b.wav": tone(50)}), str(out), overwrite=False)
    assert not (out / "c.wav").exists() and (out / "b.wav").stat().st_size == 244
    wav_source.save_wav(blocks(spark, {"b.wav": tone(50)}), str(out))
    assert (out / "b.wav").stat().st_size == 144 and sorted(p.name for p in out.rglob("*") if p.is_file()) == ["a.wav", "b.wav"]


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    out = tmp_path / "out"
    wav_source.save_wav(blocks(spark, {"a.wav": tone(50)}), str(out))
    rows = blocks(spark, {"a.wav": tone(5000), "z.wav": tone(5000)})
    rows = rows.withColumn("samples", F.when((F.col("path") == "z.wav") & (F.col("block") == 5), F.array(F.raise_error(F.lit("lost")).cast("double"))).otherwise(F.col("samples")))
    with pytest.raises(Exception, match="lost"):
        wav_source.save_wav(rows, str(out))
    assert [p.name for p in out.rglob("*") if p.is_file()] == ["a.wav"] and (out / "a.wav").stat().st_size == 144


def test_a_job_that_is_killed_leaves_the_old_file(tmp_path):
    out = tmp_path / "out"
    out.mkdir()
    (out / "a.wav").write_bytes(b"old")
    writer = wav_source.WavWriter({"path": str(out)}, True)
    batch = pa.RecordBatch.from_pylist([{"path": "a.wav", "block": 0, "sample_rate": 8000, "samples": [0.5]}])
    messages = [writer.write(iter([batch])), writer.write(iter([]))]
    assert (out / "a.wav").read_bytes() == b"old"
    writer.commit(messages)
    assert (out / "a.wav").read_bytes() == wav.encode_wav(np.array([0.5]), 8000) and [p.name for p in out.iterdir()] == ["a.wav"]


def test_files_beyond_32_bits_have_a_wider_head(tmp_path, monkeypatch):
    monkeypatch.setattr(wav_source, "LONGEST", 1000)
    out = wav_source.WavWriter({"path": str(tmp_path)}, True)
    batch = pa.RecordBatch.from_pylist([{"path": "a.wav", "block": i, "sample_rate": 8000, "samples": tone(300).tolist()} for i in range(3)])
    out.commit([out.write(iter([batch]))])
    data = (tmp_path / "a.wav").read_bytes()
    with open(tmp_path / "a.wav", "rb") as file:
        head = wav_source.head_of(file, len(data))
    assert data[:4] == b"RF64" and head["stop"] - head["start"] == 1800 == len(data) - 80


def test_import_reads_resamples_and_writes_in_one_job(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "talk.wav").write_bytes(stereo(tone(48000), tone(48000)))
    (src / "same.wav").write_bytes(wav.encode_wav(np.r_[tone(1000), 1.0], 16000))
    for name, content in (("x.mp3", b"1"), ("y.txt", b"1"), ("z.wav", b""), ("bad.wav", b"RIFF"), ("none.wav", wav.encode_wav(np.zeros(0), 16000))):
        (src / name).write_bytes(content)
    rows = {r.path.rsplit("/", 1)[1]: r for r in imports.import_audio(spark, str(src), str(tmp_path / "out"), block_samples=4096).collect()}
    assert {n: r.refusal for n, r in rows.items()} == {"talk.wav": None, "same.wav": None, "x.mp3": "undecodable", "y.txt": "unsupported", "z.wav": "empty", "bad.wav": "undecodable", "none.wav": "undecodable"}
    assert rows["talk.wav"].duration_seconds == 1.0 and abs(rows["talk.wav"].peak - 0.5) < 0.01 and not rows["talk.wav"].clipped
    assert rows["same.wav"].clipped and rows["same.wav"].duration_seconds == 1001 / 16000
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["same.wav", "talk.wav"]


def test_samples_of_another_rate_stop_the_job(spark, tmp_path):
    rows = blocks(spark, {"a.wav": tone(10)})
    assert imports.at_rate(rows).count() == 1 and len(imports.at_rate(rows).first().samples) == 10
    with pytest.raises(Exception, match="must be at 16000 Hz, not 8000"):
        imports.at_rate(rows.withColumn("sample_rate", F.lit(8000))).collect()


def test_folders_with_a_pending_journal(spark, tmp_path):
    line = lambda kind: json.dumps({"kind": kind, "at": "t"})
    for name, content in (("pending", [line("Header"), line("Progress")]), ("done", [line("Header"), line("Completed")]), ("torn", ['{"kind":"Hea']), ("torn_end", [line("Completed"), '{"kind":"Seg'])):
        (tmp_path / name).mkdir()
        (tmp_path / name / "journal.jsonl").write_text("\n".join(content))
        (tmp_path / name / "mic.wav").write_bytes(b"12")
    (tmp_path / "plain").mkdir()
    (tmp_path / "plain" / "metadata.json").write_text("{}")
    folders = imports.meeting_folders(spark, str(tmp_path))
    assert {(r.folder, r.files, r.has_journal, r.has_metadata, tuple(r.audio)) for r in folders.collect()} >= {("pending", 2, True, False, ("mic.wav",)), ("plain", 1, False, True, ())}
    states = journals.journal_states(documents.read_journals(spark, str(tmp_path)))
    assert sorted(r.folder for r in imports.pending_meetings(folders, states).collect()) == ["pending", "torn"]


def test_many_short_files_are_dealt_over_tasks_of_bounded_number(spark, tmp_path):
    """One task of the default size would open them all; tasks of a few bytes would be as many as the files."""
    for i in range(1500):
        (tmp_path / f"s{i}.wav").write_bytes(wav.encode_wav(tone(20), 16000))
    whole, split = wav_source.read_wav(spark, str(tmp_path)), wav_source.read_wav(spark, str(tmp_path), split_bytes=80)
    assert 1 < whole.rdd.getNumPartitions() <= 4 and split.rdd.getNumPartitions() <= 1.5 * wav_source.TASKS
    reader = wav_source.WavReader(whole.schema, {"path": str(tmp_path)})
    assert [sum(b.num_rows for b in reader.read(p)) for p in reader.partitions()][0] > 300 and all(len(list(reader.read(p))) == 1 for p in reader.partitions())
    assert whole.agg(F.count_distinct("path")).first()[0] == 1500 and whole.agg(F.sum(F.size("samples"))).first()[0] == 30000
