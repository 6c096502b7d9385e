"""Filters, resampling, detection, chunking, speakers: against plain loops and stated properties."""

import math

import numpy as np
from pyspark.sql import functions as F

from quillspark.functions import audio as fa
from quillspark.operators import conversion, filters, levels, recurrence, samples, spectrum, speech

RNG = np.random.default_rng(3)


def loop(section, x):
    z1 = z2 = 0.0
    out = []
    for v in x:
        y = section.b[0] * v + z1
        z1, z2 = section.b[1] * v - section.a[0] * y + z2, section.b[2] * v - section.a[1] * y
        out.append(y)
    return np.array(out)


def test_sections_equal_the_recursion_whatever_the_blocks():
    x = RNG.standard_normal(1000)
    for section in (filters.Biquad.low_pass(48000, 7200), filters.Biquad.band_pass(16000, 1000, 2), filters.Biquad.high_shelf(48000, 3000, 6)):
        chain = filters.Chain([section])
        got = np.concatenate([chain(part) for part in np.split(x, [7, 100, 613])])
        assert np.abs(got - loop(section, x)).max() < 1e-12


def test_listening_eq_cannot_exceed_full_scale():
    eq = filters.listening_eq(48000)
    assert np.abs(eq(np.sign(RNG.standard_normal(20000)))).max() <= 1.0


def test_resampler_keeps_length_constants_and_block_seams():
    x = RNG.standard_normal(9600)
    for a, b in ((48000, 16000), (16000, 48000), (44100, 48000)):
        whole = filters.Resampler(a, b)(x)
        parts = filters.Resampler(a, b)
        got = np.concatenate([parts(p) for p in np.split(x, [1, 333, 5000])])
        assert len(got) == len(whole) and abs(len(whole) - 9600 * b / a) <= 2 and np.abs(got - whole).max() < 1e-9
    assert np.abs(filters.Resampler(16000, 48000)(np.full(100, 0.25)) - 0.25).max() < 1e-12


def test_streams_are_filtered_in_order_of_their_blocks(spark):
    x = RNG.standard_normal(300)
    rows = spark.createDataFrame([(s, b, x[b * 100 : b * 100 + 100].tolist()) for s in (1, 2) for b in (2, 0, 1)], "stream long, block long, samples array<double>")
    section = filters.Biquad.low_pass(16000, 1000)
    got = {(r.stream, r.block): r.samples for r in recurrence.filtered(rows, [section]).collect()}
    assert np.abs(np.concatenate([got[2, b] for b in range(3)]) - loop(section, x)).max() < 1e-12


def test_balance_finds_the_band_of_a_tone(spark):
    tone = (0.3 * np.sin(2 * np.pi * 3000 * np.arange(16000) / 16000)).tolist()
    rows = spark.createDataFrame([(1, i, i * 1001, tone[i * 1001 : i * 1001 + 1001]) for i in range(16)] + [(2, 0, 0, [0.0] * 320)], "stream long, block long, start_sample long, samples array<double>")
    found = {(r.stream, r.band): r.rms for r in spectrum.spectral_balance(rows, 16000).collect()}
    assert max((b for s, b in found if s == 1), key=lambda b: found[1, b]) == "consonant" and {v for (s, _), v in found.items() if s == 2} == {0.0}
    section = filters.bands_at(16000)["consonant"][0]
    y = loop(section, loop(section, np.array(tone)))
    assert abs(found[1, "consonant"] - math.sqrt((y * y).mean())) < 1e-9


def test_blocks_in_parallel_are_the_sequential_filter(spark, monkeypatch):
    monkeypatch.setattr(recurrence, "GROUP", 4)
    x = RNG.standard_normal(5000)
    cuts = [0, *sorted(RNG.choice(np.arange(1, 5000), 60, replace=False).tolist()), 5000]
    rows = spark.createDataFrame([(s, b, (x[i:j] * s).tolist()) for s in (1, 2) for b, (i, j) in enumerate(zip(cuts, cuts[1:], strict=False))], "stream long, block long, samples array<double>").repartition(7)
    whole = lambda d: {s: np.concatenate([r.samples for r in sorted((r for r in d.collect() if r.stream == s), key=lambda r: r.block)]) for s in (1, 2)}
    sections = [filters.Biquad.low_pass(16000, 1000), filters.Biquad.high_shelf(16000, 3000, 6)]
    got = whole(recurrence.filtered(rows, sections, 0.5))
    assert np.abs(got[1] - 0.5 * loop(sections[1], loop(sections[0], x))).max() < 1e-9 and np.abs(got[2] - 2 * got[1]).max() < 1e-9
    block = whole(recurrence.dc_blocked(rows, 16000))[1]
    y, r = [x[0]], 1 - 2 * math.pi * 20 / 16000
    for i in range(1, len(x)):
        y.append(x[i] - x[i - 1] + r * y[-1])
    assert np.abs(block - y).max() < 1e-9
    ema, v = [], x[0]
    for value in x:
        v += (value - v) * 0.1
        ema.append(v)
    assert np.abs(whole(recurrence.smoothed(rows, 0.1))[1] - ema).max() < 1e-9
    assert rows.join(recurrence.states(rows, recurrence.Bank([sections])), ["stream", "block"]).count() == 122


def in_blocks(spark, streams, lengths, extra=()):
    """A row for each block of ``lengths`` (the last one ends with the stream) of each of the streams."""
    rows = []
    for name, x in streams.items():
        for i, part in enumerate(np.split(x, np.cumsum(lengths))):
            rows.append((name, i, *[e[name] for e in extra], part.tolist()))
    columns = ["stream string", "block long", *["sample_rate int" for _ in extra], "samples array<double>"]
    return spark.createDataFrame(rows, ", ".join(columns)).repartition(7)


def joined(df):
    found = {}
    for r in sorted(df.collect(), key=lambda r: (r.stream, r.block)):
        found.setdefault(r.stream, []).extend(r.samples)
    return {name: np.array(x) for name, x in found.items()}


def test_streams_resampled_in_parallel_are_those_resampled_in_order(spark):
    lengths = [0, 1, 1, 0, 2, 333, 5, 400]  # empty blocks, and blocks shorter than what the interpolation looks back at
    rates = {"down": 48000, "up": 8000, "odd": 44100, "same": 16000}
    streams = {name: RNG.standard_normal(2000) for name in rates}
    got = joined(conversion.resampled_each(in_blocks(spark, streams, lengths, (rates,)), 16000))
    for name, rate in rates.items():
        wanted = filters.Resampler(rate, 16000)(streams[name])
        assert len(got[name]) == len(wanted) and np.abs(got[name] - wanted).max() < 1e-9
    for a, b in ((32000, 16000), (16000, 48000)):
        wanted, one = filters.Resampler(a, b)(streams["up"]), {"up": streams["up"]}
        assert np.abs(joined(conversion.resampled(in_blocks(spark, one, lengths), a, b))["up"] - wanted).max() < 1e-9
    nothing = in_blocks(spark, streams, lengths, (rates,)).where("false")
    assert conversion.resampled_each(nothing, 16000).count() == conversion.resampled(nothing, 16000, 8000).count() == 0
    null = spark.sql("SELECT 'a' AS stream, 0L AS block, 48000 AS sample_rate, cast(null AS array<double>) AS samples")
    assert [r.samples for r in conversion.resampled_each(null, 16000).collect()] == [[]]


def test_streams_downmixed_in_parallel_are_those_downmixed_in_order(spark):
    x = RNG.standard_normal(4000) * 0.1
    pairs = lambda a, b: np.stack([a, b], axis=1).reshape(-1)
    streams = {"against": pairs(x, -x), "together": pairs(x, x), "quiet first": pairs(np.r_[x[:1500] * 1e-3, x[1500:]], -np.r_[x[:1500] * 1e-3, x[1500:]])}
    lengths = [0, 7, 1001, 992, 1000, 1000, 1000, 0, 1000]
    got = joined(conversion.adaptively_downmixed(in_blocks(spark, streams, lengths), 2, 2000))
    for name, y in streams.items():
        mix = filters.Downmixer(2, 2000)
        wanted = np.concatenate([mix(p) for p in np.split(y, np.cumsum(lengths))])
        assert len(got[name]) == len(wanted) and np.abs(got[name] - wanted).max() < 1e-12
    assert np.abs(got["against"]).max() > 0 and not np.allclose(got["against"], 0)
    assert conversion.adaptively_downmixed(in_blocks(spark, streams, lengths).where("false"), 2, 2000).count() == 0


def test_downmix_leaves_cancelling_channels():
    x = RNG.standard_normal(16000) * 0.1
    mix = filters.Downmixer(2, 16000)
    against = np.stack([x, -x], axis=1).reshape(-1)
    assert np.abs(mix(against)).max() == 0 and np.array_equal(mix(against), x)
    together = filters.Downmixer(2, 16000)
    assert np.allclose(together(np.repeat(x, 2)), x) and not together.first_only


def test_array_functions(spark):
    row = spark.sql("SELECT array(0.5D, -1.5D, 0.25D) x, array(1D, 2D) y, array(0.1D, 0.3D, 0.5D, 0.7D, 9D) z, true m")
    out = row.select(fa.rms(F.col("x")), fa.peak(F.col("x")), fa.quantised(F.col("x")), samples.mixed(F.col("x"), F.col("y"), 0.0), samples.downmixed(F.col("z"), 2), samples.muted(F.col("y"), F.col("m"))).first()
    assert math.isclose(out[0], math.sqrt((0.25 + 2.25 + 0.0625) / 3)) and out[1] == 1.5 and out[2] == [16384, -32767, 8192] and out[3] == [1.5, 0.5, 0.25]
    assert np.allclose(out[4], [0.2, 0.6]) and out[5] == [0, 0]


def test_empty_blocks(spark):
    row = spark.sql("SELECT cast(array() AS array<double>) x").select(fa.rms(F.col("x")), fa.peak(F.col("x")), samples.downmixed(F.col("x"), 2), fa.to_db(fa.rms(F.col("x")))).first()
    assert tuple(row) == (0.0, 0.0, [], -120.0)


def db_frames(*parts):
    return [db for db, n in parts for _ in range(n)]


def chunks(frames, pauses=speech.Pauses()):
    machine = speech.Chunker(pauses)
    return [c for c in [*map(machine.feed, frames), machine.end()] if c]


def test_short_utterance_is_one_chunk_with_pre_roll():
    (found,) = chunks(db_frames((-70, 100), (-20, 9), (-70, 300)))
    assert found[0] == 101 - 15 and found[1] > 109


def test_chunks_fill_over_pauses_and_split_when_too_long():
    packed = chunks(db_frames((-70, 50), *[x for _ in range(100) for x in ((-20, 200), (-70, 100))]))
    assert len(packed) < 40 and all(stop - start <= 1350 for start, stop in packed)
    long = chunks(db_frames((-70, 50), (-20, 3000)))
    assert [b[0] - a[1] for a, b in zip(long, long[1:])] == [-10] * (len(long) - 1)


def test_carried_silence_ends_a_chunk_and_is_trimmed():
    (a, b) = chunks(db_frames((-70, 50), (-20, 150), (-70, 6000), (-20, 150), (-70, 20)))
    assert a[1] - a[0] < 500 and b[0] > 6000


def test_detector_walks_each_stream_over_batches(spark):
    db = {m: [None if i % 97 == 5 else float(x) for i, x in enumerate(np.round(RNG.uniform(-80, -10, 400), 3))] for m in (1, 2, 3)}
    rows = spark.createDataFrame([(m, i + 1, x) for m in db for i, x in enumerate(db[m])], "stream long, seq long, db double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        got = levels.voice_activity(rows).orderBy("stream", "seq").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    wanted = []
    for m in db:
        detector = levels.VoiceDetector()
        wanted += [(m, i + 1, detector(x), detector.noise) for i, x in enumerate(db[m])]
    assert [(r.stream, r.seq, r.speech, r.noise_db) for r in got] == wanted


def test_speech_chunks_go_stream_by_stream(spark):
    frames = db_frames((-70, 60), (-20, 100), (-70, 300), (-20, 30))
    rows = [(m, s, i, float(x)) for m in (1, 2) for s in ("Microphone", "SystemAudio") for i, x in enumerate(frames)]
    found = speech.speech_chunks(spark.createDataFrame(rows, "meeting_id long, source string, frame long, db double"))
    by_stream = {}
    for r in found.orderBy("seq").collect():
        by_stream.setdefault((r.meeting_id, r.source), []).append((r.first_frame, r.end_frame))
    assert set(map(tuple, by_stream.values())) == {tuple(chunks(frames))} and len(by_stream) == 4
    assert speech.run_totals(found).count() == 4


def test_frames_over_block_seams(spark):
    x = RNG.standard_normal(1000).astype(np.float32)
    rows = spark.createDataFrame([(1, "Microphone", 0, 0, x[:500].tolist()), (1, "Microphone", 1, 500, x[500:].tolist())], "meeting_id long, source string, block long, start_sample long, samples array<float>")
    got = [r.db for r in speech.frame_levels(rows).orderBy("frame").collect()]
    assert np.allclose(got, [20 * math.log10(math.sqrt(np.mean(x[i * 320 : i * 320 + 320].astype(float) ** 2))) for i in range(3)])


def voice(pitch, formants, seconds=1.0):
    t = np.arange(int(16000 * seconds)) / 16000
    return sum(np.sin(2 * np.pi * pitch * k * t) / k * sum(math.exp(-(((pitch * k - f) / 150) ** 2)) + 0.02 for f in formants) for k in range(1, 30)) * 0.1


def test_two_voices_are_two_clusters():
    clusters = speech.SpeakerClusters()
    prints = [speech.voice_print(voice(p, f) + RNG.standard_normal(16000) * 1e-4) for p, f in ((110, (700, 1200)), (210, (450, 2400))) * 3]
    found = [clusters(p) for p in prints]
    assert len(set(found[0::2])) == 1 and (len(set(found)) == 2 or float(prints[0] @ prints[1]) >= 0.82)
    assert speech.voice_print(np.zeros(16000)) is None and speech.voice_print(voice(110, (700,), 0.3)) is None


def test_cluster_budget_absorbs_the_rest():
    clusters = speech.SpeakerClusters(most=3)
    assert [clusters(np.eye(8)[i]) for i in range(6)][:3] == [0, 1, 2] and len(clusters.centroids) == 3


def test_speaker_clusters_by_stream(spark):
    e = np.eye(3).tolist()
    rows = spark.createDataFrame([(s, i, v) for s in (0, 1) for i, v in enumerate([e[0], e[1], e[0], None, e[1]])], "stream long, seq long, vector array<double>")
    found = {(r.stream, r.seq): r.cluster for r in speech.speaker_clusters(rows).collect()}
    assert [found[1, i] for i in range(5)] == [0, 1, 0, None, 1]


def test_recogniser_seam(spark):
    rows = spark.createDataFrame([(1, "Microphone", i, i * 2000, [0.1] * 320) for i in range(3)], "meeting_id long, source string, seq long, start_ms long, samples array<float>")
    make = lambda: lambda x, n: [(0, len(x) * 1000 // 16000, f" chunk-{n} ", 0.9), (0, 1, "  ", 0.1)]
    found = [(r.start_ms, r.end_ms, r.text) for r in speech.recognised(rows, make).orderBy("seq").collect()]
    assert found == [(0, 1000, "chunk-0"), (2000, 3000, "chunk-1"), (4000, 5000, "chunk-2")]


def test_cepstra_shape_and_fft():
    assert speech.cepstra(voice(110, (700,))).shape == (98, 13) and speech.mel_bank().shape == (26, 257)


def test_drift_is_corrected_only_when_it_lasts(spark):
    rows = spark.createDataFrame([(1, i, 16000) for i in range(400)] + [(2, i, 1000) for i in range(400)], "stream long, seq long, backlog long")
    found = {(r.stream, r.seq): r.dropped for r in levels.drift_corrections(rows, 16000, 0.02).collect()}
    assert found[1, 100] == 0 and found[1, 399] == 16 and found[2, 399] == 0


def test_a_duller_microphone_is_told(spark):
    kind = "meeting_id long, band string, rms double, relative_db double"
    bands = lambda m, top, first=0.0: [(m, "low-mid", 0.1, first), (m, "sibilance", 0.01, top)]
    mic = spark.createDataFrame(bands(1, -30.0) + bands(2, -20.0) + bands(3, -120.0, -120.0) + bands(4, -40.0), kind)
    system = spark.createDataFrame(bands(1, -12.5) + bands(2, -15.0) + bands(3, -10.0), kind)
    rows = spectrum.tilt_differences(mic, system, 16000).collect()
    assert [(r.meeting_id, r.difference_db) for r in rows] == [(1, 17.5)] and "PC内部音声より 18 dB 少なく" in rows[0].message


def test_spans_meet_the_blocks_they_touch(spark):
    x = [float(i) for i in range(100)]
    blocks = spark.createDataFrame([(1, b, x[b * 30 : b * 30 + 30]) for b in range(4)], "stream long, block long, samples array<double>")
    wanted = spark.createDataFrame([(1, 0, 2500, 6200), (1, 1, 0, 200), (1, 2, 9000, 20000), (1, 3, 5000, 4000), (2, 4, 0, 9000), (1, 5, -500, 1000)], "stream long, span long, start_ms long, end_ms long")
    got = {r.span: r.samples for r in samples.spans(blocks, wanted, 10, 30).collect()}
    assert got == {0: x[25:62], 1: x[:2], 2: x[90:], 5: x[:10]}


def test_many_short_streams_cost_rows_and_not_calls(spark, monkeypatch):
    """Streams of a few unequal blocks, one of them empty, a stream whose first block is empty, another longer than a group: all in order, without a call for each stream."""
    monkeypatch.setattr(recurrence, "GROUP", 3)
    monkeypatch.setattr(recurrence, "HELD", 50)
    streams = {s: [RNG.standard_normal(n) for n in ([7, 0, 3 + s % 5] if s % 2 else [0, 64 + s, 5, 1, 9, 2, 70])] for s in range(60)}
    rows = spark.createDataFrame([(s, b, x.tolist()) for s, parts in streams.items() for b, x in enumerate(parts)], "stream long, block long, samples array<double>").repartition(3)
    section = filters.Biquad.low_pass(16000, 1000)
    found = recurrence.filtered(rows, [section])
    assert "Groups" not in found._jdf.queryExecution().executedPlan().toString()
    got = {(r.stream, r.block): r.samples for r in found.collect()}
    for s, parts in streams.items():
        assert [len(got[s, b]) for b in range(len(parts))] == [len(x) for x in parts]
        assert np.abs(np.concatenate([got[s, b] for b in range(len(parts))]) - loop(section, np.concatenate(parts))).max() < 1e-12
    first = {(r.stream, r.block): r.samples for r in recurrence.smoothed(rows, 0.1).collect()}
    assert all(abs(first[s, s % 2 == 0][0] - np.concatenate(parts)[0]) < 1e-12 for s, parts in streams.items())
