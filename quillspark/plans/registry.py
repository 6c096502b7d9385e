"""Collects the queries of the library and the DuckDB SQL that each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import audio as fa
from quillspark.functions import text as ft
from quillspark.operators import conversion, filters, journals, levels, minutes, planning, recurrence, responses, runs, samples, spectrum, speech, transcript
from quillspark.sources import documents, perflog, wav

from . import adapters as ad
from . import file_queries, live_queries, oracles, seam_queries

Query = Callable[[SparkSession, str], DataFrame]
CUES = ad.PROSE_CUES


def _sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minutes.meeting_sentences(ad.segments(spark, sf_dir), CUES)


def transcript_timeline(spark, sf_dir):
    return transcript.timeline(ad.segments(spark, sf_dir))


def transcript_sentences(spark, sf_dir):
    return _sentences(spark, sf_dir).withColumn("pos", F.col("pos").cast("long"))


def cue_sentences(spark, sf_dir):
    tested = {c: F.col("text").rlike(getattr(CUES, c)).alias(f"is_{c}") for c in ("decision", "action", "open")}
    return _sentences(spark, sf_dir).select("meeting_id", "arrival_seq", F.col("pos").cast("long").alias("pos"), *tested.values(), ft.due_date(F.col("text"), CUES).alias("due"))


def minutes_items(spark, sf_dir):
    return minutes.minutes_items(_sentences(spark, sf_dir), CUES)


def minutes_topics(spark, sf_dir):
    return minutes.topics(_sentences(spark, sf_dir))


def minutes_overview(spark, sf_dir):
    segments = ad.segments(spark, sf_dir)
    return minutes.overview(segments, minutes.meeting_sentences(segments, CUES))


def minutes_markdown(spark, sf_dir):
    return minutes.rendered(ad.segments(spark, sf_dir), _meetings(spark, sf_dir), CUES)


def transcript_text(spark, sf_dir):
    return transcript.exported_text(ad.segments(spark, sf_dir), _meetings(spark, sf_dir))


def transcript_markdown(spark, sf_dir):
    return transcript.exported_markdown(ad.segments(spark, sf_dir), _meetings(spark, sf_dir))


def speaker_carry_over(spark, sf_dir):
    out = transcript.carry_over_names(ad.segments(spark, sf_dir), ad.previous_segments(spark, sf_dir))
    return out.select("meeting_id", "id", "source", "speaker_id", "speaker_name")


def _names(spark, sf_dir):
    """A name for every speaker with an even number, of meetings with an even number."""
    rows = ad.segments(spark, sf_dir).where("speaker_id % 2 = 0 AND meeting_id % 2 = 0").select("meeting_id", "source", "speaker_id").distinct()
    return rows.withColumn("name", F.concat_ws(" ", F.lit("Name"), "meeting_id", "speaker_id"))


def speaker_list(spark, sf_dir):
    return transcript.speakers(ad.segments(spark, sf_dir), _names(spark, sf_dir))


def speaker_names_known(spark, sf_dir):
    return transcript.with_known_names(ad.segments(spark, sf_dir), _names(spark, sf_dir)).select("meeting_id", "id", "speaker_name")


def speaker_rename_counts(spark, sf_dir):
    return transcript.rename_counts(ad.segments(spark, sf_dir), _names(spark, sf_dir))


def segment_edits(spark, sf_dir):
    rows = ad.segments(spark, sf_dir)
    edits = rows.where("arrival_seq % 3 = 1").select("meeting_id", "id", F.concat(F.lit("edited "), "text").alias("new_text"))
    removed = rows.where("arrival_seq = 4")
    return transcript.without(transcript.edited(rows, edits), removed).select("meeting_id", "id", "text", "is_edited")


def segment_upserts(spark, sf_dir):
    rows = ad.segments(spark, sf_dir).select("meeting_id", "id", "text")
    new = rows.where("meeting_id % 2 = 0").withColumn("text", F.lit("replaced"))
    added = rows.where("meeting_id % 5 = 0").withColumn("id", F.concat("id", F.lit("-new")))
    return transcript.upserted(rows, new.unionByName(added), ["meeting_id", "id"])


def segments_added(spark, sf_dir):
    """What people typed, and copies of the turns of some meetings, after what was there; with the lines they leave in the journal."""
    rows, names = ad.segments(spark, sf_dir), _names(spark, sf_dir)
    typed = transcript.manual(rows.where("arrival_seq = 1").select("meeting_id", F.concat("id", F.lit("-typed")).alias("id"), (F.col("start_ms") + 5).alias("start_ms"), "source", F.lit("typed").alias("text"), F.lit(0).cast("long").alias("arrival_seq")))
    copies = rows.where("meeting_id % 3 = 0").withColumn("id", F.concat("id", F.lit("-copy")))
    out = transcript.added(rows, typed.unionByName(copies), names)
    return out.join(transcript.journal_of(out.where("id LIKE '%-%-%'")), ["meeting_id", "id"], "left").select("meeting_id", "id", "start_ms", "end_ms", "speaker_name", "text", "is_edited", F.col("arrival_seq").cast("long").alias("arrival_seq"), "line")


def segments_replaced(spark, sf_dir):
    rows = ad.segments(spark, sf_dir)
    new = rows.where("meeting_id % 4 = 0 AND arrival_seq % 2 = 0").withColumn("text", F.lit("new"))
    return transcript.replaced(rows, new, _names(spark, sf_dir)).select("meeting_id", "id", "speaker_name", "text", F.col("arrival_seq").cast("long").alias("arrival_seq"))


def segment_removals(spark, sf_dir):
    rows = ad.segments(spark, sf_dir)
    return transcript.removal_entries(rows, rows.where("arrival_seq % 3 = 2"))


def leg_clipping_counts(spark, sf_dir):
    e = F.col("event_id")
    rows = ad.table(spark, sf_dir, "events").select((e % 97).alias("meeting_id"), F.when(F.col("event_type").isin("click", "view"), "Microphone").otherwise("SystemAudio").alias("source"), (F.col("value") / 480 - 0.01).alias("value"))
    return levels.leg_clipping(rows).withColumn("worst_fraction", F.round("worst_fraction", 9))


def capture_probe_levels(spark, sf_dir):
    rows = levels.capture_probe(ad.levels(spark, sf_dir), 864000.0)
    return rows.select("stream", "samples", F.round("peak_db", 6).alias("peak_db"), F.round("rms_db", 6).alias("rms_db"))


def minutes_metrics_blocks(spark, sf_dir):
    """Orders as runs and their lines as inferences."""
    o = F.col("o_orderkey")
    made = ad.table(spark, sf_dir, "orders").select(o.alias("run_id"), (o % 9000).alias("transcript_tokens"), F.lit(4096).alias("context_tokens"), (o % 4 + 1).alias("blocks"), (o % 100 / 50.0).alias("load_seconds"), (o % 1000 / 20.0).alias("total_seconds"), F.col("o_orderpriority").alias("strategy"))
    line = ad.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.when(F.col("l_linenumber") == 1, "reduce").otherwise("map").alias("phase"), (F.col("l_partkey") % 500).alias("prompt_tokens"), F.col("l_quantity").cast("long").alias("output_tokens"), (F.col("l_suppkey") % 64 / 20.0).alias("seconds"))
    return runs.minutes_block(runs.minutes_metrics(made, line))


def journal_replay(spark, sf_dir):
    return journals.replayed(ad.journal(spark, sf_dir))


def journal_states(spark, sf_dir):
    return journals.journal_states(ad.journal(spark, sf_dir))


def journal_recovery(spark, sf_dir):
    entries = ad.journal(spark, sf_dir)
    audio = entries.where("meeting_id % 2 = 0").groupBy("meeting_id").agg((F.max("line_no") % 100).cast("double").alias("audio_seconds"))
    return journals.recovered(journals.journal_states(entries), audio).select("meeting_id", "n_segments", "duration_seconds", F.array_join("warnings", "|").alias("warnings"))


def response_sections(spark, sf_dir):
    return responses.sections(ad.lines(spark, sf_dir))


def response_markers(spark, sf_dir):
    return responses.recognised(ad.lines(spark, sf_dir))


def prompt_plan(spark, sf_dir):
    return responses.plan(ad.lines(spark, sf_dir), prompt_tokens=400, output_tokens=700, context_tokens=4096)


def prompt_blocks(spark, sf_dir):
    return responses.packed(ad.lines(spark, sf_dir), block_budget=500).groupBy("response_id", "block").agg(F.min("ord").alias("first_ord"), F.count("*").alias("n_lines"), F.sum("tokens").alias("tokens"))


def prompt_prefix(spark, sf_dir):
    return responses.prefix_within(ad.lines(spark, sf_dir), 800).select("response_id", "ord", "so_far")


def block_time_ranges(spark, sf_dir):
    rows = ad.segments(spark, sf_dir)
    text = transcript.said(rows)
    return text.select("meeting_id", ft.block_time_range(F.col("text")).alias("time_range"))


def level_statistics(spark, sf_dir):
    out = levels.statistics(ad.levels(spark, sf_dir))
    return out.select("stream", "n", F.round("rms", 9).alias("rms"), F.round("peak", 9).alias("peak"), F.round("rms_db", 6).alias("rms_db"), F.round("peak_db", 6).alias("peak_db"), "n_clipped", "clipped", "looks_silent")


def level_peak_hold(spark, sf_dir):
    # at one level a minute, so that peaks fall into each other
    rows = ad.levels(spark, sf_dir).withColumn("at", F.col("at") / 36000.0)
    return levels.peak_hold(rows).withColumn("held", F.round("held", 6))


def level_voice_activity(spark, sf_dir):
    return levels.voice_activity(ad.levels(spark, sf_dir), onset=2, hangover=3).withColumn("noise_db", F.round("noise_db", 6))


def level_smoothed(spark, sf_dir):
    return recurrence.smoothed_levels(ad.levels(spark, sf_dir), 0.1, 32).withColumn("last", F.round("last", 9))


def level_meters(spark, sf_dir):
    rows = ad.levels(spark, sf_dir).select("stream", "seq", (F.col("at") / 36000.0).alias("at"), (F.col("db") - 6).alias("rms_db"), F.col("db").alias("peak_db"))
    return levels.meters(rows).select("stream", "seq", *[F.round(c, 6).alias(c) for c in ("rms", "peak", "hold")])


def level_stalls(spark, sf_dir):
    return levels.stalls(ad.levels(spark, sf_dir), 36000.0).withColumn("gap_seconds", F.round("gap_seconds", 3))


def level_silence_runs(spark, sf_dir):
    return levels.silence_runs(ad.levels(spark, sf_dir), -30.0)


def level_gap_filled(spark, sf_dir):
    out = levels.gap_filled(ad.levels(spark, sf_dir), 86400)
    return out.withColumn("value", F.round("value", 6))


def level_inserted_share(spark, sf_dir):
    return levels.inserted_share(levels.gap_filled(ad.levels(spark, sf_dir), 86400)).withColumn("share", F.round("share", 9))


def sample_dc_block(spark, sf_dir):
    return _samples_of(recurrence.dc_blocked(ad.short_blocks(spark, sf_dir), 16000), 32)


def sample_mix(spark, sf_dir):
    rows = ad.short_blocks(spark, sf_dir)
    leg = lambda who: rows.where(f"stream % 2 = {who}").select(F.expr("stream div 2").alias("meeting_id"), "block", "samples")
    return _samples_of(samples.aligned_mix(leg(0), leg(1)).withColumnRenamed("meeting_id", "stream"), 32).withColumnRenamed("stream", "meeting_id")


def sample_downmix(spark, sf_dir):
    return _samples_of(ad.short_blocks(spark, sf_dir).withColumn("samples", samples.downmixed(F.col("samples"), 2)), 16)


def sample_normalised(spark, sf_dir):
    return _samples_of(samples.normalised(ad.short_blocks(spark, sf_dir)), 32)


def sample_quantised(spark, sf_dir):
    rows = ad.short_blocks(spark, sf_dir).withColumn("samples", fa.quantised(F.col("samples")))
    return _samples_of(rows, 32).withColumn("y", F.col("y").cast("long"))


def sample_interpolated(spark, sf_dir):
    """The cubic half way between each two samples of a stream."""
    from pyspark.sql import Window

    order = Window.partitionBy("stream").orderBy("seq")
    v = F.col("value")
    near = [F.coalesce(F.lag("value", 1).over(order), v), v, F.coalesce(F.lead("value", 1).over(order), v), F.coalesce(F.lead("value", 2).over(order), F.lead("value", 1).over(order), v)]
    return ad.levels(spark, sf_dir).select("stream", "seq", F.round(fa.catmull_rom(*near, F.lit(0.5)), 9).alias("y"))


def vector_cosines(spark, sf_dir):
    """Each vector with the next one of its label."""
    from pyspark.sql import Window

    rows = ad.table(spark, sf_dir, "embeddings").select("vec_id", "label", fa.unit(F.col("embedding")).alias("u"))
    following = F.lead("u").over(Window.partitionBy("label").orderBy("vec_id"))
    return rows.withColumn("v", following).where("v IS NOT NULL").select("vec_id", "label", F.round(fa.dot(F.col("u"), F.col("v")), 6).alias("cosine"))


def vector_statistics(spark, sf_dir):
    """Mean and deviation of each component for each label."""
    rows = ad.table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    return rows.groupBy("label", F.col("i").cast("long").alias("i")).agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"), F.round(F.stddev_pop(F.col("x").cast("double")), 6).alias("deviation"))


def vector_speaker_clusters(spark, sf_dir):
    rows = ad.table(spark, sf_dir, "embeddings")
    # streams of bounded length: a stream is walked in one task
    stream = F.col("label").cast("long") * 1_000_000_000 + F.floor(F.col("vec_id") / 1000)
    return speech.speaker_clusters(rows.select(stream.cast("long").alias("stream"), F.col("vec_id").alias("seq"), F.col("embedding").alias("vector")), similarity=0.3)


def speech_chunks(spark, sf_dir):
    rows = ad.levels(spark, sf_dir).select(F.col("stream").alias("meeting_id"), F.lit("Microphone").alias("source"), (F.col("seq") - 1).alias("frame"), (F.col("db") - 20).alias("db"))
    return speech.speech_chunks(rows, speech.Pauses(pre_roll=2, flush=3, carried=6, least=3, target=8, most=16, overlap=2))


def model_choice(spark, sf_dir):
    machines = ad.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("machine_id"), (F.col("c_custkey") % 16 + 1).cast("int").alias("cores"), (F.col("c_custkey") % 33).cast("double").alias("ram_gb"), ((F.col("c_custkey") % 97) / 20.0).alias("score"))
    return planning.chosen_models(machines, planning.catalog(spark)).withColumn("factor", F.round("factor", 9))


def model_lookups(spark, sf_dir):
    """Customers ask for models by ids of any case, and some for none there is."""
    c = F.col("c_custkey")
    models = planning.models_for(["speech", "text"], planning.catalog(spark))
    asked = F.element_at(F.array(*[F.lit(x) for x in ("WHISPER-TINY-Q5_1", "whisper-small-q5_1", "Whisper-Base-q5_1", "no-such")]), (c % 4 + 1).cast("int"))
    requests = ad.table(spark, sf_dir, "customer").select(c.alias("request_id"), asked.alias("wanted"), (c % 4 < 2).alias("required"))
    return planning.found_models(requests, models)


def diarizer_settings(spark, sf_dir):
    o = F.col("o_orderkey")
    profile = F.element_at(F.array(*[F.lit(x) for x in ("Fast", "Balanced", "Accurate")]), (o % 3 + 1).cast("int"))
    rows = ad.table(spark, sf_dir, "orders").select(o.alias("run_id"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus") == "O").alias("machine_diarizes"), (F.col("o_totalprice") > 100000).alias("diarization"), profile.alias("profile"))
    return planning.with_diarizer(rows).select("run_id", "diarizer")


def meeting_abilities(spark, sf_dir):
    """Orders as meetings; their lines name working files."""
    name = F.element_at(F.array(*[F.lit(x) for x in ("Mic.wav", "imported.wav", "notes.txt", "system.wav", "x.txt", "y.txt", "z.txt")]), F.col("l_linenumber"))
    files = ad.table(spark, sf_dir, "lineitem").where("l_quantity < 10").select((F.col("l_orderkey")).alias("meeting_id"), name.alias("name"))
    meetings = ad.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("meeting_id"), (F.col("o_orderpriority") == "1-URGENT").alias("is_imported"))
    return runs.meeting_abilities(meetings, files)


def smoothing_coefficients(spark, sf_dir):
    e = ad.table(spark, sf_dir, "events").select("event_id", (F.col("value") - 10).alias("ms"), F.when(F.col("event_type") == "error", 0).otherwise(16000).alias("rate"))
    return e.select("event_id", F.round(fa.smoothing_of(F.col("ms"), F.col("rate")), 9).alias("coefficient"))


def storage_footprint(spark, sf_dir):
    c = F.col("c_custkey")
    settings = ad.table(spark, sf_dir, "customer").select(c.alias("setting_id"), F.when(c % 2 == 0, "mp3").otherwise("wav").alias("format"), (96 + c % 4 * 32).alias("mp3_kbps"), (c % 3 != 0).alias("stt_enabled"), (c % 5 != 0).alias("keep_audio"), (c % 7 == 0).alias("delete_after"), (c * 1000000).alias("free_bytes"))
    return planning.storage(settings).select("setting_id", "recording_bytes_s", F.round("kept_mb_h", 6).alias("kept_mb_h"), F.round("hours_that_fit", 9).alias("hours_that_fit"))


def preflight_overall(spark, sf_dir):
    c = F.col("s_suppkey")
    machines = ad.table(spark, sf_dir, "supplier").select(c.alias("report_id"), (c * (100 << 20)).alias("free_bytes"), (c % 11 != 0).alias("writable"), (c % 7).alias("n_inputs"), (c % 3 == 0).alias("has_model"))
    return planning.overall(planning.preflight(machines))


def folder_names(spark, sf_dir):
    orders = ad.table(spark, sf_dir, "orders")
    rows = orders.select(F.col("o_orderkey").alias("created_seq"), ft.folder_name(F.col("o_orderdate"), F.concat_ws(" / ", "o_orderpriority", F.lit("a|b"))).alias("base"))
    return planning.unique_names(rows)


def perf_log_fields(spark, sf_dir):
    """Events as log lines: a purchase is a header, clicks are plain lines, the rest are fields."""
    rows = ad.table(spark, sf_dir, "events")
    field = F.concat(F.lit("    "), F.col("event_type"), F.lit(" = "), (F.col("event_id") % 13).cast("string"))
    line = F.when(F.col("event_type") == "purchase", F.lit("== performance ==")).when((F.col("event_type") == "click") & (F.col("event_id") % 3 == 0), F.lit("plain")).otherwise(field)
    lines = rows.select(F.col("user_id").alias("log"), F.lit(0).alias("ordinal"), F.col("event_id").alias("line_no"), line.alias("line"))
    return perflog.blocks(lines, "== performance ==")


def settings_migrated(spark, sf_dir):
    rows = ad.table(spark, sf_dir, "events")
    k = F.col("event_id")
    doc = F.concat(F.lit('{"version": '), (k % 3).cast("string"), F.when(k % 2 == 0, F.lit(', "bitrate": 96')).otherwise(F.lit(', "mp3BitrateKbps": 128')), F.when(k % 5 == 0, F.lit(', "keepAudio": "true"')).when(k % 5 == 1, F.lit(', "keepAudio": false')).otherwise(F.lit("")), F.when(k % 7 == 0, F.lit(', "profile": {"mode": "Fast"}')).otherwise(F.lit(', "mode": "Accurate"')), F.when(k % 11 == 0, F.lit("")).otherwise(F.lit("}")))
    return planning.migrated_settings(rows.select(k.alias("id"), doc.alias("doc")))


def meeting_totals(spark, sf_dir):
    """Durations are the longest of the sources, not their sum."""
    rows = ad.segments(spark, sf_dir).groupBy("meeting_id", "source").agg(F.max("end_ms").alias("ms"), F.sum(F.col("end_ms") - F.col("start_ms")).alias("speech_ms"))
    return rows.groupBy("meeting_id").agg(F.max("ms").alias("duration_ms"), F.sum("speech_ms").alias("speech_ms"), F.round(F.sum("speech_ms") / F.greatest(F.max("ms"), F.lit(1)), 9).alias("factor"))


def source_files(spark, sf_dir):
    p = F.col("p_partkey")
    name = F.element_at(F.array(*[F.lit(x) for x in ("mic.wav", "system.wav", "imported.wav", "notes.txt")]), (p % 4 + 1).cast("int"))
    return runs.sources_in(ad.table(spark, sf_dir, "part").select(F.floor(p / 3).alias("meeting_id"), name.alias("name")))


def decoder_choice(spark, sf_dir):
    p = F.col("p_partkey")
    offer = lambda n, accepts, reason: F.struct(F.lit(f"decoder{n}").alias("decoder"), F.lit(n).alias("priority"), accepts.alias("accepts"), reason.alias("reason"))
    offers = F.array(offer(0, p % 3 == 0, F.lit("no")), offer(1, p % 5 == 0, F.concat(F.lit("refused "), "p_type")), offer(2, p % 7 == 0, F.lit("x")))
    return runs.chosen_decoders(ad.table(spark, sf_dir, "part").select(F.col("p_name").alias("n"), p.cast("string").alias("path"), F.inline(offers)))


def decoder_extensions(spark, sf_dir):
    s = F.col("s_suppkey")
    ext = F.array(F.concat(F.lit(".x"), (s % 9).cast("string")), F.when(s % 2 == 0, F.concat(F.lit(".X"), (s % 9).cast("string"))).otherwise(F.lit(".Wav")))
    return runs.distinct_extensions(ad.table(spark, sf_dir, "supplier").select(F.col("s_name").alias("decoder"), s.alias("priority"), ext.alias("extensions")))


def capture_formats(spark, sf_dir):
    rate = F.element_at(F.array(*[F.lit(x) for x in (8000, 16000, 44100, 48000, 96000)]), (F.col("s_suppkey") % 5 + 1).cast("int"))
    return runs.format_notes(ad.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("device_id"), rate.alias("rate")))


def transcode_results(spark, sf_dir):
    c = F.col("c_custkey")
    rows = ad.table(spark, sf_dir, "customer").select(c.alias("run_id"), (c % 6 != 0).alias("supported"), (c % 7 == 0).alias("failed"), (c % 5 * 100).alias("out_bytes"), F.lit(192).alias("requested_kbps"), (160 + c % 3 * 32).cast("int").alias("encoded_kbps"))
    return runs.transcode_outcomes(rows).select("run_id", "kept", "warning")


def generator_choice(spark, sf_dir):
    c = F.col("c_custkey")
    rows = ad.table(spark, sf_dir, "customer").select(c.alias("setting_id"), (c % 2 == 0).alias("minutes_enabled"), F.when(c % 3 != 0, c % 3 == 1).alias("profile_minutes"), F.when(c % 5 == 0, "Extractive").otherwise("Local").alias("mode"), F.when(c % 7 != 0, c % 7 < 5).alias("model_present"))
    return runs.chosen_generators(rows).select("setting_id", "generator")


def meeting_warnings(spark, sf_dir):
    rows = ad.table(spark, sf_dir, "events").select(F.col("user_id").alias("meeting_id"), F.col("event_id").alias("ord"), F.col("event_type").alias("warning"))
    return runs.distinct_warnings(rows)


def connections(spark, sf_dir):
    rows = ad.table(spark, sf_dir, "events").select(F.col("event_id").alias("at"), (F.col("user_id") % 20).alias("pid"), F.concat(F.lit("host"), (F.col("event_id") % 6).cast("string")).alias("remote"), F.when(F.col("event_type") == "view", "ESTABLISHED").otherwise("LISTEN").alias("state"))
    return runs.connections_seen(rows)


def cpu_use(spark, sf_dir):
    from pyspark.sql import Window

    total = F.sum("value").over(Window.partitionBy("stream").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = ad.levels(spark, sf_dir).select(F.col("stream").alias("process"), F.col("seq").cast("double").alias("at"), total.alias("cpu_seconds"))
    return runs.cpu_percent(rows, 4).withColumn("percent", F.round("percent", 6))


def ring_buffers(spark, sf_dir):
    rows = ad.table(spark, sf_dir, "events").select(F.col("user_id").alias("stream"), F.col("event_id").alias("seq"), F.floor("value").alias("written"), F.floor(F.col("value") / 2).alias("read"))
    return runs.ring_overruns(rows, 100)


def model_checks(spark, sf_dir):
    p = F.col("p_partkey")
    rows = ad.table(spark, sf_dir, "part").select(p.alias("model_id"), (p * 1000).alias("nominal_bytes"), F.when(p % 4 != 0, p * (p % 3) * 400).alias("file_bytes"), F.when(p % 5 != 0, F.concat(F.lit("AB"), (p % 7).cast("string"))).alias("pinned"), F.concat(F.lit("ab"), (p % 2).cast("string")).alias("measured"))
    return runs.model_files(rows).select("model_id", "status", runs.human_size(F.col("nominal_bytes") * 1000).alias("size"))


def device_reports(spark, sf_dir):
    """Suppliers as the devices of machines, ten to each."""
    s = F.col("s_suppkey")
    rows = ad.table(spark, sf_dir, "supplier").select(F.floor(s / 10).alias("machine_id"), F.when(s % 3 == 0, "capture").otherwise("render").alias("kind"), F.col("s_name").alias("name"), (s % 10 == 4).alias("is_default"))
    return runs.device_checks(rows, ["capture", "render", "loopback"], ("machine_id",))


def run_metrics(spark, sf_dir):
    c = F.col("c_custkey")
    rows = ad.table(spark, sf_dir, "customer").select(c.alias("run_id"), (c % 50 * 2.0).alias("meeting_seconds"), (c % 40 / 2.0).alias("speech_seconds"), (c % 40 / 5.0).alias("submitted_seconds"), (c % 9).alias("chunks"), (c % 20).alias("segments"), F.lit("small").alias("model"), (c % 64 / 4.0 + 0.001).alias("total_seconds"))
    return runs.metrics_block(rows)


def check_reports(spark, sf_dir):
    n = F.col("n_nationkey")
    severity = F.element_at(F.array(*[F.lit(x) for x in ("Ok", "Warning", "Error", "NotTested")]), (n % 4 + 1).cast("int"))
    return runs.report_text(ad.table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("report_id"), n.alias("ord"), F.col("n_name").alias("check"), severity.alias("severity"), F.lit("detail").alias("detail")))


def process_tree(spark, sf_dir):
    p = F.col("p_partkey")
    tree = ad.table(spark, sf_dir, "part").select(p.alias("pid"), F.floor(p / 3).alias("parent_pid"))
    return planning.descendants(tree, tree.where("pid IN (1, 2, 7)").select("pid"))


def _meetings(spark, sf_dir):
    """Details of the meetings of ``segments``, and of one more for every tenth of them in which nothing was said; every second one has no title, every third was recovered."""
    m = F.col("meeting_id")
    rows = ad.segments(spark, sf_dir).groupBy("meeting_id").agg((F.max("end_ms") / 1000).alias("duration_seconds"))
    rows = rows.unionByName(rows.where("meeting_id % 10 = 0").select((m + 1_000_000).alias("meeting_id"), F.lit(0.0).alias("duration_seconds")))
    begun = F.expr("timestamp_ntz'2026-01-05 09:30:00' + make_dt_interval(0, 0, CAST(meeting_id AS INT))")
    ended = F.expr("timestamp_ntz'2026-01-05 09:30:00' + make_dt_interval(0, 0, CAST(meeting_id AS INT), floor(duration_seconds))")
    return rows.select(
        "meeting_id", F.when(m % 2 == 0, F.concat(F.lit("Meeting "), m.cast("string"))).alias("title"), F.concat(F.lit("folder_"), m.cast("string")).alias("folder_name"), begun.alias("started_at"), F.when(m % 4 != 1, ended).alias("stopped_at"),
        F.lit("+09:00").alias("utc_offset"), "duration_seconds", F.lit("audio.wav").alias("audio_file_name"), F.when(m % 5 != 0, "mic").alias("microphone"), F.when(m % 7 != 0, "out|put").alias("render_device"), F.when(m % 4 != 0, "small").alias("model_id"), (m % 3 == 0).alias("recovered"),
        (m % 2 == 1).alias("diarized"), F.when(m % 3 == 0, F.array(F.concat(F.lit("gap "), m.cast("string")), F.lit("clipped"))).alias("warnings"))


def minutes_text(spark, sf_dir):
    return minutes.rendered_text(ad.segments(spark, sf_dir), _meetings(spark, sf_dir), CUES)


def transcript_headers(spark, sf_dir):
    return transcript.header_lines(_meetings(spark, sf_dir), "  ")


def transcript_cleared(spark, sf_dir):
    rows = ad.segments(spark, sf_dir)
    return transcript.cleared(rows, rows.where("meeting_id % 3 = 0")).select("meeting_id", "id")


def decode_options(spark, sf_dir):
    c = F.col("c_custkey")
    profile = F.element_at(F.array(*[F.lit(x) for x in ("Fast", "Balanced", "Accurate", "?")]), (c % 4 + 1).cast("int"))
    language = F.element_at(F.array(*[F.lit(x) for x in ("ja", "JA-jp", "en", " ", "fr")]), (c % 5 + 1).cast("int"))
    return planning.decode_options(ad.table(spark, sf_dir, "customer").select(c.alias("setting_id"), profile.alias("profile"), F.when(c % 7 != 0, language).alias("language")))


def progress_fractions(spark, sf_dir):
    c = F.col("c_custkey")
    rows = ad.table(spark, sf_dir, "customer").select(c.alias("run_id"), (c % 50 * 1.5).alias("processed_seconds"), (c % 11 * 5.0).alias("total_seconds"), (c % 50 * 4).alias("received"), F.when(c % 6 != 0, c % 9 * 16).alias("total"), (c % 4 * 1.0).alias("bytes_per_second"))
    return planning.download_progress(planning.progress(rows).withColumn("run_fraction", F.round("fraction", 9)).drop("fraction")).withColumn("fraction", F.round("fraction", 9)).select("run_id", "run_fraction", "fraction", F.round("remaining_seconds", 9).alias("remaining_seconds"))


def minutes_run_totals(spark, sf_dir):
    e = F.col("event_id")
    rows = ad.table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.when(e % 5 == 0, "reduce").otherwise("map").alias("phase"), (e % 900).alias("prompt_tokens"), (e % 70).alias("output_tokens"), (e % 8 / 4.0).alias("seconds"))
    return runs.minutes_totals(rows).withColumn("tokens_per_second", F.round("tokens_per_second", 9))


def page_hashes(spark, sf_dir):
    rows = ad.table(spark, sf_dir, "pages").select("page_id", F.coalesce("html", F.lit("")).cast("binary").alias("content"), F.when(F.col("page_id") % 2 == 0, F.upper(F.sha2(F.coalesce("html", F.lit("")), 256))).otherwise("00").alias("pinned"))
    return runs.file_hashes(rows).select("page_id", "measured", "matches")


def prompts_assembled(spark, sf_dir):
    rows = ad.table(spark, sf_dir, "documents").select("doc_id", F.lit(responses.WHOLE_TRANSCRIPT).alias("instruction"), F.coalesce("text", F.lit("")).alias("body"))
    prompts = responses.assembled(rows)
    return prompts.select("doc_id", F.sha2("prompt", 256).alias("prompt_sha256"), F.char_length("prompt").cast("long").alias("n_chars"), F.lit(responses.frame_overhead()).cast("long").alias("overhead"))


def prompt_lines_left_out(spark, sf_dir):
    rows = ad.lines(spark, sf_dir)
    return responses.left_out(rows, responses.packed(rows, 300, 3))


def minutes_filled(spark, sf_dir):
    """Documents as a model's answers, parsed and rendered."""
    rows = minutes.filled_template(responses.sections(ad.lines(spark, sf_dir)))
    return minutes.template_text(rows, rows.select("meeting_id", F.lit(None).cast("string").alias("title"), F.concat(F.lit("d"), F.col("meeting_id").cast("string")).alias("folder_name"), F.expr("timestamp_ntz'2026-01-05 09:30:00'").alias("started_at"), F.lit(0.0).alias("duration_seconds")), "local")


def _samples_of(blocks, size):
    """The samples of blocks of ``size`` as rows: stream, pos, y."""
    rows = blocks.select("stream", "block", F.posexplode("samples").alias("at", "y"))
    return rows.select("stream", (F.col("block") * size + F.col("at")).cast("long").alias("pos"), F.round("y", 9).alias("y"))


def sample_low_pass(spark, sf_dir):
    return _samples_of(recurrence.filtered(ad.short_blocks(spark, sf_dir), [filters.Biquad.low_pass(16000, 3400)]), 32)


def sample_band_pass(spark, sf_dir):
    return _samples_of(recurrence.filtered(ad.short_blocks(spark, sf_dir), [filters.Biquad.band_pass(16000, 1000, 1.5)]), 32)


def sample_high_shelf(spark, sf_dir):
    return _samples_of(recurrence.filtered(ad.short_blocks(spark, sf_dir), [filters.Biquad.high_shelf(16000, 3000, 6)]), 32)


def sample_band_levels(spark, sf_dir):
    """At a rate so low that a stream has several frames."""
    blocks = ad.short_blocks(spark, sf_dir).withColumn("start_sample", F.col("block") * 32)
    return spectrum.spectral_balance(blocks, 2400).withColumns({"rms": F.round("rms", 9), "relative_db": F.round("relative_db", 6)})


def sample_upsampled(spark, sf_dir):
    return _samples_of(conversion.resampled(ad.short_blocks(spark, sf_dir), 16000, 32000), 64)


def sample_muted(spark, sf_dir):
    rows = ad.short_blocks(spark, sf_dir).withColumn("samples", samples.muted(F.col("samples"), F.col("stream") % 3 == 0))
    return _samples_of(rows, 32).withColumn("y", F.col("y") + 0.0)


def sample_slices(spark, sf_dir):
    s, blocks = F.col("stream"), ad.short_blocks(spark, sf_dir, 16)
    wanted = blocks.select("stream").distinct().select("stream", F.lit(0).alias("span"), (s % 5 * 100).alias("start_ms"), (s % 7 * 1000).alias("end_ms"))
    rows = samples.spans(blocks, wanted, 10, 16)
    return rows.select("stream", F.size("samples").cast("long").alias("n"), F.round(F.element_at("samples", 1), 9).alias("first"))


def drift_drops(spark, sf_dir):
    backlog = 300 + F.col("stream") % 5 * 150 + F.col("seq") % 7 * 10
    return levels.drift_corrections(ad.levels(spark, sf_dir).select("stream", "seq", backlog.alias("backlog")), 1000, 1.0)


def capture_probes(spark, sf_dir):
    e = F.col("event_id")
    rows = ad.table(spark, sf_dir, "events").select(e.alias("probe_id"), (e % 7 != 0).alias("opened"), (e % 5 * 12000).alias("samples"), (e % 3).cast("double").alias("seconds"), (-(e % 90)).cast("double").alias("peak_db"))
    return planning.probe_outcomes(rows).select("probe_id", "severity", F.round("coverage", 9).alias("coverage"))


def leg_clipping(spark, sf_dir):
    c = F.col("c_custkey")
    rows = ad.table(spark, sf_dir, "customer").select(c.alias("meeting_id"), ((c % 13).cast("double") / 20000).alias("microphone"), ((c % 7).cast("double") / 20000).alias("system"))
    return planning.clipping_warnings(rows)


def manifest_upserts(spark, sf_dir):
    p = F.col("p_partkey")
    rows = ad.table(spark, sf_dir, "part")
    manifest = rows.select(F.concat(F.lit("m"), p.cast("string")).alias("id"), p.alias("verified_at"), (p * 10).alias("bytes"))
    entries = rows.where(p % 4 == 0).select(F.concat(F.lit("M"), F.floor(p / 8).cast("string")).alias("id"), p.alias("verified_at"), p.alias("bytes"))
    return documents.upsert_manifest(manifest, entries)


def import_refusals(spark, sf_dir):
    p = F.col("p_partkey")
    end = F.element_at(F.array(*[F.lit(x) for x in (".wav", ".MP3", ".txt", "", ".m4a")]), (p % 5 + 1).cast("int"))
    rows = ad.table(spark, sf_dir, "part").select(F.concat(F.lit("folder/f"), p.cast("string"), end).alias("path"), (p % 11 != 0).alias("exists"), (p % 13).alias("length"), (p % 17 != 0).alias("readable"), (p % 3 != 0).alias("decodable"))
    return wav.import_checks(rows)


def spoken_spans(spark, sf_dir):
    rows = ad.segments(spark, sf_dir).withColumn("no_speech_prob", (F.col("arrival_seq") % 10).cast("double") / 10)
    return speech.spoken(rows).select("meeting_id", "id")


def speech_run_totals(spark, sf_dir):
    return speech.run_totals(ad.segments(spark, sf_dir)).withColumn("encoder_seconds", F.col("encoder_seconds").cast("long"))


def speaker_names_merged(spark, sf_dir):
    old = _names(spark, sf_dir)
    return transcript.merged_names(old, old.where("meeting_id % 3 <> 1").withColumn("name", F.concat(F.lit("Typed "), F.col("speaker_id").cast("string"))))


def journals_dismissed(spark, sf_dir):
    entries = ad.journal(spark, sf_dir)
    return journals.dismissed(entries, entries.where("meeting_id % 4 = 0").select("meeting_id").distinct()).select("meeting_id", "line_no", "kind")


def recognition_audio_kept(spark, sf_dir):
    c = F.col("c_custkey")
    outcome = F.element_at(F.array(*[F.lit(x) for x in ("Completed", "Failed", "Cancelled")]), (c % 3 + 1).cast("int"))
    return ad.table(spark, sf_dir, "customer").select(c.alias("run_id"), runs.keeps_recognition_audio(outcome, c % 2 == 0).alias("kept"))


def meaningful_lines(spark, sf_dir):
    text, role = F.col("text"), F.col("role")
    rows = F.array(F.concat(F.lit("- "), text), F.lit("なし"), F.concat(F.lit("・ "), role), F.concat(F.lit("```"), role), F.lit("* -"), F.lit("* x"), text)
    return ad.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(ft.meaningful(rows), "|").alias("kept"))


def mel_scale(spark, sf_dir):
    c = F.col("c_custkey")
    return ad.table(spark, sf_dir, "customer").select(c.alias("id"), F.round(fa.mel((c % 8000).cast("double")), 6).alias("mel"), F.round(fa.hertz((c % 3000).cast("double")), 6).alias("hertz"), F.round(fa.meter(-(c % 70).cast("double")), 9).alias("meter"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    transcript_timeline, transcript_sentences, cue_sentences, minutes_items, minutes_topics, minutes_overview, minutes_markdown, transcript_text, transcript_markdown,
    speaker_carry_over, speaker_list, speaker_names_known, speaker_rename_counts, segment_edits, segment_upserts, segments_added, segments_replaced, segment_removals, leg_clipping_counts, capture_probe_levels, minutes_metrics_blocks, journal_replay, journal_states, journal_recovery,
    response_sections, response_markers, prompt_plan, prompt_blocks, prompt_prefix, block_time_ranges, level_statistics, level_peak_hold, level_meters, level_voice_activity, level_smoothed,
    level_stalls, level_silence_runs, level_gap_filled, level_inserted_share, sample_dc_block, sample_mix, sample_downmix, sample_normalised, sample_quantised, sample_interpolated,
    vector_cosines, vector_statistics, vector_speaker_clusters, speech_chunks, model_choice, model_lookups, diarizer_settings, meeting_abilities, smoothing_coefficients, storage_footprint, preflight_overall, folder_names, perf_log_fields, settings_migrated, meeting_totals,
    source_files, decoder_choice, decoder_extensions, capture_formats, transcode_results, generator_choice, meeting_warnings, connections, cpu_use, ring_buffers, model_checks, device_reports, run_metrics,
    check_reports, process_tree, minutes_text, transcript_headers, transcript_cleared, decode_options, progress_fractions, minutes_run_totals, page_hashes, prompts_assembled, prompt_lines_left_out, minutes_filled,
    sample_low_pass, sample_band_pass, sample_high_shelf, sample_band_levels, sample_upsampled, sample_muted, sample_slices, drift_drops, capture_probes, leg_clipping, manifest_upserts, import_refusals,
    spoken_spans, speech_run_totals, speaker_names_merged, journals_dismissed, recognition_audio_kept, meaningful_lines, mel_scale)}


def queries() -> dict[str, Query]:
    return QUERIES | live_queries.QUERIES | file_queries.QUERIES | seam_queries.QUERIES


def oracle_sql() -> dict[str, str]:
    return oracles.SQL | live_queries.SQL | file_queries.SQL | seam_queries.SQL
