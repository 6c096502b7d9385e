"""Recordings and their runs: which sources there are, imports, formats, warnings, buffers, totals, blocks for the log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The files of a meeting's sources, in their order, and what each holds.
SOURCE_FILES = [("mic.wav", "Microphone"), ("system.wav", "SystemAudio"), ("imported.wav", "Imported")]
INTERNAL_RATE, SPEECH_RATE = 48_000, 16_000


def sources_in(files: DataFrame) -> DataFrame:
    """meeting_id, name, kind, ord: the source files among a meeting's ``files`` (meeting_id, name). A handful of names, so they are broadcast."""
    spark = files.sparkSession
    known = spark.createDataFrame([(n, k, i) for i, (n, k) in enumerate(SOURCE_FILES)], "name string, kind string, ord int")
    return files.select("meeting_id", "name").distinct().join(F.broadcast(known), "name").select("meeting_id", "name", "kind", "ord")


def chosen_decoders(offers: DataFrame) -> DataFrame:
    """path, decoder, refusal: of ``offers`` (path, decoder, priority, accepts, reason) the first decoder that accepts, else the most specific reason.

    Reasons are the more specific the longer they are; of equals the first decoder's counts.
    """
    first = F.min_by("decoder", F.when(F.col("accepts"), F.col("priority")))
    reason = F.max_by("reason", F.when(~F.col("accepts"), F.struct(F.length("reason"), -F.col("priority"))))
    rows = offers.groupBy("path").agg(first.alias("decoder"), reason.alias("reason"))
    return rows.select("path", "decoder", F.when(F.col("decoder").isNull(), F.col("reason")).alias("refusal"))


def distinct_extensions(decoders: DataFrame) -> DataFrame:
    """extension, decoder: each extension of ``decoders`` (decoder, priority, extensions) once, whatever its case, in the first one's spelling."""
    rows = decoders.select("decoder", "priority", F.posexplode("extensions").alias("pos", "extension"))
    first = F.min(F.struct("priority", "pos", "extension", "decoder"))
    return rows.groupBy(F.lower("extension").alias("k")).agg(first.alias("f")).select("f.extension", "f.decoder")


def format_notes(formats: DataFrame) -> DataFrame:
    """Adds what a capture ``rate`` means: pass_through, band_limited, speech_band_limited, nyquist, conversion."""
    rate = F.col("rate")
    same = rate == INTERNAL_RATE
    conversion = F.when(same, F.lit("pass-through")).otherwise(F.concat(F.lit("resampled "), rate.cast("string"), F.lit(f" -> {INTERNAL_RATE} Hz")))
    return formats.select("*", same.alias("pass_through"), (rate < INTERNAL_RATE).alias("band_limited"), (rate <= SPEECH_RATE).alias("speech_band_limited"), (rate / 2.0).alias("nyquist"), conversion.alias("conversion"))


def transcode_outcomes(runs: DataFrame) -> DataFrame:
    """Adds kept (the format that stays) and warning to runs (supported, failed, out_bytes, requested_kbps, encoded_kbps)."""
    bad = F.when(~F.col("supported"), "unavailable").when(F.col("failed"), "failed").when(F.col("out_bytes") <= 0, "empty")
    other = F.when((F.col("encoded_kbps") > 0) & (F.col("encoded_kbps") != F.col("requested_kbps")), F.lit("other bitrate"))
    return runs.withColumn("kept", F.when(bad.isNull(), "mp3").otherwise("wav")).withColumn("warning", F.coalesce(bad, other))


def chosen_generators(settings: DataFrame) -> DataFrame:
    """Adds generator: the language model's if minutes are enabled, asked for and its model is present; else the extractive one."""
    local = F.col("minutes_enabled") & F.coalesce("profile_minutes", F.lit(True)) & (F.col("mode") != "Extractive") & F.coalesce("model_present", F.lit(False))
    return settings.withColumn("generator", F.when(local, "local").otherwise("extractive"))


def keeps_recognition_audio(outcome: Column, delete_after: Column) -> Column:
    """Working audio goes only after a completed run, and only if that was asked for."""
    return ~((outcome == "Completed") & delete_after)


def distinct_warnings(warnings: DataFrame) -> DataFrame:
    """meeting_id, position, warning: each warning (meeting_id, ord, warning) once, in the order of first mention."""
    first = warnings.groupBy("meeting_id", "warning").agg(F.min("ord").alias("ord"))
    return first.select("meeting_id", F.row_number().over(Window.partitionBy("meeting_id").orderBy("ord")).cast("long").alias("position"), "warning")


def connections_seen(samples: DataFrame) -> DataFrame:
    """pid, remote, first_seen, n: established connections of ``samples`` (at, pid, remote, state)."""
    return samples.where("state = 'ESTABLISHED'").groupBy("pid", "remote").agg(F.min("at").alias("first_seen"), F.count("*").alias("n"))


def cpu_percent(counters: DataFrame, cores: int) -> DataFrame:
    """process, at, percent from running totals (process, at, cpu_seconds), of all cores; the first one has none."""
    order = Window.partitionBy("process").orderBy("at")
    used, passed = F.col("cpu_seconds") - F.lag("cpu_seconds").over(order), F.col("at") - F.lag("at").over(order)
    percent = F.when(passed > 0, F.least(F.greatest(100.0 * used / (passed * cores), F.lit(0.0)), F.lit(100.0)))
    return counters.select("process", "at", percent.alias("percent")).where("percent IS NOT NULL")


def ring_overruns(blocks: DataFrame, capacity: int) -> DataFrame:
    """stream, written, held, overruns, lost: a ring buffer that drops the oldest, after its writes and reads.

    ``blocks`` has stream, seq, written, read (samples asked for after the write). What is held depends on all before, hence a fold over counters.
    """
    rows = blocks.groupBy("stream").agg(F.sort_array(F.collect_list(F.struct("seq", F.col("written").cast("long").alias("w"), F.col("read").cast("long").alias("r")))).alias("x"))
    start = F.expr("named_struct('written', 0L, 'held', 0L, 'overruns', 0L, 'lost', 0L)")

    def step(s, b):
        kept = F.least(b["w"], F.lit(capacity).cast("long"))
        pushed = F.greatest(s["held"] + kept - capacity, F.lit(0).cast("long"))
        overruns = s["overruns"] + (b["w"] > capacity).cast("long") + (pushed > 0).cast("long")
        held = s["held"] + kept - pushed
        return F.struct((s["written"] + kept).alias("written"), (held - F.least(held, b["r"])).alias("held"), overruns.alias("overruns"), (s["lost"] + (b["w"] - kept) + pushed).alias("lost"))

    return rows.select("stream", F.aggregate("x", start, step).alias("s")).select("stream", "s.*")


def human_size(size: Column) -> Column:
    """Bytes in the largest unit of which there is one at least."""
    gb, mb = size / float(1 << 30), size / float(1 << 20)
    return F.when(gb >= 1, F.format_string("%.1f GB", gb)).when(mb >= 1, F.format_string("%.0f MB", mb)).otherwise(F.format_string("%d KB", F.floor(size / 1024).cast("long")))


def model_files(files: DataFrame) -> DataFrame:
    """Adds status to files (model_id, nominal_bytes, file_bytes, pinned, measured): missing, unverified, verified or mismatch.

    A file of at most half its nominal size counts as missing.
    """
    present = F.col("file_bytes") > F.col("nominal_bytes") * 0.5
    status = F.when(~F.coalesce(present, F.lit(False)), "missing").when(F.col("pinned").isNull() | F.col("measured").isNull(), "unverified").when(F.lower("pinned") == F.lower("measured"), "verified").otherwise("mismatch")
    return files.withColumn("status", status)


def device_checks(devices: DataFrame, kinds: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """kind, severity, detail: no endpoint of a kind is an error, else their count and names; the default one first.

    ``by`` names the columns of ``devices`` that tell machines apart; each machine has its own line for each kind.
    """
    every = devices.select(*by).distinct() if by else devices.sparkSession.range(1).select()
    every = every.withColumn("kind", F.explode(F.array(*[F.lit(k) for k in kinds])))
    rows = devices.groupBy(*by, "kind").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct((~F.col("is_default")).alias("d"), "name"))).alias("x"))
    detail = F.concat(F.col("n").cast("string"), F.lit(": "), F.array_join(F.transform("x", lambda r: r["name"]), ", "))
    return every.join(rows, [*by, "kind"], "left").select(*by, "kind", F.when(F.col("n") > 0, "Ok").otherwise("Error").alias("severity"), F.coalesce(detail, F.lit("none")).alias("detail"))


def meeting_abilities(meetings: DataFrame, files: DataFrame) -> DataFrame:
    """meeting_id, is_imported, can_transcribe, has_attribution of ``meetings`` (meeting_id, is_imported) by their working files (meeting_id, name).

    Any working audio can be transcribed; whose voice it is can be told only of a stream's own file, so not of an imported one.
    """
    name = F.lower("name")
    have = files.groupBy("meeting_id").agg(F.bool_or(name.isin("mic.wav", "system.wav")).alias("streams"), F.bool_or(name == "imported.wav").alias("imported"))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    return meetings.join(have, "meeting_id", "left").select("meeting_id", "is_imported", (yes("streams") | yes("imported")).alias("can_transcribe"), yes("streams").alias("has_attribution"))


def minutes_totals(inferences: DataFrame) -> DataFrame:
    """run_id, inferences, map_inferences, reduce_inferences, prompt_tokens, output_tokens, seconds, tokens_per_second of ``inferences`` (run_id, phase, prompt_tokens, output_tokens, seconds)."""
    of = lambda phase: F.count_if(F.col("phase") == phase)
    rows = inferences.groupBy("run_id").agg(F.count("*").alias("inferences"), of("map").alias("map_inferences"), of("reduce").alias("reduce_inferences"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum("seconds").alias("seconds"))
    return rows.withColumn("tokens_per_second", F.when(F.col("seconds") > 0, F.col("output_tokens") / F.col("seconds")).otherwise(F.lit(0.0)))


def minutes_metrics(runs: DataFrame, inferences: DataFrame) -> DataFrame:
    """Runs of minutes (run_id, transcript_tokens, context_tokens, blocks, load_seconds, total_seconds) with the totals and times of their ``inferences`` (run_id, phase, prompt_tokens, output_tokens, seconds).

    One block is a single pass. A run without inferences has zeros.
    """
    of = lambda phase, value: F.sum(F.when(F.col("phase") == phase, value))
    sums = inferences.groupBy("run_id").agg(
        of("map", F.lit(1)).alias("map_inferences"), of("map", F.col("seconds")).alias("map_seconds"), of("reduce", F.lit(1)).alias("reduce_inferences"), of("reduce", F.col("seconds")).alias("reduce_seconds"),
        F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("output_tokens").alias("output_tokens"))
    zero = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("map_inferences", "reduce_inferences", "prompt_tokens", "output_tokens")} | {c: F.coalesce(F.col(c), F.lit(0.0)) for c in ("map_seconds", "reduce_seconds")}
    rows = runs.join(sums, "run_id", "left").withColumns(zero).withColumn("single_pass", F.col("blocks") <= 1)
    spent = F.col("map_seconds") + F.col("reduce_seconds")
    return rows.withColumn("tokens_per_second", F.when(spent > 0, F.col("output_tokens") / spent).otherwise(F.lit(0.0)))


def minutes_block(metrics: DataFrame) -> DataFrame:
    """run_id, block: ``minutes_metrics`` with a ``strategy`` (why it was done so) as lines for the log."""
    lines = [
        F.lit("Minutes performance:"), F.format_string("  Transcript tokens     = %d", "transcript_tokens"), F.format_string("  Context window        = %d", "context_tokens"),
        F.format_string("  Strategy              = %s - %s", F.when(F.col("single_pass"), "single pass").otherwise("map-reduce"), F.col("strategy")), F.format_string("  Blocks                = %d", "blocks"), F.format_string("  Model load            = %.2f s", "load_seconds"),
        F.format_string("  Map inference count   = %d", "map_inferences"), F.format_string("  Map time              = %.2f s", "map_seconds"), F.format_string("  Reduce inference count= %d", "reduce_inferences"), F.format_string("  Reduce time           = %.2f s", "reduce_seconds"),
        F.format_string("  Prompt tokens         = %d", "prompt_tokens"), F.format_string("  Output tokens         = %d", "output_tokens"), F.format_string("  Tokens/sec            = %.1f", "tokens_per_second"), F.format_string("  Total                 = %.2f s", "total_seconds")]
    return metrics.select("run_id", F.concat_ws("\n", *lines).alias("block"))


def file_hashes(files: DataFrame) -> DataFrame:
    """Adds ``measured``, the lower-case SHA-256 of ``content``, and whether it is the ``pinned`` one, whatever its case."""
    return files.withColumn("measured", F.sha2("content", 256)).withColumn("matches", F.lower("pinned") == F.col("measured")).drop("content")


def metrics_block(runs: DataFrame) -> DataFrame:
    """run_id, block: totals of runs (run_id, meeting_seconds, speech_seconds, submitted_seconds, chunks, segments, model, total_seconds) as lines for the log."""
    factor = F.when(F.col("meeting_seconds") > 0, F.col("total_seconds") / F.col("meeting_seconds")).otherwise(F.lit(0.0))
    lines = [
        F.lit("Transcription performance:"), F.format_string("  Meeting duration      = %.1f s", "meeting_seconds"), F.format_string("  Speech detected       = %.1f s", "speech_seconds"),
        F.format_string("  Speech audio submitted= %.1f s", "submitted_seconds"), F.format_string("  Chunks                = %d (encoder ran %d s of padded window)", F.col("chunks"), F.col("chunks") * 30),
        F.format_string("  Segments              = %d", "segments"), F.format_string("  Model                 = %s", "model"), F.format_string("  Total                 = %.2f s", "total_seconds"),
        F.format_string("  RTF                   = %.2f x meeting duration", factor)]
    return runs.select("run_id", F.concat_ws("\n", *lines).alias("block"))


def report_text(checks: DataFrame) -> DataFrame:
    """report_id, text: the checks (report_id, ord, check, severity, detail) of a report and its worst severity."""
    mark = F.when(F.col("severity") == "Ok", " OK ").when(F.col("severity") == "Warning", "WARN").when(F.col("severity") == "Error", "FAIL").otherwise(" -- ")
    line = F.concat(F.lit("["), mark, F.lit("] "), "check", F.lit("\n      "), "detail", F.lit("\n\n"))
    rank = F.when(F.col("severity") == "Error", 3).when(F.col("severity") == "Warning", 2).when(F.col("severity") == "Ok", 1).otherwise(0)
    rows = checks.groupBy("report_id").agg(F.sort_array(F.collect_list(F.struct("ord", line.alias("line")))).alias("x"), F.max(rank).alias("worst"))
    overall = F.element_at(F.array(*[F.lit(s) for s in ("not tested", "ok", "warning", "error")]), F.col("worst") + 1)
    return rows.select("report_id", F.concat(F.array_join(F.transform("x", lambda r: r["line"]), ""), F.lit("overall: "), overall).alias("text"))
