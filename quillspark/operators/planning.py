"""Choices by rule: models that fit a machine, storage, checks and their severities, settings of older versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.text import is_blank

from .lineage import cut

RAM_FACTOR, SMALL_FACTOR, ACCEPTABLE_FACTOR, LEAST_SCORE = 3.0, 1.1, 1.5, 0.05

# Id, purpose, licence, bytes, MB of memory, cost relative to the small model.
CATALOG = [
    ("whisper-tiny-q5_1", "speech", "MIT", 32152673, 300, 0.25),
    ("whisper-base-q5_1", "speech", "MIT", 59707625, 500, 0.5),
    ("whisper-small-q5_1", "speech", "MIT", 190085487, 1024, 1.0),
    ("whisper-medium-q5_0", "speech", "MIT", 539212467, 2200, 3.6),
    ("whisper-large-v3-turbo-q5_0", "speech", "MIT", 574041195, 2400, 7.4),
    ("qwen2.5-1.5b-instruct-q4_k_m", "text", "Apache-2.0", 1117320736, 2048, 1.0),
    ("qwen2.5-3b-instruct-q4_k_m", "text", "Qwen Research License", 2104932768, 4096, 2.0),
]
CATALOG_SCHEMA = "model_id string, purpose string, license string, size_bytes long, required_ram_mb int, relative_cost double"
SEVERITIES = ["NotTested", "Ok", "Warning", "Error"]


def catalog(spark) -> DataFrame:
    return spark.createDataFrame(CATALOG, CATALOG_SCHEMA)


def models_for(purposes: list[str], models: DataFrame) -> DataFrame:
    """The models of several purposes as one catalogue, in the order of the purposes."""
    parts = [models.where(F.col("purpose") == p).withColumn("catalog_rank", F.lit(i)) for i, p in enumerate(purposes)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def found_models(requests: DataFrame, models: DataFrame) -> DataFrame:
    """request_id, wanted, model_id of requests (request_id, wanted, required): the model of that id whatever its case, null where there is none; a required one that is missing stops the job.

    The catalogue is a handful of rows, so it is broadcast.
    """
    known = F.broadcast(models.select(F.lower("model_id").alias("key"), "model_id"))
    joined = requests.join(known, F.lower("wanted") == F.col("key"), "left")
    missing = F.raise_error(F.concat(F.lit("no such model: "), F.coalesce("wanted", F.lit("null")))).cast("string")
    return joined.select("request_id", "wanted", F.when(F.col("model_id").isNull() & F.col("required"), missing).otherwise(F.col("model_id")).alias("model_id"))


def with_diarizer(settings: DataFrame) -> DataFrame:
    """Adds ``diarizer`` to settings (machine_diarizes, diarization, profile): whether speakers are told apart; never in the fast profile."""
    on = F.coalesce("machine_diarizes", F.lit(False)) & F.coalesce("diarization", F.lit(False))
    return settings.withColumn("diarizer", on & (F.coalesce("profile", F.lit("")) != "Fast"))


def processing_factor(cost: Column, score: Column) -> Column:
    """Time to transcribe as a share of the audio's length."""
    return SMALL_FACTOR * cost / F.greatest(score, F.lit(LEAST_SCORE))


def fits(ram_gb: Column, required_mb: Column) -> Column:
    return ram_gb * 1024 >= required_mb * RAM_FACTOR


def recommended_threads(cores: Column) -> Column:
    return F.least(F.greatest(F.floor(cores / 2), F.lit(2)), F.lit(6)).cast("int")


def chosen_models(machines: DataFrame, models: DataFrame) -> DataFrame:
    """machine_id, speech_model, factor, text_model, threads, diarization, minutes for each machine (cores, ram_gb, score).

    The most accurate speech model that fits in memory and is fast enough; the lightest needs to fit only, and is the fallback. Models are
    a handful of rows, so they are broadcast.
    """
    speech = models.where("purpose = 'speech'").withColumn("rank", F.row_number().over(Window.orderBy("relative_cost")))
    pairs = machines.join(F.broadcast(speech), fits(F.col("ram_gb"), F.col("required_ram_mb")) | (F.col("rank") == 1), "left")
    factor = processing_factor(F.col("relative_cost"), F.col("score"))
    good = (factor <= ACCEPTABLE_FACTOR) | (F.col("rank") == 1)
    best = pairs.where(good).groupBy("machine_id", "cores", "ram_gb", "score").agg(F.max_by("model_id", "rank").alias("speech_model"), F.max_by(factor, "rank").alias("factor"))
    text = F.broadcast(models.where("purpose = 'text' AND license LIKE 'Apache%'").select(F.col("model_id").alias("t_id"), F.col("required_ram_mb").alias("t_mb")))
    writers = machines.join(text, fits(F.col("ram_gb"), F.col("t_mb"))).groupBy("machine_id").agg(F.max_by("t_id", "t_mb").alias("text_model"))
    return best.join(writers, "machine_id", "left").select("machine_id", "speech_model", "factor", "text_model", recommended_threads(F.col("cores")).alias("threads"), (F.col("cores") >= 4).alias("diarization"), (F.col("ram_gb") >= 8).alias("minutes"))


# Bytes a second of the recorded formats.
WAV_BYTES, WORKING_BYTES, STREAMS = 96_000, 32_000, 2


def storage(settings: DataFrame) -> DataFrame:
    """Bytes a second while recording, MB an hour kept, hours that fit: of (format, mp3_kbps, stt_enabled, keep_audio, delete_after, free_bytes)."""
    output = F.when(F.col("format") == "mp3", F.col("mp3_kbps") * 1000 / 8).otherwise(F.lit(float(WAV_BYTES)))
    working = F.when(F.col("stt_enabled") & F.col("keep_audio"), F.lit(float(WORKING_BYTES * STREAMS))).otherwise(F.lit(0.0))
    recording = F.lit(float(WAV_BYTES)) + working
    kept = output + F.when(F.col("delete_after"), F.lit(0.0)).otherwise(working)
    hour = 3600.0
    return settings.withColumn("recording_bytes_s", recording).withColumn("kept_mb_h", kept * hour / 1e6).withColumn("hours_that_fit", F.when(recording > 0, F.col("free_bytes") / (recording * hour)))


def severity_rank(severity: Column) -> Column:
    return F.coalesce(*[F.when(severity == s, F.lit(i)) for i, s in enumerate(SEVERITIES)], F.lit(0))


def overall(checks: DataFrame) -> DataFrame:
    """report_id, overall, n_error, n_warning, exit_code: the worst severity of each report's checks."""
    rows = checks.groupBy("report_id").agg(F.max(severity_rank(F.col("severity"))).alias("worst"), F.count_if(F.col("severity") == "Error").alias("n_error"), F.count_if(F.col("severity") == "Warning").alias("n_warning"))
    names = F.array(*[F.lit(s) for s in SEVERITIES])
    return rows.select("report_id", F.element_at(names, F.col("worst") + 1).alias("overall"), "n_error", "n_warning", F.when(F.col("worst") == len(SEVERITIES) - 1, 1).otherwise(0).alias("exit_code"))


ERROR_BYTES, WARN_BYTES = 500 << 20, 2 << 30


def preflight(machines: DataFrame) -> DataFrame:
    """report_id, check, severity before a recording: of (report_id, free_bytes, writable, n_inputs, has_model)."""
    disk = F.when(F.col("free_bytes") < ERROR_BYTES, "Error").when(F.col("free_bytes") < WARN_BYTES, "Warning").otherwise("Ok")
    write = F.when(F.col("writable"), "Ok").otherwise("Error")
    device = F.when(F.col("n_inputs") > 0, "Ok").otherwise("Error")
    model = F.when(F.col("has_model"), "Ok").otherwise("Warning")
    checks = F.array(*[F.struct(F.lit(name).alias("check"), severity.alias("severity")) for name, severity in (("disk", disk), ("folder", write), ("device", device), ("model", model))])
    return machines.select("report_id", F.inline(checks))


def probe_outcomes(probes: DataFrame, rate: int = 48_000, silent_db: float = -70.0) -> DataFrame:
    """Adds severity and coverage (percent of the expected samples) to probes (opened, samples, seconds, peak_db)."""
    severity = F.when(~F.col("opened"), "Error").when((F.col("samples") == 0) | (F.col("peak_db") <= silent_db), "Warning").otherwise("Ok")
    return probes.withColumn("severity", severity).withColumn("coverage", F.when(F.col("seconds") > 0, F.col("samples") * 100.0 / (F.col("seconds") * rate)).otherwise(F.lit(0.0)))


def clipping_warnings(legs: DataFrame, least: float = 1e-4) -> DataFrame:
    """meeting_id, worse, share where a leg clips: the worse of microphone and system, the microphone on ties."""
    worse = F.when(F.col("microphone") >= F.col("system"), F.lit("Microphone")).otherwise(F.lit("SystemAudio"))
    return legs.select("meeting_id", worse.alias("worse"), F.greatest("microphone", "system").alias("share")).where(F.col("share") >= least)


def migrated_settings(documents: DataFrame) -> DataFrame:
    """Settings documents (doc, a JSON string) of any version: id, version, bitrate, keep_audio, profile.

    A value counts only if it has its JSON type: the string "true" is not a boolean. Older names are read where the new one is missing;
    the old default bitrate of 96 becomes the present one.
    """
    v = F.try_parse_json("doc")
    def typed(path: str, kind: str, cast: str) -> Column:
        got = F.try_variant_get(v, path, "variant")
        return F.when(F.schema_of_variant(got) == kind, F.try_variant_get(v, path, cast))
    version = F.coalesce(typed("$.version", "BIGINT", "int"), F.lit(1))
    bitrate = F.coalesce(typed("$.mp3BitrateKbps", "BIGINT", "int"), typed("$.bitrate", "BIGINT", "int"), F.lit(192))
    keep = F.coalesce(typed("$.keepRecognitionAudio", "BOOLEAN", "boolean"), typed("$.keepAudio", "BOOLEAN", "boolean"), F.lit(True))
    profile = F.coalesce(typed("$.profile.mode", "STRING", "string"), typed("$.mode", "STRING", "string"), F.lit("Balanced"))
    return documents.select("id", version.alias("version"), F.when((version < 2) & (bitrate == 96), F.lit(192)).otherwise(bitrate).alias("bitrate"), keep.alias("keep_audio"), F.when(version < 2, F.lit("Balanced")).otherwise(profile).alias("profile"))


def unique_names(folders: DataFrame) -> DataFrame:
    """Adds ``path``: the base name (base, created_seq), from the second of a name on with ``_2``, ``_3`` …"""
    n = F.row_number().over(Window.partitionBy("base").orderBy("created_seq"))
    return folders.withColumn("path", F.when(n == 1, F.col("base")).otherwise(F.concat_ws("_", "base", n.cast("string"))))


def descendants(processes: DataFrame, roots: DataFrame) -> DataFrame:
    """root, pid: every process (pid, parent_pid) below each root, found level by level until a level finds nothing new."""
    level = found = roots.select(F.col("pid").alias("root"), "pid")
    while not level.isEmpty():
        below = level.withColumnRenamed("pid", "parent_pid").join(processes.select("pid", "parent_pid"), "parent_pid").select("root", "pid")
        level = cut(below.join(found, ["root", "pid"], "left_anti").distinct())
        found = found.union(level)
    return found


# Beams and the step of temperature by profile, and the prompt for Japanese.
BEAMS = {"Fast": 1, "Accurate": 5}
OTHER_BEAM = 2
TEMPERATURE_STEP = 0.2
JAPANESE_PROMPT = "以下は会議の日本語の音声です。句読点を付けて書き起こします。"


def decode_options(settings: DataFrame) -> DataFrame:
    """Adds beam, temperature_step and initial_prompt to settings (profile, language): one pass when fast; Japanese unless another language is named."""
    beam = F.coalesce(*[F.when(F.col("profile") == p, F.lit(n)) for p, n in BEAMS.items()], F.lit(OTHER_BEAM))
    language = F.coalesce("language", F.lit(""))
    prompt = F.when(is_blank(language) | F.lower(language).startswith("ja"), F.lit(JAPANESE_PROMPT))
    return settings.withColumn("beam", beam).withColumn("temperature_step", F.when(F.col("profile") == "Fast", 0.0).otherwise(TEMPERATURE_STEP)).withColumn("initial_prompt", prompt)


def progress(runs: DataFrame) -> DataFrame:
    """Adds ``fraction`` to runs (processed_seconds, total_seconds): from 0 to 1; 0 where the total is not known."""
    share = F.least(F.greatest(F.col("processed_seconds") / F.col("total_seconds"), F.lit(0.0)), F.lit(1.0))
    return runs.withColumn("fraction", F.when(F.col("total_seconds") > 0, share).otherwise(F.lit(0.0)))


def download_progress(downloads: DataFrame) -> DataFrame:
    """Adds ``fraction`` and ``remaining_seconds`` to downloads (received, total, bytes_per_second); null where they can't be told."""
    known = F.col("total") > 0
    share = F.least(F.greatest(F.col("received") / F.col("total"), F.lit(0.0)), F.lit(1.0))
    left = (F.col("total") - F.col("received")) / F.col("bytes_per_second")
    return downloads.withColumn("fraction", F.when(known, share)).withColumn("remaining_seconds", F.when(known & (F.col("bytes_per_second") > 1), left))
