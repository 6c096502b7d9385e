"""Import of recordings: files to mono WAV of the speech rate as one job, with what was refused and why; which meetings to import anew; folders of meetings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.sources.listing import listed
from quillspark.sources.wav_source import read_wav, save_wav

from .conversion import resampled_each
from .levels import CLIP_LEVEL, CLIP_SHARE
from .speech import RATE

#: Extensions that can be imported where there is a decoder, and those decoded here.
EXTENSIONS, DECODED = (".wav", ".mp3", ".m4a", ".aac"), (".wav",)


def stem(path: Column) -> Column:
    """The name of a file without its folders and extension."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.[^.]*$", "")


def refused(path: Column, length: Column) -> Column:
    """Why a file can't be imported by what the listing tells of it."""
    extension = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    return F.when(~extension.isin(*EXTENSIONS), "unsupported").when(length == 0, "empty").when(~extension.isin(*DECODED), "undecodable")


def import_audio(spark: SparkSession, root: str, folder: str, rate: int = RATE, block_samples: int = 1 << 16) -> DataFrame:
    """path, refusal, target, duration_seconds, peak, clipped for every file below ``root``; what can be read lies in ``folder`` afterwards, mono at ``rate``.

    Files are read by ranges, resampled block by block in parallel and put in place when all are written: a job that fails leaves ``folder`` as it was. Length and
    peak are those of the files written. Two files of one name raise. A file without samples is refused as ``undecodable``.
    """
    files = listed(spark, root).select("path", "length")
    blocks = read_wav(spark, root, block_samples=block_samples).select(F.col("path").alias("stream"), "block", "sample_rate", "samples")
    out = resampled_each(blocks, rate).select(F.concat(stem(F.col("stream")), F.lit(".wav")).alias("path"), "block", F.lit(rate).alias("sample_rate"), "samples")
    save_wav(out.where(F.size("samples") > 0), folder)
    written = read_wav(spark, folder)
    level = lambda x: F.abs(x)
    scan = written.groupBy("path").agg(
        (F.sum(F.size("samples")) / F.first("sample_rate")).alias("duration_seconds"), F.max(F.array_max(F.transform("samples", level))).alias("peak"),
        (F.sum(F.size(F.filter("samples", lambda x: level(x) >= CLIP_LEVEL))) / F.sum(F.size("samples")) >= CLIP_SHARE).alias("clipped"))
    scan = scan.select(stem(F.col("path")).alias("name"), F.col("path").alias("target"), "duration_seconds", "peak", "clipped")
    found = files.withColumn("refusal", refused(F.col("path"), F.col("length"))).withColumn("name", F.when(F.col("refusal").isNull(), stem(F.col("path"))))
    found = found.join(scan, "name", "left")
    return found.select("path", F.coalesce("refusal", F.when(F.col("target").isNull(), "undecodable")).alias("refusal"), "target", "duration_seconds", "peak", "clipped")


def reimports(meetings: DataFrame, working: DataFrame, originals: DataFrame) -> DataFrame:
    """meeting_id, source, reason of the ``meetings`` (meeting_id, imported_from) without ``working`` audio (meeting_id): a null reason is to be imported anew.

    ``originals`` (path) are the files that still exist.
    """
    lacking = meetings.join(working.select("meeting_id").distinct(), "meeting_id", "left_anti")
    there = originals.select(F.col("path").alias("source"), F.lit(True).alias("there")).distinct()
    source = F.nullif(F.trim("imported_from"), F.lit(""))
    rows = lacking.select("meeting_id", source.alias("source")).join(there, "source", "left")
    return rows.select("meeting_id", "source", F.when(F.col("source").isNull(), "not imported").when(F.col("there").isNull(), "original missing").alias("reason"))


def meeting_folders(spark: SparkSession, root: str) -> DataFrame:
    """folder, files, bytes, has_journal, has_metadata, audio for each folder below ``root`` that holds files, from the listing alone."""
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    rows = listed(spark, root).select(F.regexp_extract("path", r"([^/]+)/[^/]*$", 1).alias("folder"), name.alias("name"), "length")
    audio = F.lower("name").rlike(r"\.(wav|mp3)$")
    return rows.groupBy("folder").agg(F.count("*").alias("files"), F.sum("length").alias("bytes"), F.bool_or(F.col("name") == "journal.jsonl").alias("has_journal"), F.bool_or(F.col("name") == "metadata.json").alias("has_metadata"), F.array_sort(F.collect_set(F.when(audio, F.col("name")))).alias("audio"))


def pending_meetings(folders: DataFrame, states: DataFrame) -> DataFrame:
    """folder, files, audio of the ``folders`` with a journal that did not end: ``states`` are ``journals.journal_states`` of their entries, where a journal without a readable entry has no row."""
    ended = states.where(~F.col("recoverable")).select(F.col("meeting_id").alias("folder"))
    return folders.where("has_journal").join(ended, "folder", "left_anti").select("folder", "files", "audio")


def at_rate(blocks: DataFrame, rate: int = RATE) -> DataFrame:
    """``blocks`` (sample_rate, samples, ...); a block of another rate stops the job when it is read."""
    wrong = F.raise_error(F.concat(F.lit(f"samples must be at {rate} Hz, not "), F.col("sample_rate").cast("string")))
    kind = dict(blocks.dtypes)["samples"]
    return blocks.withColumn("samples", F.when(F.col("sample_rate") == rate, F.col("samples")).otherwise(wrong.cast(kind)))
