"""Journals of meetings: replay of segments, state of each journal, recovery of interrupted meetings.

An entry has meeting_id, line_no, kind, segment_id, start_ms, text, duration_seconds. All answers are aggregates over a
journal's entries, so Spark combines them before the shuffle however long a journal is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RECOVERY_WARNING = "異常終了から復旧したデータです。末尾が欠けている可能性があります。"


def replayed(entries: DataFrame) -> DataFrame:
    """The segments that a journal leaves: the last entry of each id, in the order of start, then of first mention.

    A removal is an entry with an empty text, and so stays as an empty segment.
    """
    rows = entries.where(F.col("kind").isin("Segment", "SegmentUpdate") & F.col("segment_id").isNotNull())
    last = rows.groupBy("meeting_id", "segment_id").agg(F.max_by(F.struct("start_ms", "text"), "line_no").alias("last"), F.min("line_no").alias("first_seen"))
    order = Window.partitionBy("meeting_id").orderBy("last.start_ms", "first_seen")
    return last.select("meeting_id", "segment_id", "last.start_ms", "last.text", F.row_number().over(order).cast("long").alias("position"))


def journal_states(entries: DataFrame) -> DataFrame:
    """For each meeting: entries, the last kind, the first header's line, the last progress, segments, whether it is to be recovered."""
    is_segment = F.col("kind").isin("Segment", "SegmentUpdate")
    states = entries.groupBy("meeting_id").agg(
        F.count("*").alias("n_entries"), F.max_by("kind", "line_no").alias("last_kind"), F.min(F.when(F.col("kind") == "Header", F.col("line_no"))).alias("header_line"),
        F.max_by("duration_seconds", F.when(F.col("duration_seconds").isNotNull(), F.col("line_no"))).alias("duration_seconds"),
        F.count_distinct(F.when(is_segment, F.col("segment_id"))).alias("n_segments"))
    return states.withColumn("recoverable", F.col("last_kind") != "Completed")


def recovered(states: DataFrame, audio: DataFrame) -> DataFrame:
    """Metadata of the recoverable meetings: the audio's length if there is audio, else the last progress; with the warning."""
    joined = states.where("recoverable").join(audio.select("meeting_id", "audio_seconds"), "meeting_id", "left")
    seconds = F.when(F.col("audio_seconds") > 0, F.col("audio_seconds")).otherwise(F.coalesce("duration_seconds", F.lit(0.0)))
    return joined.select("meeting_id", "n_segments", seconds.alias("duration_seconds"), F.lit(True).alias("recovered_from_crash"), F.array(F.lit(RECOVERY_WARNING)).alias("warnings"))


def dismissed(entries: DataFrame, meetings: DataFrame) -> DataFrame:
    """Entries without the journals of the dismissed meetings."""
    return entries.join(meetings.select("meeting_id"), "meeting_id", "left_anti")
