"""The driver's tables in the shapes that the operators take; each with its DuckDB counterpart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions.text import Cues

#: Cues for the invented prose of the test tables, which has no Japanese.
PROSE_CUES = Cues(decision="(tion|ción)", action="(ing|ment|keit)", open="(er|re)", due="((the|les|die|las) [a-z]+)", sentence_end="[.!?\n]")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as segments of meetings, 600 ms a character."""
    earlier = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    source = F.when(F.col("role") == "user", "Microphone").when(F.col("role") == "assistant", "SystemAudio").otherwise("Imported")
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("meeting_id"), "turn", "text", source.alias("source"), "conv_id", (F.length("text") * 600).cast("long").alias("ms"))
    rows = rows.withColumn("start_ms", F.coalesce(F.sum("ms").over(earlier), F.lit(0)))
    return rows.select(
        "meeting_id", F.concat_ws("-", "meeting_id", "turn").alias("id"), "start_ms", (F.col("start_ms") + F.col("ms")).alias("end_ms"), "source",
        F.when(F.col("source") != "Imported", (F.col("turn") % 3).cast("int")).alias("speaker_id"), F.lit(None).cast("string").alias("speaker_name"),
        "text", F.lit(False).alias("is_edited"), F.col("turn").alias("arrival_seq"))


SEGMENTS_SQL = """
t AS (SELECT conv_id AS meeting_id, turn, text, CASE role WHEN 'user' THEN 'Microphone' WHEN 'assistant' THEN 'SystemAudio' ELSE 'Imported' END AS source,
             CAST(length(text) * 600 AS BIGINT) AS ms FROM conversations),
segments AS (SELECT meeting_id, meeting_id || '-' || turn AS id, start_ms, start_ms + ms AS end_ms, source,
                    CASE WHEN source <> 'Imported' THEN CAST(turn % 3 AS INTEGER) END AS speaker_id, CAST(NULL AS VARCHAR) AS speaker_name,
                    text, false AS is_edited, turn AS arrival_seq
             FROM (SELECT *, CAST(coalesce(sum(ms) OVER (PARTITION BY meeting_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_ms FROM t))
"""


def previous_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same segments half a minute later, every second one with a name typed by a person."""
    named = F.when(F.col("arrival_seq") % 2 == 0, F.concat(F.lit("Person "), F.col("speaker_id").cast("string")))
    return segments(spark, sf_dir).select("meeting_id", "id", (F.col("start_ms") + 30000).alias("start_ms"), (F.col("end_ms") + 30000).alias("end_ms"), "source", "speaker_id", named.alias("speaker_name"), "arrival_seq")


PREVIOUS_SQL = """
previous AS (SELECT meeting_id, id, start_ms + 30000 AS start_ms, end_ms + 30000 AS end_ms, source, speaker_id,
                    CASE WHEN arrival_seq % 2 = 0 THEN 'Person ' || CAST(speaker_id AS VARCHAR) END AS speaker_name, arrival_seq FROM segments)
"""


def journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as journals: one for each user, entries in the order of their ids."""
    kind = F.create_map(*[F.lit(x) for x in ("signup", "Header", "click", "Segment", "view", "SegmentUpdate", "purchase", "Progress")])
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("meeting_id"), F.col("event_id").alias("line_no"), F.coalesce(kind[F.col("event_type")], F.lit("Note")).alias("kind"), "value")
    is_segment = F.col("kind").isin("Segment", "SegmentUpdate")
    return rows.select(
        "meeting_id", "line_no", "kind",
        F.when(is_segment, F.concat(F.lit("s"), (F.col("line_no") % 7).cast("string"))).alias("segment_id"),
        F.when(is_segment, F.floor(F.col("value") * 1000).cast("long")).alias("start_ms"),
        F.when(is_segment, F.concat(F.lit("text "), F.col("line_no").cast("string"))).alias("text"),
        F.when(F.col("kind") == "Progress", F.col("value")).alias("duration_seconds"))


JOURNAL_SQL = """
j0 AS (SELECT user_id AS meeting_id, event_id AS line_no, CASE event_type WHEN 'signup' THEN 'Header' WHEN 'click' THEN 'Segment' WHEN 'view' THEN 'SegmentUpdate' WHEN 'purchase' THEN 'Progress' ELSE 'Note' END AS kind, value FROM events),
journal AS (SELECT meeting_id, line_no, kind, CASE WHEN kind IN ('Segment', 'SegmentUpdate') THEN 's' || (line_no % 7) END AS segment_id,
                   CASE WHEN kind IN ('Segment', 'SegmentUpdate') THEN CAST(floor(value * 1000) AS BIGINT) END AS start_ms,
                   CASE WHEN kind IN ('Segment', 'SegmentUpdate') THEN 'text ' || line_no END AS text,
                   CASE WHEN kind = 'Progress' THEN value END AS duration_seconds FROM j0)
"""


def levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as levels of streams: stream, seq (from 1), at (seconds), value (-1 to 1), db."""
    order = Window.partitionBy("stream").orderBy("event_id")
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("stream"), "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "value")
    scaled = F.least(F.col("value") / 250.0, F.lit(2.0)) - 1.0
    return rows.select("stream", F.row_number().over(order).cast("long").alias("seq"), (F.col("us") / 1e6).alias("at"), scaled.alias("value"), F.when(F.col("value") <= 1e-9, F.lit(-120.0)).otherwise(20.0 * F.log10(F.col("value") / 500.0)).alias("db"))


LEVELS_SQL = """
levels AS (SELECT user_id AS stream, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq, epoch_us(ts) / 1e6 AS secs,
                  least(value / 250.0, 2.0) - 1.0 AS value, CASE WHEN value <= 1e-9 THEN -120.0 ELSE 20.0 * log10(value / 500.0) END AS db FROM events)
"""


def short_blocks(spark: SparkSession, sf_dir: str, size: int = 32) -> DataFrame:
    """Samples in blocks of bounded length: stream, block (from 0), samples."""
    rows = levels(spark, sf_dir).withColumn("block", F.floor((F.col("seq") - 1) / size))
    rows = rows.groupBy("stream", "block").agg(F.sort_array(F.collect_list(F.struct("seq", "value"))).alias("x"))
    return rows.select("stream", "block", F.transform("x", lambda v: v["value"]).alias("samples"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as responses of lines; every fifth line is a heading."""
    heads = F.array(*[F.lit(x) for x in ("【概要】", "## 決定事項", "**議題別内容:**", "ToDo・ネクストアクション", "継続検討", "補足")])
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("response_id"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("ord", "raw"))
    head = F.element_at(heads, (F.floor(F.col("ord") / 5) % 6 + 1).cast("int"))
    return rows.select("response_id", F.col("ord").cast("long").alias("ord"), F.when(F.col("ord") % 5 == 2, head).otherwise(F.col("raw")).alias("line"))


LINES_SQL = """
l0 AS (SELECT doc_id AS response_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
l1 AS (SELECT response_id, unnest(range(len(parts))) AS ord, unnest(parts) AS raw FROM l0),
lines AS (SELECT response_id, ord, CASE WHEN ord % 5 = 2 THEN ['【概要】', '## 決定事項', '**議題別内容:**', 'ToDo・ネクストアクション', '継続検討', '補足'][(ord // 5) % 6 + 1] ELSE raw END AS line FROM l1)
"""
