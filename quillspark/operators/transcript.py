"""Transcripts as tables of segments: labels, ordering, edits, speakers, carry-over of names, export as text.

A segment has meeting_id, id, start_ms, end_ms, source, speaker_id, speaker_name, text, is_edited, arrival_seq.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.text import is_blank, markdown_escaped, trimmed
from quillspark.functions.timecode import timestamp_of_ms, timestamp_of_seconds

#: What sources are called, in their order.
SOURCES = {"Microphone": "マイク", "SystemAudio": "PC音声", "Mixed": "ミックス", "Imported": "インポート音声"}
BUCKET_MS = 60_000


def source_label(source: Column) -> Column:
    return F.coalesce(*[F.when(source == k, F.lit(v)) for k, v in SOURCES.items()], F.lit("不明"))


def source_rank(source: Column) -> Column:
    return F.coalesce(*[F.when(source == k, F.lit(i)) for i, k in enumerate(SOURCES)], F.lit(len(SOURCES)))


def speaker_label() -> Column:
    """The source, with the speaker's name or else number."""
    who = F.when(~is_blank(F.col("speaker_name")), F.col("speaker_name"))
    who = F.coalesce(who, F.concat(F.lit("Speaker "), (F.col("speaker_id") + 1).cast("string")))
    return F.concat_ws(" / ", source_label(F.col("source")), who)


def timeline(segments: DataFrame) -> DataFrame:
    """Segments in their order in each meeting (start, then arrival), with timestamp and label."""
    order = Window.partitionBy("meeting_id").orderBy("start_ms", "arrival_seq")
    return segments.select("meeting_id", "id", F.row_number().over(order).cast("long").alias("position"), timestamp_of_ms(F.col("start_ms")).alias("timestamp"), speaker_label().alias("label"), F.greatest(F.lit(0).cast("long"), F.col("end_ms") - F.col("start_ms")).alias("duration_ms"))


def carry_over_names(current: DataFrame, previous: DataFrame, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """``current`` with name and number of the named ``previous`` segment of the same source that overlaps it most.

    Ties go to the earlier start. Both sides meet by (meeting, source, time bucket), so a long meeting is dealt over its buckets
    and the overlap is tested only within them; a pair that meets in several buckets gives the same best.
    """
    def dealt(df: DataFrame) -> DataFrame:
        return df.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("start_ms") / bucket_ms), F.floor(F.greatest("start_ms", "end_ms") / bucket_ms))))

    named = previous.where(~is_blank(F.col("speaker_name"))).select("meeting_id", "source", F.col("start_ms").alias("p_start"), F.col("end_ms").alias("p_end"), F.col("speaker_id").alias("p_id"), F.col("speaker_name").alias("p_name"), F.col("arrival_seq").alias("p_seq"), "start_ms", "end_ms")
    left = dealt(current.select("meeting_id", "id", "source", "start_ms", "end_ms"))
    pairs = left.join(dealt(named).drop("start_ms", "end_ms"), ["meeting_id", "source", "bucket"])
    overlap = F.least("p_end", "end_ms") - F.greatest("p_start", "start_ms")
    best = pairs.withColumn("overlap", overlap).where("overlap > 0").groupBy("meeting_id", "id").agg(F.max_by(F.struct("p_id", "p_name"), F.struct("overlap", -F.col("p_start"), -F.col("p_seq"))).alias("best"))
    joined = current.join(best, ["meeting_id", "id"], "left")
    take = F.col("best").isNotNull()
    return joined.withColumn("speaker_id", F.when(take, F.col("best.p_id")).otherwise(F.col("speaker_id"))).withColumn("speaker_name", F.when(take, F.col("best.p_name")).otherwise(F.col("speaker_name"))).select(*current.columns)


def with_known_names(segments: DataFrame, names: DataFrame) -> DataFrame:
    """Names by (meeting_id, source, speaker_id) put over those of the segments; others stay."""
    known = names.select("meeting_id", "source", "speaker_id", F.col("name").alias("known"))
    joined = segments.join(known, ["meeting_id", "source", "speaker_id"], "left")
    return joined.withColumn("speaker_name", F.coalesce("known", "speaker_name")).select(*segments.columns)


def speakers(segments: DataFrame, names: DataFrame) -> DataFrame:
    """The distinct speakers of each meeting in the order of sources and numbers, with their known names."""
    found = segments.where("speaker_id IS NOT NULL").select("meeting_id", "source", "speaker_id").distinct()
    joined = found.join(names.select("meeting_id", "source", "speaker_id", "name"), ["meeting_id", "source", "speaker_id"], "left")
    order = Window.partitionBy("meeting_id").orderBy(source_rank(F.col("source")), "speaker_id")
    return joined.withColumn("position", F.row_number().over(order).cast("long"))


def merged_names(old: DataFrame, new: DataFrame) -> DataFrame:
    """Two maps of names as one; where both have a key, ``new`` wins."""
    keys = ["meeting_id", "source", "speaker_id"]
    both = old.withColumn("age", F.lit(0)).unionByName(new.withColumn("age", F.lit(1)))
    return both.groupBy(*keys).agg(F.max_by("name", "age").alias("name"))


def rename_requests(requests: DataFrame) -> DataFrame:
    """Requests (…, name, default_label) that are not blank and not the default label, trimmed."""
    name = trimmed(F.col("name"))
    return requests.where(~is_blank(F.col("name")) & (name != F.col("default_label"))).withColumn("name", name)


def renamed(segments: DataFrame, requests: DataFrame) -> DataFrame:
    """Segments of the requested speakers under their new names; not marked as edited."""
    return with_known_names(segments, requests)


def rename_counts(segments: DataFrame, requests: DataFrame) -> DataFrame:
    """How many segments each request changes."""
    keys = ["meeting_id", "source", "speaker_id"]
    counts = segments.where("speaker_id IS NOT NULL").groupBy(*keys).agg(F.count("*").alias("affected"))
    return requests.join(counts, keys, "left").withColumn("affected", F.coalesce("affected", F.lit(0).cast("long")))


def edited(segments: DataFrame, edits: DataFrame) -> DataFrame:
    """Texts replaced by those of ``edits`` (meeting_id, id, new_text), and marked as edited."""
    joined = segments.join(edits.select("meeting_id", "id", "new_text"), ["meeting_id", "id"], "left")
    change = F.col("new_text").isNotNull()
    return joined.withColumn("text", F.coalesce("new_text", "text")).withColumn("is_edited", F.col("is_edited") | change).select(*segments.columns)


def without(segments: DataFrame, ids: DataFrame) -> DataFrame:
    """Segments but for the removed ``ids`` (meeting_id, id)."""
    return segments.join(ids.select("meeting_id", "id"), ["meeting_id", "id"], "left_anti")


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those of the same keys."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def added(segments: DataFrame, new: DataFrame, names: DataFrame) -> DataFrame:
    """``segments`` and the ``new`` ones (the same columns), which arrive after those of their meeting in their own order of arrival, under the speakers' known ``names``."""
    last = segments.groupBy("meeting_id").agg(F.max("arrival_seq").alias("last"))
    place = F.row_number().over(Window.partitionBy("meeting_id").orderBy("arrival_seq", "id"))
    late = with_known_names(new, names).join(last, "meeting_id", "left").withColumn("arrival_seq", F.coalesce("last", F.lit(-1)) + place)
    return segments.unionByName(late.select(*segments.columns))


def manual(requests: DataFrame) -> DataFrame:
    """Segments typed by a person (meeting_id, id, start_ms, source, text, arrival_seq): without length or speaker, marked as edited."""
    nothing = {"speaker_id": "int", "speaker_name": "string"}
    return requests.withColumns({"end_ms": F.col("start_ms"), "is_edited": F.lit(True), **{c: F.lit(None).cast(kind) for c, kind in nothing.items()}})


def replaced(segments: DataFrame, new: DataFrame, names: DataFrame) -> DataFrame:
    """``segments`` with the whole transcripts of the meetings in ``new`` in place of theirs; arrivals are numbered by start, and the known ``names`` survive."""
    kept = segments.join(new.select("meeting_id").distinct(), "meeting_id", "left_anti")
    order = Window.partitionBy("meeting_id").orderBy("start_ms", "arrival_seq", "id")
    fresh = with_known_names(new, names).withColumn("arrival_seq", F.row_number().over(order) - 1)
    return kept.unionByName(fresh.select(*segments.columns))


def journal_of(segments: DataFrame, kind: str = "Segment") -> DataFrame:
    """meeting_id, id, kind, line: the journal's line for each segment that is added (``Segment``) or changed (``SegmentUpdate``); what is null is left out of it."""
    segment = F.struct("id", F.col("start_ms").alias("startMs"), F.col("end_ms").alias("endMs"), "source", F.col("speaker_id").alias("speakerId"), F.col("speaker_name").alias("speakerName"), "text", F.col("is_edited").alias("isEdited"))
    return segments.select("meeting_id", "id", F.lit(kind).alias("kind"), F.to_json(F.struct(F.lit(kind).alias("kind"), segment.alias("segment"))).alias("line"))


def removal_entries(segments: DataFrame, ids: DataFrame) -> DataFrame:
    """The journal's lines for the removed ``ids`` (meeting_id, id): updates to an empty text, which a replay turns into the removal."""
    gone = segments.join(ids.select("meeting_id", "id"), ["meeting_id", "id"], "left_semi")
    return journal_of(gone.withColumn("text", F.lit("")).withColumn("is_edited", F.lit(True)), "SegmentUpdate")


# The texts of exported transcripts.
NOTHING_SAID, NOTHING_SAID_MARKDOWN = "(認識された発言はありません)\n", "_認識された発言はありません。_\n"
BYTE_ORDER_MARK = "\ufeff"


def exported_text(segments: DataFrame, meetings: DataFrame) -> DataFrame:
    """meeting_id, text: the transcript of each of ``meetings`` (as for ``header_lines``) as plain text, with its header; one without segments says so."""
    bodies = said(segments).select("meeting_id", F.col("text").alias("body"))
    rows = header_lines(meetings, "  ").join(bodies, "meeting_id", "left")
    return rows.select("meeting_id", F.concat(F.lit(f"文字起こし\n{'=' * 40}\n"), "header", F.lit("\n"), F.coalesce("body", F.lit(NOTHING_SAID))).alias("text"))


def exported_markdown(segments: DataFrame, meetings: DataFrame) -> DataFrame:
    """meeting_id, text: the transcript of each of ``meetings`` (as for ``header_lines``, and diarized) as Markdown, with a table of its details."""
    bodies = _exported(segments, lambda s: F.concat(F.lit("**["), s["timestamp"], F.lit("] "), markdown_escaped(s["label"]), F.lit("**\n\n"), s["text"], F.lit("\n\n")))
    or_ = lambda c, other: markdown_escaped(F.coalesce(F.col(c), F.lit(other)))
    details = [
        ("会議名", markdown_escaped(F.coalesce("title", "folder_name"))), ("開始日時", F.concat(F.date_format("started_at", "yyyy-MM-dd HH:mm:ss"), F.lit(" "), "utc_offset")), ("録音時間", timestamp_of_seconds(F.col("duration_seconds"))), ("音声ファイル", markdown_escaped(F.col("audio_file_name"))),
        ("マイク", or_("microphone", "未設定")), ("PC音声", or_("render_device", "未設定")), ("音声認識モデル", or_("model_id", "なし")), ("話者分離", F.when(F.col("diarized"), "あり").otherwise("なし")), ("復旧", F.when(F.col("recovered"), "異常終了から復旧したデータです"))]
    table = F.array_join(F.array_compact(F.array(*[F.concat(F.lit(f"| {name} | "), value, F.lit(" |\n")) for name, value in details])), "")
    head = F.concat(F.lit("# 文字起こし — "), F.date_format("started_at", "yyyy-MM-dd HH:mm"), F.lit("\n\n| 項目 | 内容 |\n| --- | --- |\n"), table, F.lit("\n## 本文\n\n"))
    rows = meetings.select("meeting_id", head.alias("head")).join(bodies.select("meeting_id", F.col("text").alias("body")), "meeting_id", "left")
    return rows.select("meeting_id", F.concat("head", F.coalesce("body", F.lit(NOTHING_SAID_MARKDOWN))).alias("text"))


def said(segments: DataFrame) -> DataFrame:
    """meeting_id, text: what was said in each meeting, without a header."""
    return _exported(segments, lambda s: F.concat(F.lit("["), s["timestamp"], F.lit("] ["), s["label"], F.lit("]\n"), s["text"], F.lit("\n\n")))


def _exported(segments: DataFrame, render) -> DataFrame:
    # a document is one value, so its segments meet: as many as one meeting has
    row = F.struct("start_ms", "arrival_seq", timestamp_of_ms(F.col("start_ms")).alias("timestamp"), speaker_label().alias("label"), trimmed(F.col("text")).alias("text"))
    rows = segments.groupBy("meeting_id").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    return rows.select("meeting_id", F.array_join(F.transform("rows", render), "").alias("text"))


def header_lines(meetings: DataFrame, indent: str = "") -> DataFrame:
    """meeting_id, header: the lines above an exported transcript.

    ``meetings`` holds meeting_id, title, folder_name (in place of a missing title), started_at, utc_offset, duration_seconds, audio_file_name,
    microphone, render_device, model_id and recovered.
    """
    lines = [
        F.concat(F.lit("会議名      : "), F.coalesce("title", "folder_name")), F.concat(F.lit("開始日時    : "), F.date_format("started_at", "yyyy-MM-dd HH:mm:ss"), F.lit(" "), "utc_offset"),
        F.concat(F.lit("録音時間    : "), timestamp_of_seconds(F.col("duration_seconds"))), F.concat(F.lit("音声ファイル: "), "audio_file_name"), F.concat(F.lit("マイク      : "), F.coalesce("microphone", F.lit("未設定"))),
        F.concat(F.lit("PC音声      : "), F.coalesce("render_device", F.lit("未設定"))), F.concat(F.lit("認識モデル  : "), F.coalesce("model_id", F.lit("なし"))), F.when(F.col("recovered"), F.lit("備考        : 異常終了から復旧したデータです"))]
    shown = F.transform(F.array_compact(F.array(*lines)), lambda x: F.concat(F.lit(indent), x, F.lit("\n")))
    return meetings.select("meeting_id", F.array_join(shown, "").alias("header"))


def cleared(rows: DataFrame, meetings: DataFrame) -> DataFrame:
    """``rows`` of a transcript, or its speakers' names, without those of the ``meetings`` (meeting_id) that are cleared."""
    return rows.join(meetings.select("meeting_id").distinct(), "meeting_id", "left_anti")
