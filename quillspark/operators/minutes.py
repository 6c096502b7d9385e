"""Minutes by extraction: sentences of a transcript chosen by cues, topics by time, an overview, rendered as Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.text import NONE, UNKNOWN, Cues, due_date, is_blank, markdown_escaped, meaningful, sentences, trimmed, utf16_length
from quillspark.functions.timecode import clock_of_ms, timestamp_of_ms, timestamp_of_seconds

from .transcript import speaker_label

MOST_ITEMS = 20
TOPIC_MS = 600_000
TOPIC_POINTS = 5
#: The order of sentences in a meeting.
ORDER = ["start_ms", "arrival_seq", "pos"]


def meeting_sentences(segments: DataFrame, cues: Cues = Cues()) -> DataFrame:
    """meeting_id, start_ms, arrival_seq, pos, timestamp, label, text for every sentence of the segments."""
    rows = segments.where(~is_blank(F.col("text")))
    rows = rows.select("meeting_id", "start_ms", "arrival_seq", timestamp_of_ms(F.col("start_ms")).alias("timestamp"), speaker_label().alias("label"), F.posexplode(sentences(F.col("text"), cues.sentence_end)).alias("pos", "sentence"))
    return rows.withColumnRenamed("sentence", "text")


def _first(rows: DataFrame, most: int) -> DataFrame:
    # ranks up to a constant are cut in the map tasks: a long meeting sends few rows
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("meeting_id").orderBy(*ORDER))).where(F.col("rank") <= most)


def minutes_items(sentence_rows: DataFrame, cues: Cues = Cues(), most: int = MOST_ITEMS) -> DataFrame:
    """Decisions, actions and open points of each meeting: category, rank, timestamp, text, due.

    A sentence goes to the first list whose cue it has and that has room, in the order decision, action, open. Sentences without
    a cue stay in the map tasks; those of a meeting are numbered in one sort of its others.
    """
    names = ("decision", "action", "open")
    tested = F.transform(F.array("text"), lambda t: F.struct(*[t.rlike(getattr(cues, c)).alias(c) for c in names]))
    rows = sentence_rows.select("meeting_id", *ORDER, "timestamp", "text", F.element_at(tested, 1).alias("has")).where("has.decision OR has.action OR has.open")
    so_far = Window.partitionBy("meeting_id").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = F.lit(False)
    category = rank = F.lit(None)
    for c in names:
        rows = rows.withColumn(f"free_{c}", F.col(f"has.{c}") & ~placed).withColumn(f"n_{c}", F.count_if(f"free_{c}").over(so_far))
        own = F.col(f"free_{c}") & (F.col(f"n_{c}") <= most)
        category, rank, placed = F.when(own, F.lit(c)).otherwise(category), F.when(own, F.col(f"n_{c}")).otherwise(rank), placed | own
    items = rows.where(placed).select("meeting_id", category.alias("category"), rank.cast("long").alias("rank"), "timestamp", "text")
    return items.withColumn("due", F.when(F.col("category") == "action", due_date(F.col("text"), cues)))


def topics(sentence_rows: DataFrame, bucket_ms: int = TOPIC_MS, most: int = TOPIC_POINTS) -> DataFrame:
    """The longest sentences of each stretch of a meeting, in spoken order: bucket, title, time_range, rank, point."""
    rows = sentence_rows.withColumn("bucket", F.floor(F.col("start_ms") / bucket_ms)).withColumn("length", utf16_length(F.col("text")))
    group = Window.partitionBy("meeting_id", "bucket")
    rows = rows.withColumn("by_length", F.row_number().over(group.orderBy(F.desc("length"), *ORDER))).where(F.col("by_length") <= most)
    begin, end = F.col("bucket") * bucket_ms, (F.col("bucket") + 1) * bucket_ms
    return rows.select(
        "meeting_id", "bucket", F.concat(F.lit("時間帯 "), clock_of_ms(begin), F.lit(" - "), clock_of_ms(end)).alias("title"),
        F.concat(clock_of_ms(begin, True), F.lit(" 〜 "), clock_of_ms(end, True)).alias("time_range"),
        F.row_number().over(group.orderBy("start_ms", "by_length")).cast("long").alias("rank"),
        F.concat(F.lit("["), F.col("timestamp"), F.lit("] "), F.col("label"), F.lit(": "), F.col("text")).alias("point"))


def overview_text(seconds: Column, n_segments: Column, n_microphone: Column, n_system: Column, n_speakers: Column, opening: Column) -> Column:
    clusters = F.when(n_speakers > 0, F.concat(F.lit("、話者分離クラスタ "), n_speakers.cast("string"), F.lit(" 件"))).otherwise("")
    return F.concat(
        F.lit("録音時間 "), timestamp_of_seconds(seconds), F.lit("、発言 "), n_segments.cast("string"), F.lit(" 件（マイク "), n_microphone.cast("string"), F.lit(" 件 / PC音声 "), n_system.cast("string"), F.lit(" 件）"),
        clusters, F.lit("。"), F.coalesce(F.concat(F.lit("\n冒頭の発言: "), opening), F.lit("")))


def overview(segments: DataFrame, sentence_rows: DataFrame) -> DataFrame:
    """meeting_id, n_segments, n_microphone, n_system, n_speakers, duration_seconds, opening, text."""
    counts = segments.groupBy("meeting_id").agg(
        F.count("*").alias("n_segments"), F.count_if(F.col("source") == "Microphone").alias("n_microphone"), F.count_if(F.col("source") == "SystemAudio").alias("n_system"),
        F.count_distinct(F.when(F.col("speaker_id").isNotNull(), F.concat_ws(":", "source", "speaker_id"))).alias("n_speakers"), (F.max("end_ms") / 1000).alias("duration_seconds"))
    first = _first(sentence_rows, 3).where(utf16_length(F.col("text")) > 8).groupBy("meeting_id").agg(F.sort_array(F.collect_list(F.struct("rank", "text"))).alias("x"))
    opening = F.array_join(F.transform(F.slice("x", 1, 2), lambda r: r["text"]), " / ")
    rows = counts.join(first.select("meeting_id", opening.alias("opening")), "meeting_id", "left")
    text = overview_text(F.col("duration_seconds"), *[F.col(f"n_{c}") for c in ("segments", "microphone", "system", "speakers")], F.col("opening"))
    return rows.withColumn("text", text)


#: The columns of a template: what minutes say, before they are rendered.
TEMPLATE = ["meeting_id", "overview", "decisions", "topics", "actions", "open", "notes"]
_ACTION = "struct<task:string,owner:string,due:string,timestamp:string>"
_TOPIC = "struct<title:string,time_range:string,points:array<string>>"

# The texts of the rendered minutes.
EXTRACTIVE = "抽出型（ローカル・AIモデル不使用）"
NOTICE = "> この議事録は文字起こしの内容のみから作成されています。\n> 文字起こしに存在しない情報（担当者・期限など）は「要確認」と記載しています。\n"
NO_DECISIONS = "この会議で明確に決定された事項は文字起こしからは特定できませんでした。（要確認）"
NO_OPEN = "継続検討事項は文字起こしからは特定できませんでした。（要確認）"
NO_ACTIONS = "| 内容 | 担当 | 期限 |\n| --- | --- | --- |\n| 特定できませんでした | 要確認 | 要確認 |\n"
ACTIONS_HEAD = "| 内容 | 担当 | 期限 | 該当時刻 |\n| --- | --- | --- | --- |\n"
MECHANICAL = "この議事録は文字起こしからキーフレーズを抽出して作成した機械的な要約です。内容の正確性は必ず原文（transcript.md）で確認してください。"
TEXT_NOTICE = "※ 文字起こしに存在しない情報は「要確認」と記載しています。"


def _in_order(of: Column, value: Column, *order: str) -> Column:
    """``value`` of a group's rows for which ``of`` holds, in that order."""
    return F.transform(F.sort_array(F.collect_list(F.when(of, F.struct(*order, value.alias("value"))))), lambda r: r["value"])


def extractive_template(segments: DataFrame, meetings: DataFrame, cues: Cues = Cues()) -> DataFrame:
    """TEMPLATE of each of ``meetings`` (meeting_id, duration_seconds, warnings), by extraction; one without segments has only its overview and notes."""
    spoken = meeting_sentences(segments, cues)
    items = minutes_items(spoken, cues)
    quoted = F.concat(F.lit("["), F.col("timestamp"), F.lit("] "), F.col("text"))
    action = F.struct(F.col("text").alias("task"), F.lit(UNKNOWN).alias("owner"), F.col("due").alias("due"), F.col("timestamp").alias("timestamp"))
    is_ = lambda c: F.col("category") == c
    listed = items.groupBy("meeting_id").agg(_in_order(is_("decision"), quoted, "rank").alias("decisions"), _in_order(is_("action"), action, "rank").alias("actions"), _in_order(is_("open"), quoted, "rank").alias("open"))
    points = topics(spoken).groupBy("meeting_id", "bucket", "title", "time_range").agg(_in_order(F.lit(True), F.col("point"), "rank").alias("points"))
    found = points.groupBy("meeting_id").agg(_in_order(F.lit(True), F.struct("title", "time_range", "points"), "bucket").alias("topics"))
    said = spoken.groupBy("meeting_id").agg(F.count("*").alias("n_sentences"))
    rows = meetings.select("meeting_id", F.col("duration_seconds").alias("seconds"), "warnings").join(overview(segments, spoken), "meeting_id", "left").join(listed, "meeting_id", "left").join(found, "meeting_id", "left").join(said, "meeting_id", "left")
    number = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("string")
    notes = F.concat(
        F.array(F.lit(MECHANICAL), F.concat(F.lit("対象発言数: "), number("n_segments"), F.lit(" / 抽出対象文数: "), number("n_sentences"))),
        F.transform(F.coalesce("warnings", F.array().cast("array<string>")), lambda w: F.concat(F.lit("録音時の警告: "), w)))
    text = overview_text(F.coalesce("seconds", F.lit(0.0)), *[F.coalesce(F.col(f"n_{c}"), F.lit(0)) for c in ("segments", "microphone", "system", "speakers")], F.col("opening"))
    lists = {"decisions": "array<string>", "topics": f"array<{_TOPIC}>", "actions": f"array<{_ACTION}>", "open": "array<string>"}
    return rows.select("meeting_id", text.alias("overview"), *[F.coalesce(F.col(c), F.array().cast(kind)).cast(kind).alias(c) for c, kind in lists.items()], notes.alias("notes")).select(*TEMPLATE)


def filled_template(sections: DataFrame, map_topics: DataFrame | None = None) -> DataFrame:
    """TEMPLATE from a model's parsed answers: ``sections`` (response_id, section, position, line) of ``responses.sections``.

    Lines that say nothing are left out, owner and due date stay open whatever the model wrote, and topics are those of the map phase (``map_topics``:
    response_id, block, title, time_range, points) where it gave any, else one topic of the answer's own lines.
    """
    lines = sections.withColumn("line", F.explode(meaningful(F.array("line")))).unionByName(sections.where("section = 'overview'").withColumn("section", F.lit("whole")))
    is_ = lambda c: F.col("section") == c
    action = F.struct(F.col("line").alias("task"), F.lit(UNKNOWN).alias("owner"), F.lit(UNKNOWN).alias("due"), F.lit(None).cast("string").alias("timestamp"))
    rows = lines.groupBy("response_id").agg(
        trimmed(F.array_join(_in_order(is_("whole"), F.col("line"), "position"), "\n")).alias("overview"), *[_in_order(is_(c), F.col("line"), "position").alias(c) for c in ("decisions", "open", "notes")],
        _in_order(is_("actions"), action, "position").alias("actions"), _in_order(is_("topics"), F.col("line"), "position").alias("own"))
    own = F.when(F.size("own") > 0, F.array(F.struct(F.lit("議題別内容").alias("title"), F.lit("").alias("time_range"), F.col("own").alias("points")))).otherwise(F.array().cast(f"array<{_TOPIC}>"))
    if map_topics is None:
        rows = rows.withColumn("topics", own)
    else:
        mapped = map_topics.groupBy("response_id").agg(_in_order(F.lit(True), F.struct("title", "time_range", "points"), "block").alias("mapped"))
        rows = rows.join(mapped, "response_id", "left").withColumn("topics", F.coalesce("mapped", own))
    return rows.withColumnRenamed("response_id", "meeting_id").select(*TEMPLATE)


def _each(items: str | Column, line, empty: str) -> Column:
    """The lines of ``items``, or ``empty``."""
    return F.when(F.size(items) > 0, F.array_join(F.transform(items, line), "")).otherwise(F.lit(empty))


def _overview_or_unknown() -> Column:
    return F.when(is_blank(F.col("overview")), F.lit(UNKNOWN)).otherwise(trimmed(F.col("overview")))


def template_markdown(template: DataFrame, meetings: DataFrame, generator: str = EXTRACTIVE) -> DataFrame:
    """meeting_id, markdown of each ``template``; ``meetings`` holds meeting_id, title, folder_name (in place of a missing title), started_at, stopped_at, duration_seconds."""
    rows = template.join(meetings.select("meeting_id", F.coalesce("title", "folder_name").alias("name"), "started_at", "stopped_at", F.col("duration_seconds").alias("seconds")), "meeting_id")
    bullet = lambda x: F.concat(F.lit("- "), trimmed(x), F.lit("\n"))
    topic = lambda t: F.concat(F.lit("### "), t["title"], F.when(is_blank(t["time_range"]), F.lit("")).otherwise(F.concat(F.lit(" （"), t["time_range"], F.lit("）"))), F.lit("\n\n"), _each(t["points"], bullet, f"- {UNKNOWN}\n"), F.lit("\n"))
    task = lambda a: F.concat(F.lit("| "), markdown_escaped(a["task"]), F.lit(" | "), markdown_escaped(a["owner"]), F.lit(" | "), markdown_escaped(a["due"]), F.lit(" | "), F.coalesce(a["timestamp"], F.lit("-")), F.lit(" |\n"))
    actions = F.when(F.size("actions") > 0, F.concat(F.lit(ACTIONS_HEAD), F.array_join(F.transform("actions", task), ""))).otherwise(F.lit(NO_ACTIONS))
    text = F.concat(
        F.lit("# 会議議事録\n\n| 項目 | 内容 |\n| --- | --- |\n| 会議名 | "), "name", F.lit(" |\n| 日時 | "), F.date_format("started_at", "yyyy-MM-dd HH:mm"), F.lit(" - "), F.date_format(F.coalesce("stopped_at", "started_at"), "HH:mm"),
        F.lit(" |\n| 録音時間 | "), timestamp_of_seconds(F.col("seconds")), F.lit(f" |\n| 生成方法 | {generator} |\n\n{NOTICE}\n## 1. 概要\n\n"), _overview_or_unknown(), F.lit("\n\n## 2. 決定事項\n\n"), _each("decisions", bullet, f"- {NO_DECISIONS}\n"),
        F.lit("\n## 3. 議題別内容\n\n"), _each("topics", topic, f"- {UNKNOWN}\n\n"), F.lit("## 4. ToDo・ネクストアクション\n\n"), actions, F.lit("\n## 5. 継続検討事項\n\n"), _each("open", bullet, f"- {NO_OPEN}\n"),
        F.lit("\n## 6. 補足\n\n"), _each("notes", bullet, f"- {NONE}\n"), F.lit("\n"))
    return rows.select("meeting_id", text.alias("markdown"))


def template_text(template: DataFrame, meetings: DataFrame, generator: str = EXTRACTIVE) -> DataFrame:
    """meeting_id, text of each ``template``, plain; ``meetings`` as for ``template_markdown``."""
    rows = template.join(meetings.select("meeting_id", F.coalesce("title", "folder_name").alias("name"), "started_at", F.col("duration_seconds").alias("seconds")), "meeting_id")
    item = lambda x: F.concat(F.lit("  - "), trimmed(x), F.lit("\n"))
    topic = lambda t: F.concat(F.lit("  "), t["title"], F.when(is_blank(t["time_range"]), F.lit("")).otherwise(F.concat(F.lit(" ("), t["time_range"], F.lit(")"))), F.lit("\n"), _each(t["points"], lambda p: F.concat(F.lit("    - "), p, F.lit("\n")), ""), F.lit("\n"))
    task = lambda a: F.concat(F.lit("  - "), a["task"], F.lit(" / 担当: "), a["owner"], F.lit(" / 期限: "), a["due"], F.lit("\n"))
    head = lambda title: F.lit(f"{title}\n{'-' * 40}\n")
    text = F.concat(
        F.lit(f"会議議事録\n{'=' * 40}\n会議名   : "), "name", F.lit("\n日時     : "), F.date_format("started_at", "yyyy-MM-dd HH:mm"), F.lit("\n録音時間 : "), timestamp_of_seconds(F.col("seconds")), F.lit(f"\n生成方法 : {generator}\n\n{TEXT_NOTICE}\n\n"),
        head("1. 概要"), _overview_or_unknown(), F.lit("\n\n"), head("2. 決定事項"), _each("decisions", item, f"  {UNKNOWN}\n"), F.lit("\n"), head("3. 議題別内容"), _each("topics", topic, f"  {UNKNOWN}\n\n"),
        head("4. ToDo・ネクストアクション"), _each("actions", task, f"  {UNKNOWN}\n"), F.lit("\n"), head("5. 継続検討事項"), _each("open", item, f"  {UNKNOWN}\n"), F.lit("\n"), head("6. 補足"), _each("notes", item, f"  {NONE}\n"), F.lit("\n"))
    return rows.select("meeting_id", text.alias("text"))


def rendered(segments: DataFrame, meetings: DataFrame, cues: Cues = Cues()) -> DataFrame:
    """meeting_id, markdown: the extractive minutes of each of ``meetings``, all six sections always present."""
    return template_markdown(extractive_template(segments, meetings, cues), meetings)


def rendered_text(segments: DataFrame, meetings: DataFrame, cues: Cues = Cues()) -> DataFrame:
    """meeting_id, text: the extractive minutes of each of ``meetings`` as plain text."""
    return template_text(extractive_template(segments, meetings, cues), meetings)
