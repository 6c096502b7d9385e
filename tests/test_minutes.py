"""Japanese cues, sections and rendering, on small transcripts."""

from quillspark.functions import text as ft
from quillspark.operators import minutes, responses, summaries, transcript
from pyspark.sql import functions as F

SEGMENT = "meeting_id long, id string, start_ms long, end_ms long, source string, speaker_id int, speaker_name string, text string, is_edited boolean, arrival_seq long"


def meeting(spark, *texts, start=0):
    rows = [(1, str(i), start + i * 1000, start + i * 1000 + 900, "Microphone", None, None, t, False, i) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SEGMENT)


def items(spark, *texts):
    rows = minutes.minutes_items(minutes.meeting_sentences(meeting(spark, *texts))).orderBy("category", "rank").collect()
    return [(r.category, r.rank, r.text, r.due) for r in rows]


def test_cues_and_due_dates(spark):
    found = items(spark, "予算は承認されました。田中さん、来週までに資料を作成します。", "この課題は持ち帰りです。はい。", "8月3日に共有します！")
    assert found == [("action", 1, "田中さん、来週までに資料を作成します", "来週"), ("action", 2, "8月3日に共有します", "8月3日"), ("decision", 1, "予算は承認されました", None), ("open", 1, "この課題は持ち帰りです", None)]


def test_full_list_falls_through_to_the_next_cue(spark):
    both = [f"第{i}案で決定、共有します" for i in range(43)]
    found = items(spark, *both, "次回に検討します")
    assert [c for c, *_ in found].count("decision") == 20
    assert [c for c, *_ in found].count("action") == 20
    # three more have no open cue and are left out
    assert [(c, t) for c, _, t, _ in found if c == "open"] == [("open", "次回に検討します")]


def test_topics_keep_the_longest_in_spoken_order(spark):
    texts = ["あ" * n for n in (5, 9, 7, 30, 6, 20, 4)]
    rows = minutes.topics(minutes.meeting_sentences(meeting(spark, *texts))).orderBy("rank").collect()
    assert [len(r.point.split(": ")[1]) for r in rows] == [9, 7, 30, 6, 20]
    assert rows[0].title == "時間帯 00:00 - 00:10"


def test_topic_clock_begins_again_after_a_day(spark):
    row = minutes.topics(minutes.meeting_sentences(meeting(spark, "あいうえお", start=25 * 3600_000))).first()
    assert (row.title, row.point[:10]) == ("時間帯 01:00 - 01:10", "[25:00:00]")


def test_rendered_minutes_have_all_sections(spark):
    text = minutes.rendered(meeting(spark, "はいはい"), details(spark)).first().markdown
    assert [line for line in text.split("\n") if line.startswith("## ")] == ["## 1. 概要", "## 2. 決定事項", "## 3. 議題別内容", "## 4. ToDo・ネクストアクション", "## 5. 継続検討事項", "## 6. 補足"]


def test_labels(spark):
    rows = spark.createDataFrame([("Microphone", None, None), ("SystemAudio", 1, None), ("SystemAudio", 1, "田中"), ("Microphone", 0, "  ")], "source string, speaker_id int, speaker_name string")
    assert [r[0] for r in rows.select(transcript.speaker_label()).collect()] == ["マイク", "PC音声 / Speaker 2", "PC音声 / 田中", "マイク / Speaker 1"]


def test_carry_over_takes_the_largest_overlap_of_the_same_source(spark):
    now = spark.createDataFrame([(1, "a", 0, 1000, "Microphone", None, None, 0), (1, "b", 5000, 5000, "Microphone", 4, None, 1), (1, "c", 0, 1000, "SystemAudio", None, None, 2)], "meeting_id long, id string, start_ms long, end_ms long, source string, speaker_id int, speaker_name string, arrival_seq long")
    old = spark.createDataFrame([(1, "x", 0, 400, "Microphone", 1, "A", 0), (1, "y", 400, 70000, "Microphone", None, "B", 1), (1, "z", 0, 9000, "Microphone", 3, " ", 2)], now.schema)
    found = {r.id: (r.speaker_id, r.speaker_name) for r in transcript.carry_over_names(now, old).collect()}
    assert found == {"a": (None, "B"), "b": (4, None), "c": (None, None)}


def test_response_headings_with_decoration(spark):
    lines = ["前置き", "## 決定事項：", "- 予算を承認", "**ToDo・ネクストアクション**", "* 資料を作る", "```", "【補足】", "・なし", "とても長い文なので見出しではありません決定事項とは違います"]
    rows = spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "response_id long, ord long, line string")
    found = [(r.section, r.line) for r in responses.sections(rows).orderBy("section", "position").collect()]
    assert found == [("actions", "資料を作る"), ("decisions", "予算を承認"), ("notes", "なし"), ("notes", lines[-1]), ("overview", "前置き")]
    assert responses.recognised(rows).first().recognised_markers == 3


def test_packing_never_splits_a_line_and_may_exceed_the_budget_with_one(spark):
    rows = spark.createDataFrame([(1, i, "x" * n) for i, n in enumerate((100, 300, 150, 700, 10))], "response_id long, ord long, line string")
    found = {r.ord: r.block for r in responses.packed(rows, 500).collect()}
    assert found == {0: 0, 1: 0, 2: 1, 3: 2, 4: 3}
    assert responses.budget(4096) == 3604


def test_names_of_folders(spark):
    rows = spark.createDataFrame([("a/b: c",), ("  ",), ("x" * 70,), ("_" * 3,), (None,)], "title string")
    assert [r[0] for r in rows.select(ft.sanitised_name(F.col("title"))).collect()] == ["a_b__c", "Meeting", "x" * 60, "Meeting", "Meeting"]


def test_unicode_trim_and_blank(spark):
    rows = spark.createDataFrame([("　あ  ",), (" 　\t",), (None,)], "x string")
    assert [tuple(r) for r in rows.select(ft.trimmed(F.col("x")), ft.is_blank(F.col("x"))).collect()] == [("あ", False), ("", True), (None, True)]


def test_empty_transcript(spark):
    none = spark.createDataFrame([], SEGMENT)
    assert minutes.rendered(none, details(spark).limit(0)).count() == 0
    assert transcript.exported_text(none, details(spark)).first().text.endswith("\n\n(認識された発言はありません)\n")
    assert transcript.exported_markdown(none, details(spark)).first().text.endswith("## 本文\n\n_認識された発言はありません。_\n")
    text = minutes.rendered(none, details(spark)).first().markdown
    assert "録音時間 00:01:30、発言 0 件（マイク 0 件 / PC音声 0 件）。" in text and "- 対象発言数: 0 / 抽出対象文数: 0\n- 録音時の警告: 音切れ\n" in text and minutes.NO_DECISIONS in text and minutes.NO_ACTIONS in text


def details(spark):
    """Of the meeting of ``meeting``."""
    return spark.sql("SELECT 1L meeting_id, cast(NULL AS string) title, 'f' folder_name, timestamp_ntz'2026-01-05 09:30:00' started_at, timestamp_ntz'2026-01-05 10:00:00' stopped_at, '+09:00' utc_offset, 90D duration_seconds, 'a.wav' audio_file_name, cast(NULL AS string) microphone, cast(NULL AS string) render_device, cast(NULL AS string) model_id, true recovered, false diarized, array('音切れ') warnings")


def test_minutes_name_the_meeting_and_its_time(spark):
    lines = minutes.rendered(meeting(spark, "予算を承認することに決定しました。"), details(spark)).first().markdown.split("\n")
    assert lines[:8] == ["# 会議議事録", "", "| 項目 | 内容 |", "| --- | --- |", "| 会議名 | f |", "| 日時 | 2026-01-05 09:30 - 10:00 |", "| 録音時間 | 00:01:30 |", f"| 生成方法 | {minutes.EXTRACTIVE} |"]
    assert "- [00:00:00] 予算を承認することに決定しました" in lines or any("予算を承認" in x for x in lines)


def test_answers_fill_the_template_and_map_topics_stay(spark):
    answer = "【概要】\n定例会。\n【決定事項】\n- 予算を承認\n- なし\n【議題別内容】\n- 予算\n【ToDo】\n- 資料を作る（田中、金曜まで）\n【継続検討】\nなし\n【補足】\n- 次回は月曜"
    answers = spark.createDataFrame([(1, answer), (2, "見出しのない答え")], "response_id long, answer string")
    got = {r.meeting_id: r for r in summaries.minutes_of(answers).collect()}
    assert (got[1].overview, got[1].decisions, got[1].open, got[1].notes) == ("定例会。", ["予算を承認"], [], ["次回は月曜"])
    assert [tuple(a) for a in got[1].actions] == [("資料を作る（田中、金曜まで）", "要確認", "要確認", None)]
    assert [(t.title, t.time_range, t.points) for t in got[1].topics] == [("議題別内容", "", ["予算"])]
    assert got[2].overview == "見出しのない答え" and not got[2].topics
    mapped = spark.createDataFrame([(1, 1, "要点 2", "", ["b"]), (1, 0, "要点 1", "0:00:01 〜 0:10:00", ["a"])], "response_id long, block long, title string, time_range string, points array<string>")
    assert [t.title for t in next(r for r in summaries.minutes_of(answers, mapped).collect() if r.meeting_id == 1).topics] == ["要点 1", "要点 2"]
    text = minutes.template_markdown(summaries.minutes_of(answers.where("response_id = 1"), mapped), details(spark), "local").first().markdown
    assert "### 要点 1 （0:00:01 〜 0:10:00）\n\n- a\n\n### 要点 2\n\n- b\n" in text and "| 資料を作る（田中、金曜まで） | 要確認 | 要確認 | - |\n" in text and minutes.NO_OPEN in text
