"""DuckDB SQL that computes what the queries of ``registry`` compute, from the same tables."""

from __future__ import annotations

from quillspark.functions.text import SPACE
from quillspark.operators.planning import CATALOG

from .adapters import JOURNAL_SQL, LEVELS_SQL, LINES_SQL, PREVIOUS_SQL, SEGMENTS_SQL

def _trim(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"


_STAMP = "printf('%02d:%02d:%02d', {0} // 3600000, ({0} // 60000) % 60, ({0} // 1000) % 60)"
_CLOCK = "printf('%02d:%02d', ({0} // 3600000) % 24, ({0} // 60000) % 60)"
_CLOCK_S = "printf('%02d:%02d:%02d', ({0} // 3600000) % 24, ({0} // 60000) % 60, ({0} // 1000) % 60)"
_LABEL = """(CASE source WHEN 'Microphone' THEN 'マイク' WHEN 'SystemAudio' THEN 'PC音声' WHEN 'Mixed' THEN 'ミックス' WHEN 'Imported' THEN 'インポート音声' ELSE '不明' END
 || coalesce(' / ' || coalesce(speaker_name, 'Speaker ' || (speaker_id + 1)), ''))"""

_SENTENCES = f"""{SEGMENTS_SQL},
p0 AS (SELECT *, regexp_split_to_array(text, '[.!?\\n]') AS parts FROM segments WHERE {_trim("text")} <> ''),
p1 AS (SELECT *, list_filter(list_transform(parts, lambda x: {_trim("x")}), lambda x: length(x) >= 4) AS good FROM p0),
sentences AS (SELECT meeting_id, start_ms, arrival_seq, {_STAMP.format("start_ms")} AS timestamp, {_LABEL} AS label, unnest(range(len(good))) AS pos, unnest(good) AS text FROM p1)
"""

_ITEMS = f"""{_SENTENCES},
s AS (SELECT *, regexp_matches(text, '(tion|ción)') AS d, regexp_matches(text, '(ing|ment|keit)') AS a, regexp_matches(text, '(er|re)') AS o,
             row_number() OVER (PARTITION BY meeting_id ORDER BY start_ms, arrival_seq, pos) AS n FROM sentences),
ds AS (SELECT *, row_number() OVER (PARTITION BY meeting_id ORDER BY n) AS rank FROM s WHERE d QUALIFY rank <= 20),
r1 AS (SELECT * FROM s ANTI JOIN ds USING (meeting_id, n)),
acts AS (SELECT *, row_number() OVER (PARTITION BY meeting_id ORDER BY n) AS rank FROM r1 WHERE a QUALIFY rank <= 20),
r2 AS (SELECT * FROM r1 ANTI JOIN acts USING (meeting_id, n)),
ops AS (SELECT *, row_number() OVER (PARTITION BY meeting_id ORDER BY n) AS rank FROM r2 WHERE o QUALIFY rank <= 20),
items AS (SELECT meeting_id, 'decision' AS category, rank, timestamp, text FROM ds UNION ALL SELECT meeting_id, 'action', rank, timestamp, text FROM acts UNION ALL SELECT meeting_id, 'open', rank, timestamp, text FROM ops),
due AS (SELECT *, CASE WHEN category = 'action' THEN coalesce(nullif(regexp_extract(text, '((the|les|die|las) [a-z]+)', 0), ''), '要確認') END AS due FROM items)
"""

_TOPICS = f"""
b AS (SELECT *, start_ms // 600000 AS bucket, length(text) AS len FROM sentences),
b1 AS (SELECT *, row_number() OVER (PARTITION BY meeting_id, bucket ORDER BY len DESC, start_ms, arrival_seq, pos) AS by_length FROM b QUALIFY by_length <= 5),
topics AS (SELECT meeting_id, bucket, '時間帯 ' || {_CLOCK.format("(bucket * 600000)")} || ' - ' || {_CLOCK.format("((bucket + 1) * 600000)")} AS title,
                  {_CLOCK_S.format("(bucket * 600000)")} || ' 〜 ' || {_CLOCK_S.format("((bucket + 1) * 600000)")} AS time_range,
                  row_number() OVER (PARTITION BY meeting_id, bucket ORDER BY start_ms, by_length) AS rank, '[' || timestamp || '] ' || label || ': ' || text AS point FROM b1)
"""

_OVERVIEW = f"""
c AS (SELECT meeting_id, count(*) AS n_segments, count(*) FILTER (source = 'Microphone') AS n_microphone, count(*) FILTER (source = 'SystemAudio') AS n_system,
             count(DISTINCT source || ':' || speaker_id) AS n_speakers, max(end_ms) / 1000 AS duration_seconds, max(end_ms) AS ms FROM segments GROUP BY meeting_id),
f AS (SELECT meeting_id, text, row_number() OVER (PARTITION BY meeting_id ORDER BY start_ms, arrival_seq, pos) AS n FROM sentences QUALIFY n <= 3),
g AS (SELECT meeting_id, text, row_number() OVER (PARTITION BY meeting_id ORDER BY n) AS k FROM f WHERE length(text) > 8 QUALIFY k <= 2),
h AS (SELECT meeting_id, string_agg(text, ' / ' ORDER BY k) AS opening FROM g GROUP BY meeting_id),
overview AS (SELECT meeting_id, n_segments, n_microphone, n_system, n_speakers, duration_seconds, opening,
  '録音時間 ' || {_STAMP.format("ms")} || '、発言 ' || n_segments || ' 件（マイク ' || n_microphone || ' 件 / PC音声 ' || n_system || ' 件）' ||
  CASE WHEN n_speakers > 0 THEN '、話者分離クラスタ ' || n_speakers || ' 件' ELSE '' END || '。' || coalesce(chr(10) || '冒頭の発言: ' || opening, '') AS text FROM c LEFT JOIN h USING (meeting_id))
"""

_NAMES = "names AS (SELECT DISTINCT meeting_id, source, speaker_id, 'Name ' || meeting_id || ' ' || speaker_id AS name FROM segments WHERE speaker_id % 2 = 0 AND meeting_id % 2 = 0)"

_MEETINGS = """
mm AS (SELECT meeting_id, CAST(max(end_ms) AS BIGINT) AS ms FROM segments GROUP BY meeting_id UNION ALL SELECT DISTINCT meeting_id + 1000000, 0 FROM segments WHERE meeting_id % 10 = 0),
meetings AS (SELECT *, CASE WHEN meeting_id % 2 = 0 THEN 'Meeting ' || meeting_id ELSE 'folder_' || meeting_id END AS name, make_timestamp((meeting_id * 60 + 1767605400) * 1000000) AS begun,
  CASE WHEN meeting_id % 4 <> 1 THEN make_timestamp((meeting_id * 60 + 1767605400 + ms // 1000) * 1000000) ELSE begun END AS ended FROM mm)
"""

#: What the documents say, by section, as bullets of Markdown and of plain text.
_MINUTES = f"""{_ITEMS}, {_TOPICS}, {_OVERVIEW}, {_MEETINGS},
l AS (SELECT meeting_id, string_agg('- [' || timestamp || '] ' || {_trim("text")} || chr(10), '' ORDER BY rank) FILTER (category = 'decision') AS decision,
  string_agg('| ' || replace(text, '|', '\\|') || ' | 要確認 | ' || replace(due, '|', '\\|') || ' | ' || timestamp || ' |' || chr(10), '' ORDER BY rank) FILTER (category = 'action') AS task,
  string_agg('  - ' || text || ' / 担当: 要確認 / 期限: ' || due || chr(10), '' ORDER BY rank) FILTER (category = 'action') AS action,
  string_agg('- [' || timestamp || '] ' || {_trim("text")} || chr(10), '' ORDER BY rank) FILTER (category = 'open') AS open FROM due GROUP BY meeting_id),
k AS (SELECT meeting_id, bucket, '### ' || title || ' （' || time_range || '）' || chr(10) || chr(10) || string_agg('- ' || point || chr(10), '' ORDER BY rank) || chr(10) AS section,
  '  ' || title || ' (' || time_range || ')' || chr(10) || string_agg('    - ' || point || chr(10), '' ORDER BY rank) || chr(10) AS plain FROM topics GROUP BY meeting_id, bucket, title, time_range),
q AS (SELECT meeting_id, string_agg(section, '' ORDER BY bucket) AS topics, string_agg(plain, '' ORDER BY bucket) AS plain FROM k GROUP BY meeting_id),
z AS (SELECT meeting_id, count(*) AS n FROM sentences GROUP BY meeting_id),
doc AS (SELECT m.*, decision, task, action, open, topics, plain, coalesce(v.text, '録音時間 00:00:00、発言 0 件（マイク 0 件 / PC音声 0 件）。') AS overview,
  'この議事録は文字起こしからキーフレーズを抽出して作成した機械的な要約です。内容の正確性は必ず原文（transcript.md）で確認してください。' AS note1, '対象発言数: ' || coalesce(v.n_segments, 0) || ' / 抽出対象文数: ' || coalesce(z.n, 0) AS note2
  FROM meetings m LEFT JOIN overview v USING (meeting_id) LEFT JOIN l USING (meeting_id) LEFT JOIN q USING (meeting_id) LEFT JOIN z USING (meeting_id))
"""

_TEXT = f"'[' || {_STAMP.format('start_ms')} || '] [' || {_LABEL} || ']' || chr(10) || {_trim('text')} || chr(10) || chr(10)"

_HEAD_BARE = f"""{_trim("regexp_replace(" + _trim("regexp_replace(" + _trim("line") + r", '^[#* \x{3000}:：-]+|[#* \x{3000}:：-]+$', '', 'g')") + r", '^[【】\[\]「」]+|[【】\[\]「」]+$', '', 'g')")}"""
_LINES_HEADED = f"""{LINES_SQL},
h0 AS (SELECT response_id, ord, {_trim("line")} AS line, {_HEAD_BARE} AS bare FROM lines),
headed AS (SELECT response_id, ord, line, CASE WHEN length(bare) BETWEEN 1 AND 24 THEN CASE WHEN starts_with(bare, '概要') THEN 'overview' WHEN starts_with(bare, '決定事項') THEN 'decisions' WHEN starts_with(bare, '議題別内容') THEN 'topics'
  WHEN starts_with(lower(bare), 'todo') THEN 'actions' WHEN starts_with(bare, '継続検討') THEN 'open' WHEN starts_with(bare, '補足') THEN 'notes' END END AS heading FROM h0 WHERE line <> '')
"""

_FOLD = """
WITH RECURSIVE {levels},
n AS (SELECT stream, max(seq) AS m FROM levels GROUP BY stream),
"""

def _band(n: int, low: float, high: float, rate: int) -> str:
    """A band-pass twice over each stream's samples, as band ``n``: k, f and its output o."""
    return f"""w{n} AS (SELECT 2 * pi() * sqrt(CAST({low * high} AS DOUBLE)) / {rate} AS w, sin(w) / (2 * sqrt(CAST({low * high} AS DOUBLE)) / {high - low}) AS alpha),
k{n} AS MATERIALIZED (SELECT alpha / (1 + alpha) AS b, -2 * cos(w) / (1 + alpha) AS a1, (1 - alpha) / (1 + alpha) AS a2 FROM w{n}),
f{n} AS (SELECT stream, CAST(0 AS BIGINT) AS seq, CAST(0 AS DOUBLE) AS y, CAST(0 AS DOUBLE) AS s1, CAST(0 AS DOUBLE) AS t1, CAST(0 AS DOUBLE) AS s2, CAST(0 AS DOUBLE) AS t2 FROM n
  UNION ALL SELECT stream, seq, z, -a1 * y1 + t1, -b * x - a2 * y1, -a1 * z + t2, -b * y1 - a2 * z FROM (SELECT *, b * y1 + s2 AS z FROM (
    SELECT l.stream, l.seq, l.x, f.t1, f.s2, f.t2, k.b, k.a1, k.a2, k.b * l.x + f.s1 AS y1 FROM f{n} f JOIN l ON l.stream = f.stream AND l.seq = f.seq + 1, k{n} k)))"""


_MODELS = "models(model_id, purpose, license, size_bytes, ram_mb, cost) AS (VALUES " + ", ".join(f"('{a}', '{b}', '{c}', {d}, {e}, CAST({f} AS DOUBLE))" for a, b, c, d, e, f in CATALOG) + ")"


#: The lines of responses under their headings.
_SECTIONS = f"""{_LINES_HEADED},
w AS (SELECT response_id, ord, line, heading, coalesce(last_value(heading IGNORE NULLS) OVER (PARTITION BY response_id ORDER BY ord ROWS UNBOUNDED PRECEDING), 'overview') AS section FROM headed),
c AS (SELECT response_id, ord, section, {_trim("regexp_replace(line, '^[-*・　 #]+', '')")} AS line FROM w WHERE heading IS NULL),
secs AS (SELECT response_id, section, row_number() OVER (PARTITION BY response_id, section ORDER BY ord) AS position, line FROM c WHERE line <> '' AND NOT starts_with(line, '```'))
"""

def _biquad(w: str, q: str, coefficients: str) -> str:
    """A second-order section over each stream's samples; ``coefficients`` name b0, b1, b2, a0, a1, a2 by alpha, c (of the angle w) and what q says."""
    return _FOLD.format(levels=LEVELS_SQL) + f"""
l AS MATERIALIZED (SELECT stream, seq, value AS x FROM levels), k0 AS (SELECT {w} AS w), k1 AS (SELECT w, cos(w) AS c, {q} FROM k0), k2 AS (SELECT {coefficients} FROM k1),
k AS MATERIALIZED (SELECT b0 / a0 AS b0, b1 / a0 AS b1, b2 / a0 AS b2, a1 / a0 AS a1, a2 / a0 AS a2 FROM k2),
f AS (SELECT stream, seq, b0 * x AS y, b1 * x - a1 * (b0 * x) AS s, b2 * x - a2 * (b0 * x) AS t FROM l, k WHERE seq = 1
      UNION ALL SELECT l.stream, l.seq, b0 * l.x + f.s, b1 * l.x - a1 * (b0 * l.x + f.s) + f.t, b2 * l.x - a2 * (b0 * l.x + f.s) FROM f JOIN l ON l.stream = f.stream AND l.seq = f.seq + 1, k)
SELECT stream, seq - 1 AS pos, round(y, 9) AS y FROM f"""


SQL = {
    "transcript_timeline": f"""WITH {SEGMENTS_SQL} SELECT meeting_id, id, row_number() OVER (PARTITION BY meeting_id ORDER BY start_ms, arrival_seq) AS position,
  {_STAMP.format("start_ms")} AS timestamp, {_LABEL} AS label, greatest(0, end_ms - start_ms) AS duration_ms FROM segments""",
    "transcript_sentences": f"WITH {_SENTENCES} SELECT meeting_id, start_ms, arrival_seq, timestamp, label, pos, text FROM sentences",
    "cue_sentences": f"""WITH {_SENTENCES} SELECT meeting_id, arrival_seq, pos, regexp_matches(text, '(tion|ción)') AS is_decision, regexp_matches(text, '(ing|ment|keit)') AS is_action,
  regexp_matches(text, '(er|re)') AS is_open, coalesce(nullif(regexp_extract(text, '((the|les|die|las) [a-z]+)', 0), ''), '要確認') AS due FROM sentences""",
    "minutes_items": f"WITH {_ITEMS} SELECT meeting_id, category, rank, timestamp, text, due FROM due",
    "minutes_topics": f"WITH {_SENTENCES}, {_TOPICS} SELECT meeting_id, bucket, title, time_range, rank, point FROM topics",
    "minutes_overview": f"WITH {_SENTENCES}, {_OVERVIEW} SELECT * FROM overview",
    "minutes_markdown": f"""WITH {_MINUTES}
SELECT meeting_id, replace('# 会議議事録~~| 項目 | 内容 |~| --- | --- |~| 会議名 | ', '~', chr(10)) || name || replace(' |~| 日時 | ', '~', chr(10)) || strftime(begun, '%Y-%m-%d %H:%M') || ' - ' || strftime(ended, '%H:%M') || replace(' |~| 録音時間 | ', '~', chr(10)) || {_STAMP.format("ms")} ||
  replace(' |~| 生成方法 | 抽出型（ローカル・AIモデル不使用） |~~> この議事録は文字起こしの内容のみから作成されています。~> 文字起こしに存在しない情報（担当者・期限など）は「要確認」と記載しています。~~## 1. 概要~~', '~', chr(10)) || overview ||
  replace('~~## 2. 決定事項~~', '~', chr(10)) || coalesce(decision, '- この会議で明確に決定された事項は文字起こしからは特定できませんでした。（要確認）' || chr(10)) || replace('~## 3. 議題別内容~~', '~', chr(10)) || coalesce(topics, replace('- 要確認~~', '~', chr(10))) ||
  replace('## 4. ToDo・ネクストアクション~~', '~', chr(10)) || coalesce(replace('| 内容 | 担当 | 期限 | 該当時刻 |~| --- | --- | --- | --- |~', '~', chr(10)) || task, replace('| 内容 | 担当 | 期限 |~| --- | --- | --- |~| 特定できませんでした | 要確認 | 要確認 |~', '~', chr(10))) ||
  replace('~## 5. 継続検討事項~~', '~', chr(10)) || coalesce(open, '- 継続検討事項は文字起こしからは特定できませんでした。（要確認）' || chr(10)) || replace('~## 6. 補足~~- ', '~', chr(10)) || note1 || chr(10) || '- ' || note2 || chr(10) ||
  CASE WHEN meeting_id % 3 = 0 THEN replace('- 録音時の警告: gap ' || meeting_id || '~- 録音時の警告: clipped~', '~', chr(10)) ELSE '' END || chr(10) AS markdown FROM doc""",
    "transcript_text": f"""WITH {SEGMENTS_SQL}, {_MEETINGS}, x AS (SELECT meeting_id, string_agg({_TEXT}, '' ORDER BY start_ms, arrival_seq) AS body FROM segments GROUP BY meeting_id)
SELECT meeting_id, replace('文字起こし~' || repeat('=', 40) || '~  会議名      : ' || name || '~  開始日時    : ' || strftime(begun, '%Y-%m-%d %H:%M:%S') || ' +09:00~  録音時間    : ' || {_STAMP.format("ms")} || '~  音声ファイル: audio.wav~  マイク      : ' ||
  CASE WHEN meeting_id % 5 <> 0 THEN 'mic' ELSE '未設定' END || '~  PC音声      : ' || CASE WHEN meeting_id % 7 <> 0 THEN 'out|put' ELSE '未設定' END || '~  認識モデル  : ' || CASE WHEN meeting_id % 4 <> 0 THEN 'small' ELSE 'なし' END || '~' ||
  CASE WHEN meeting_id % 3 = 0 THEN '  備考        : 異常終了から復旧したデータです~' ELSE '' END || '~', '~', chr(10)) || coalesce(body, '(認識された発言はありません)' || chr(10)) AS text FROM meetings LEFT JOIN x USING (meeting_id)""",
    "transcript_markdown": f"""WITH {SEGMENTS_SQL}, {_MEETINGS},
x AS (SELECT meeting_id, string_agg('**[' || {_STAMP.format("start_ms")} || '] ' || {_LABEL} || '**' || chr(10) || chr(10) || {_trim("text")} || chr(10) || chr(10), '' ORDER BY start_ms, arrival_seq) AS body FROM segments GROUP BY meeting_id)
SELECT meeting_id, replace('# 文字起こし — ' || strftime(begun, '%Y-%m-%d %H:%M') || '~~| 項目 | 内容 |~| --- | --- |~| 会議名 | ' || name || ' |~| 開始日時 | ' || strftime(begun, '%Y-%m-%d %H:%M:%S') || ' +09:00 |~| 録音時間 | ' || {_STAMP.format("ms")} || ' |~| 音声ファイル | audio.wav |~| マイク | ' ||
  CASE WHEN meeting_id % 5 <> 0 THEN 'mic' ELSE '未設定' END || ' |~| PC音声 | ' || CASE WHEN meeting_id % 7 <> 0 THEN 'out\\|put' ELSE '未設定' END || ' |~| 音声認識モデル | ' || CASE WHEN meeting_id % 4 <> 0 THEN 'small' ELSE 'なし' END || ' |~| 話者分離 | ' || CASE WHEN meeting_id % 2 = 1 THEN 'あり' ELSE 'なし' END || ' |~' ||
  CASE WHEN meeting_id % 3 = 0 THEN '| 復旧 | 異常終了から復旧したデータです |~' ELSE '' END || '~## 本文~~', '~', chr(10)) || coalesce(body, '_認識された発言はありません。_' || chr(10)) AS text FROM meetings LEFT JOIN x USING (meeting_id)""",
    "speaker_carry_over": f"""WITH {SEGMENTS_SQL}, {PREVIOUS_SQL},
o AS (SELECT c.meeting_id, c.id, p.speaker_id AS p_id, p.speaker_name AS p_name, least(p.end_ms, c.end_ms) - greatest(p.start_ms, c.start_ms) AS overlap,
  row_number() OVER (PARTITION BY c.meeting_id, c.id ORDER BY overlap DESC, p.start_ms, p.arrival_seq) AS n
  FROM segments c JOIN previous p ON p.meeting_id = c.meeting_id AND p.source = c.source AND p.speaker_name IS NOT NULL AND p.start_ms < c.end_ms AND p.end_ms > c.start_ms WHERE overlap > 0 QUALIFY n = 1)
SELECT s.meeting_id, s.id, s.source, CASE WHEN o.id IS NULL THEN s.speaker_id ELSE p_id END AS speaker_id, coalesce(p_name, s.speaker_name) AS speaker_name FROM segments s LEFT JOIN o ON o.meeting_id = s.meeting_id AND o.id = s.id""",
    "speaker_list": f"""WITH {SEGMENTS_SQL}, {_NAMES}, d AS (SELECT DISTINCT meeting_id, source, speaker_id FROM segments WHERE speaker_id IS NOT NULL)
SELECT meeting_id, source, speaker_id, name, row_number() OVER (PARTITION BY meeting_id ORDER BY list_position(['Microphone', 'SystemAudio', 'Mixed', 'Imported'], source), speaker_id) AS position FROM d LEFT JOIN names USING (meeting_id, source, speaker_id)""",
    "speaker_names_known": f"WITH {SEGMENTS_SQL}, {_NAMES} SELECT meeting_id, id, coalesce(name, speaker_name) AS speaker_name FROM segments LEFT JOIN names USING (meeting_id, source, speaker_id)",
    "speaker_rename_counts": f"WITH {SEGMENTS_SQL}, {_NAMES} SELECT n.*, (SELECT count(*) FROM segments s WHERE s.meeting_id = n.meeting_id AND s.source = n.source AND s.speaker_id = n.speaker_id) AS affected FROM names n",
    "segment_edits": f"WITH {SEGMENTS_SQL} SELECT meeting_id, id, CASE WHEN arrival_seq % 3 = 1 THEN 'edited ' || text ELSE text END AS text, arrival_seq % 3 = 1 AS is_edited FROM segments WHERE arrival_seq <> 4",
    "segment_upserts": f"""WITH {SEGMENTS_SQL} SELECT meeting_id, id, CASE WHEN meeting_id % 2 = 0 THEN 'replaced' ELSE text END AS text FROM segments
UNION ALL SELECT meeting_id, id || '-new', text FROM segments WHERE meeting_id % 5 = 0""",
    "segments_added": f"""WITH {SEGMENTS_SQL}, {_NAMES},
n AS (SELECT meeting_id, id || '-typed' AS id, start_ms + 5 AS start_ms, start_ms + 5 AS end_ms, source, CAST(NULL AS INTEGER) AS speaker_id, CAST(NULL AS VARCHAR) AS speaker_name, 'typed' AS text, true AS is_edited, CAST(0 AS BIGINT) AS arrival_seq FROM segments WHERE arrival_seq = 1
  UNION ALL SELECT meeting_id, id || '-copy', start_ms, end_ms, source, speaker_id, name, text, is_edited, arrival_seq FROM segments LEFT JOIN names USING (meeting_id, source, speaker_id) WHERE meeting_id % 3 = 0),
m AS (SELECT meeting_id, max(arrival_seq) AS last FROM segments GROUP BY meeting_id),
a AS (SELECT n.* REPLACE (last + row_number() OVER (PARTITION BY meeting_id ORDER BY arrival_seq, id) AS arrival_seq) FROM n JOIN m USING (meeting_id))
SELECT meeting_id, id, start_ms, end_ms, speaker_name, text, is_edited, arrival_seq, NULL AS line FROM segments
UNION ALL SELECT meeting_id, id, start_ms, end_ms, speaker_name, text, is_edited, arrival_seq, '{{"kind":"Segment","segment":{{"id":"' || id || '","startMs":' || start_ms || ',"endMs":' || end_ms || ',"source":"' || source || '",' || coalesce('"speakerId":' || speaker_id || ',', '') || coalesce('"speakerName":"' || speaker_name || '",', '') ||
  '"text":' || to_json(text) || ',"isEdited":' || is_edited || '}}}}' FROM a""",
    "segments_replaced": f"""WITH {SEGMENTS_SQL}, {_NAMES}
SELECT meeting_id, id, speaker_name, text, arrival_seq FROM segments WHERE meeting_id NOT IN (SELECT meeting_id FROM segments WHERE meeting_id % 4 = 0 AND arrival_seq % 2 = 0)
UNION ALL SELECT meeting_id, id, name, 'new', row_number() OVER (PARTITION BY meeting_id ORDER BY start_ms, arrival_seq, id) - 1 FROM segments LEFT JOIN names USING (meeting_id, source, speaker_id) WHERE meeting_id % 4 = 0 AND arrival_seq % 2 = 0""",
    "segment_removals": f"""WITH {SEGMENTS_SQL} SELECT meeting_id, id, 'SegmentUpdate' AS kind, '{{"kind":"SegmentUpdate","segment":{{"id":"' || id || '","startMs":' || start_ms || ',"endMs":' || end_ms || ',"source":"' || source || '",' || coalesce('"speakerId":' || speaker_id || ',', '') || '"text":"","isEdited":true}}}}' AS line FROM segments WHERE arrival_seq % 3 = 2""",
    "leg_clipping_counts": """WITH s AS (SELECT event_id % 97 AS meeting_id, event_type IN ('click', 'view') AS mic, abs(value / 480 - 0.01) >= 0.999 AS flat FROM events),
c AS (SELECT meeting_id, count(*) FILTER (mic) AS n, count(*) FILTER (mic AND flat) AS microphone, count(*) FILTER (NOT mic AND flat) AS system FROM s GROUP BY meeting_id), w AS (SELECT *, CASE WHEN n > 0 THEN greatest(microphone, system) / CAST(n AS DOUBLE) ELSE 0 END AS f FROM c)
SELECT meeting_id, n, microphone, system, round(f, 9) AS worst_fraction, n > 0 AND f >= 1e-4 AS clipped FROM w""",
    "capture_probe_levels": f"""WITH {LEVELS_SQL}, b AS (SELECT stream, value, secs - min(secs) OVER (PARTITION BY stream) AS since FROM levels), a AS (SELECT stream, count(*) AS samples, max(abs(value)) AS peak, sqrt(avg(value * value)) AS rms FROM b WHERE since < 864000 GROUP BY stream)
SELECT stream, samples, round(CASE WHEN peak <= 1e-12 THEN -120 ELSE 20 * log10(peak) END, 6) AS peak_db, round(CASE WHEN rms <= 1e-12 THEN -120 ELSE 20 * log10(rms) END, 6) AS rms_db FROM a""",
    "minutes_metrics_blocks": """WITH i AS (SELECT l_orderkey AS run_id, count(*) FILTER (l_linenumber <> 1) AS maps, coalesce(sum(CAST(l_suppkey % 64 AS DOUBLE) / 20) FILTER (l_linenumber <> 1), 0) AS map_s, count(*) FILTER (l_linenumber = 1) AS reduces, coalesce(sum(CAST(l_suppkey % 64 AS DOUBLE) / 20) FILTER (l_linenumber = 1), 0) AS reduce_s,
  sum(l_partkey % 500) AS prompt, sum(CAST(l_quantity AS BIGINT)) AS output FROM lineitem GROUP BY 1),
r AS (SELECT o_orderkey AS id, o_orderpriority AS why, coalesce(maps, 0) AS maps, coalesce(map_s, 0) AS map_s, coalesce(reduces, 0) AS reduces, coalesce(reduce_s, 0) AS reduce_s, coalesce(prompt, 0) AS prompt, coalesce(output, 0) AS output FROM orders LEFT JOIN i ON run_id = o_orderkey)
SELECT id AS run_id, replace('Minutes performance:~  Transcript tokens     = ' || (id % 9000) || '~  Context window        = 4096~  Strategy              = ' || CASE WHEN id % 4 = 0 THEN 'single pass' ELSE 'map-reduce' END || ' - ' || why || '~  Blocks                = ' || (id % 4 + 1) ||
  '~  Model load            = ' || printf('%.2f', round(CAST(id % 100 AS DOUBLE) / 50, 2)) || ' s~  Map inference count   = ' || maps || '~  Map time              = ' || printf('%.2f', round(map_s, 2)) || ' s~  Reduce inference count= ' || reduces || '~  Reduce time           = ' || printf('%.2f', round(reduce_s, 2)) ||
  ' s~  Prompt tokens         = ' || prompt || '~  Output tokens         = ' || output || '~  Tokens/sec            = ' || printf('%.1f', round(CASE WHEN map_s + reduce_s > 0 THEN output / (map_s + reduce_s) ELSE 0 END, 1)) || '~  Total                 = ' || printf('%.2f', round(CAST(id % 1000 AS DOUBLE) / 20, 2)) || ' s', '~', chr(10)) AS block FROM r""",
    "journal_replay": f"""WITH {JOURNAL_SQL}, e AS (SELECT *, row_number() OVER (PARTITION BY meeting_id, segment_id ORDER BY line_no DESC) AS n, min(line_no) OVER (PARTITION BY meeting_id, segment_id) AS first_seen FROM journal WHERE segment_id IS NOT NULL)
SELECT meeting_id, segment_id, start_ms, text, row_number() OVER (PARTITION BY meeting_id ORDER BY start_ms, first_seen) AS position FROM e WHERE n = 1""",
    "journal_states": f"""WITH {JOURNAL_SQL} SELECT meeting_id, count(*) AS n_entries, arg_max(kind, line_no) AS last_kind, min(line_no) FILTER (kind = 'Header') AS header_line,
  arg_max(duration_seconds, line_no) FILTER (duration_seconds IS NOT NULL) AS duration_seconds, count(DISTINCT segment_id) AS n_segments, arg_max(kind, line_no) <> 'Completed' AS recoverable FROM journal GROUP BY meeting_id""",
    "journal_recovery": f"""WITH {JOURNAL_SQL}, s AS (SELECT meeting_id, count(DISTINCT segment_id) AS n_segments, arg_max(duration_seconds, line_no) FILTER (duration_seconds IS NOT NULL) AS d, CASE WHEN meeting_id % 2 = 0 THEN CAST(max(line_no) % 100 AS DOUBLE) END AS a FROM journal GROUP BY meeting_id)
SELECT meeting_id, n_segments, CASE WHEN a > 0 THEN a ELSE coalesce(d, 0.0) END AS duration_seconds, '異常終了から復旧したデータです。末尾が欠けている可能性があります。' AS warnings FROM s""",
    "response_sections": f"WITH {_SECTIONS} SELECT * FROM secs",
    "response_markers": f"WITH {LINES_SQL}, ids AS (SELECT DISTINCT response_id FROM lines), {_LINES_HEADED.split(LINES_SQL + ',')[1]}, m AS (SELECT response_id, count(DISTINCT heading) AS k FROM headed GROUP BY response_id) SELECT response_id, coalesce(k, 0) AS recognised_markers, coalesce(k, 0) = 0 AS fell_back FROM ids LEFT JOIN m USING (response_id)",
    "prompt_plan": f"WITH {LINES_SQL}, t AS (SELECT response_id, CAST(sum(length(line)) AS BIGINT) AS tokens FROM lines GROUP BY response_id) SELECT response_id, tokens, tokens + 1100 <= 3604 AS single_pass, CAST(2504 AS BIGINT) AS block_budget FROM t",
    "prompt_blocks": f"""WITH RECURSIVE {LINES_SQL},
x AS MATERIALIZED (SELECT response_id, ord, length(line) AS t FROM lines),
f AS (SELECT response_id, ord, t, t AS held, t > 0 AS any_, CAST(0 AS BIGINT) AS block FROM x WHERE ord = 0
  UNION ALL SELECT x.response_id, x.ord, x.t, CASE WHEN any_ AND held + x.t > 500 THEN x.t ELSE held + x.t END, any_ OR x.t > 0, CASE WHEN any_ AND held + x.t > 500 THEN block + 1 ELSE block END
  FROM f JOIN x ON x.response_id = f.response_id AND x.ord = f.ord + 1)
SELECT response_id, block, min(ord) AS first_ord, count(*) AS n_lines, CAST(sum(t) AS BIGINT) AS tokens FROM f WHERE block < 60 GROUP BY response_id, block""",
    "prompt_lines_left_out": f"""WITH RECURSIVE {LINES_SQL},
x AS MATERIALIZED (SELECT response_id, ord, length(line) AS t FROM lines),
f AS (SELECT response_id, ord, t, t AS held, t > 0 AS any_, CAST(0 AS BIGINT) AS block FROM x WHERE ord = 0
  UNION ALL SELECT x.response_id, x.ord, x.t, CASE WHEN any_ AND held + x.t > 300 THEN x.t ELSE held + x.t END, any_ OR x.t > 0, CASE WHEN any_ AND held + x.t > 300 THEN block + 1 ELSE block END
  FROM f JOIN x ON x.response_id = f.response_id AND x.ord = f.ord + 1)
SELECT response_id, count(*) FILTER (block >= 3) AS left_out, CAST(coalesce(sum(t) FILTER (block >= 3), 0) AS BIGINT) AS left_out_tokens FROM f GROUP BY response_id""",
    "minutes_filled": f"""WITH {_SECTIONS},
e AS (SELECT *, {_trim("regexp_replace(" + _trim("line") + ", '^[-*・　 ]+', '')")} AS x FROM secs), g AS (SELECT * FROM e WHERE length(x) >= 2 AND x <> 'なし' AND NOT starts_with(x, '```')),
i AS (SELECT response_id, string_agg('  - ' || x || chr(10), '' ORDER BY position) FILTER (section = 'decisions') AS decisions, string_agg('  - ' || x || chr(10), '' ORDER BY position) FILTER (section = 'open') AS open, string_agg('  - ' || x || chr(10), '' ORDER BY position) FILTER (section = 'notes') AS notes,
  string_agg('  - ' || x || ' / 担当: 要確認 / 期限: 要確認' || chr(10), '' ORDER BY position) FILTER (section = 'actions') AS actions, string_agg('    - ' || x || chr(10), '' ORDER BY position) FILTER (section = 'topics') AS topics FROM g GROUP BY response_id),
o AS (SELECT response_id, {_trim("string_agg(line, chr(10) ORDER BY position) FILTER (section = 'overview')")} AS overview FROM secs GROUP BY response_id), r AS (SELECT repeat('-', 40) || chr(10) AS rule, '  要確認' || chr(10) AS nothing)
SELECT response_id AS meeting_id, replace('会議議事録~' || repeat('=', 40) || '~会議名   : d' || response_id || '~日時     : 2026-01-05 09:30~録音時間 : 00:00:00~生成方法 : local~~※ 文字起こしに存在しない情報は「要確認」と記載しています。~~1. 概要~', '~', chr(10)) || rule || coalesce(nullif(overview, ''), '要確認') || chr(10) || chr(10) ||
  '2. 決定事項' || chr(10) || rule || coalesce(decisions, nothing) || chr(10) || '3. 議題別内容' || chr(10) || rule || coalesce('  議題別内容' || chr(10) || topics, nothing) || chr(10) || '4. ToDo・ネクストアクション' || chr(10) || rule || coalesce(actions, nothing) || chr(10) ||
  '5. 継続検討事項' || chr(10) || rule || coalesce(open, nothing) || chr(10) || '6. 補足' || chr(10) || rule || coalesce(notes, '  なし' || chr(10)) || chr(10) AS text FROM o LEFT JOIN i USING (response_id) CROSS JOIN r""",
    "prompt_prefix": f"WITH {LINES_SQL}, w AS (SELECT response_id, ord, CAST(sum(length(line)) OVER (PARTITION BY response_id ORDER BY ord ROWS UNBOUNDED PRECEDING) AS BIGINT) AS so_far FROM lines) SELECT * FROM w WHERE ord = 0 OR so_far <= 800",
    "block_time_ranges": f"""WITH {SEGMENTS_SQL}, m AS (SELECT meeting_id, list({_STAMP.format("start_ms")} ORDER BY start_ms, arrival_seq) AS x FROM segments GROUP BY meeting_id) SELECT meeting_id, CASE WHEN x[1] = x[-1] THEN x[1] ELSE x[1] || ' 〜 ' || x[-1] END AS time_range FROM m""",
    "level_statistics": f"""WITH {LEVELS_SQL}, a AS (SELECT stream, count(*) AS n, sqrt(avg(value * value)) AS rms, max(abs(value)) AS peak, count(*) FILTER (abs(value) >= 0.999) AS n_clipped FROM levels GROUP BY stream)
SELECT stream, n, round(rms, 9) AS rms, round(peak, 9) AS peak, round(CASE WHEN rms <= 1e-12 THEN -120 ELSE 20 * log10(rms) END, 6) AS rms_db, round(CASE WHEN peak <= 1e-12 THEN -120 ELSE 20 * log10(peak) END, 6) AS peak_db,
  n_clipped, n_clipped > 0 AND n_clipped / n >= 1e-4 AS clipped, CASE WHEN peak <= 1e-12 THEN -120 ELSE 20 * log10(peak) END < -65 AS looks_silent FROM a""",
    "level_meters": _FOLD.format(levels=LEVELS_SQL) + """
l AS MATERIALIZED (SELECT stream, seq, secs / 36000.0 AS secs, db FROM levels),
f AS (SELECT stream, seq, secs, db - 6 AS rms, db AS peak, db AS hold FROM l WHERE seq = 1 UNION ALL
  SELECT stream, seq, secs, greatest(db - 6, rms - d), greatest(db, peak - d), greatest(db, hold - d / 4) FROM (SELECT l.stream, l.seq, l.secs, l.db, f.rms, f.peak, f.hold, 40.0 * least(greatest(l.secs - f.secs, 0.0), 1.0) AS d FROM f JOIN l ON l.stream = f.stream AND l.seq = f.seq + 1))
SELECT stream, seq, round(greatest(rms, -120.0), 6) AS rms, round(greatest(peak, -120.0), 6) AS peak, round(greatest(hold, -120.0), 6) AS hold FROM f""",
    "level_peak_hold": _FOLD.format(levels=LEVELS_SQL) + """
l AS MATERIALIZED (SELECT stream, seq, secs / 36000.0 AS secs, db FROM levels),
f AS (SELECT stream, seq, secs, db AS held FROM l WHERE seq = 1 UNION ALL SELECT l.stream, l.seq, l.secs, greatest(l.db, f.held - 40.0 * least(greatest(l.secs - f.secs, 0.0), 1.0)) FROM f JOIN l ON l.stream = f.stream AND l.seq = f.seq + 1)
SELECT stream, seq, round(greatest(held, -120.0), 6) AS held FROM f""",
    "level_voice_activity": _FOLD.format(levels=LEVELS_SQL) + """
l AS MATERIALIZED (SELECT stream, seq, db FROM levels),
f AS (SELECT stream, CAST(0 AS BIGINT) AS seq, CAST(-60 AS DOUBLE) AS noise, 0 AS run, 0 AS hold, false AS speech FROM n
 UNION ALL
 SELECT stream, seq, noise, run, CASE WHEN above AND run >= 2 THEN 3 WHEN NOT above AND hold > 0 THEN hold - 1 ELSE hold END, CASE WHEN above AND run >= 2 THEN true WHEN NOT above AND hold <= 0 THEN false ELSE speech END
 FROM (SELECT stream, seq, noise, above, CASE WHEN above THEN run + 1 ELSE 0 END AS run, hold, speech FROM (
   SELECT stream, seq, noise, db > greatest(noise + 8, -65) AS above, run, hold, speech FROM (
     SELECT l.stream, l.seq, l.db, f.run, f.hold, f.speech, least(greatest(CASE WHEN l.db < f.noise THEN f.noise + (l.db - f.noise) * CAST(0.25 AS DOUBLE) WHEN NOT f.speech THEN f.noise + (l.db - f.noise) * CAST(0.002 AS DOUBLE) ELSE f.noise END, -90), -20) AS noise
     FROM f JOIN l ON l.stream = f.stream AND l.seq = f.seq + 1))))
SELECT stream, seq, round(noise, 6) AS noise_db, speech FROM f WHERE seq > 0""",
    "speech_chunks": _FOLD.format(levels=LEVELS_SQL) + """
l AS MATERIALIZED (SELECT stream, seq, db - 20 AS db FROM levels),
f AS (SELECT stream, CAST(0 AS BIGINT) AS seq, CAST(-60 AS DOUBLE) AS noise, 0 AS run, 0 AS hold, false AS speech, CAST(NULL AS BIGINT) AS first, CAST(0 AS BIGINT) AS silence, CAST(0 AS BIGINT) AS spare, CAST(NULL AS BIGINT) AS cut_first, CAST(NULL AS BIGINT) AS cut_stop FROM n
 UNION ALL
 SELECT stream, seq, noise, run, hold, speech, CASE WHEN NOT cut THEN first WHEN NOT paused AND stop - first > 2 THEN stop - 2 END, CASE WHEN cut THEN 0 ELSE silence END, CASE WHEN cut THEN 0 ELSE spare END, CASE WHEN cut THEN first END, CASE WHEN cut THEN stop END
 FROM (SELECT *, coalesce(paused OR seq - first >= 16, false) AS cut, seq - least(greatest(silence - 3, 0), greatest(seq - first - 3, 0)) AS stop FROM (
   SELECT *, coalesce(silence >= 3 AND seq - first >= 3 AND (seq - first >= 8 OR silence >= 6), false) AS paused FROM (
     SELECT stream, seq, noise, run, hold, speech, CASE WHEN speech THEN coalesce(first, seq - 1 - spare) ELSE first END AS first, CASE WHEN speech THEN 0 WHEN first IS NOT NULL THEN silence + 1 ELSE silence END AS silence,
       CASE WHEN first IS NOT NULL THEN spare WHEN speech THEN 0 ELSE least(spare + 1, 2) END AS spare FROM (
       SELECT stream, seq, noise, run, first, silence, spare, CASE WHEN above AND run >= 2 THEN 30 WHEN NOT above AND hold > 0 THEN hold - 1 ELSE hold END AS hold, CASE WHEN above AND run >= 2 THEN true WHEN NOT above AND hold <= 0 THEN false ELSE speech END AS speech FROM (
         SELECT * REPLACE (CASE WHEN above THEN run + 1 ELSE 0 END AS run) FROM (
           SELECT *, db > greatest(noise + 8, -65) AS above FROM (
             SELECT l.stream, l.seq, l.db, f.run, f.hold, f.speech, f.first, f.silence, f.spare, least(greatest(CASE WHEN l.db < f.noise THEN f.noise + (l.db - f.noise) * CAST(0.25 AS DOUBLE) WHEN NOT f.speech THEN f.noise + (l.db - f.noise) * CAST(0.002 AS DOUBLE) ELSE f.noise END, -90), -20) AS noise
             FROM f JOIN l ON l.stream = f.stream AND l.seq = f.seq + 1)))))))),
c AS (SELECT stream, seq AS until, cut_first AS first, cut_stop AS stop FROM f WHERE cut_first IS NOT NULL
 UNION ALL SELECT stream, m + 1, first, m - least(greatest(silence - 3, 0), greatest(m - first - 3, 0)) FROM f JOIN n USING (stream) WHERE seq = m AND first IS NOT NULL)
SELECT stream AS meeting_id, 'Microphone' AS source, row_number() OVER (PARTITION BY stream ORDER BY until) - 1 AS seq, first AS first_frame, stop AS end_frame, first * 20 AS start_ms, stop * 20 AS end_ms FROM c""",
    "vector_speaker_clusters": """WITH RECURSIVE e AS (SELECT CAST(label AS BIGINT) * 1000000000 + vec_id // 1000 AS stream, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
u AS MATERIALIZED (SELECT stream, vec_id AS seq, row_number() OVER (PARTITION BY stream ORDER BY vec_id) AS k, CASE WHEN sqrt(list_dot_product(e, e)) >= 1e-9 THEN list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) ELSE e END AS v FROM e),
f AS (SELECT DISTINCT stream, CAST(NULL AS BIGINT) AS seq, CAST(0 AS BIGINT) AS k, CAST([] AS DOUBLE[][]) AS centroids, CAST([] AS BIGINT[]) AS counts, CAST(NULL AS BIGINT) AS cluster FROM u
 UNION ALL
 SELECT stream, seq, k,
   CASE WHEN cluster IS NULL THEN centroids WHEN fresh THEN list_append(centroids, v) ELSE list_transform(centroids, lambda c, i: CASE WHEN i = cluster + 1 THEN moved ELSE c END) END,
   CASE WHEN cluster IS NULL THEN counts WHEN fresh THEN list_append(counts, 1) ELSE list_transform(counts, lambda n, i: CASE WHEN i = cluster + 1 THEN n + 1 ELSE n END) END,
   cluster
 FROM (SELECT * REPLACE (list_transform(moved, lambda x: x / CASE WHEN size >= 1e-9 THEN size ELSE 1 END) AS moved) FROM (
  SELECT *, sqrt(list_sum(list_transform(moved, lambda x: x * x))) AS size FROM (
   SELECT *, list_transform(v, lambda x, i: CASE WHEN fresh THEN x ELSE centroids[cluster + 1][i] + (x - centroids[cluster + 1][i]) / (counts[cluster + 1] + 1) END) AS moved FROM (
   SELECT *, CASE WHEN v IS NULL THEN NULL WHEN fresh THEN len(centroids) ELSE list_position(near, list_max(near)) - 1 END AS cluster FROM (
     SELECT *, len(near) = 0 OR (list_max(near) < 0.3 AND len(near) < 8) AS fresh FROM (
       SELECT u.stream, u.seq, u.k, u.v, f.centroids, f.counts, list_transform(f.centroids, lambda c: list_dot_product(c, u.v)) AS near FROM f JOIN u ON u.stream = f.stream AND u.k = f.k + 1)))))))
SELECT stream, seq, cluster FROM f WHERE k > 0""",
    "level_smoothed": _FOLD.format(levels=LEVELS_SQL) + """
l AS MATERIALIZED (SELECT stream, seq, value FROM levels),
f AS (SELECT stream, seq, value AS s FROM l WHERE seq = 1 UNION ALL SELECT l.stream, l.seq, f.s + (l.value - f.s) * CAST(0.1 AS DOUBLE) FROM f JOIN l ON l.stream = f.stream AND l.seq = f.seq + 1)
SELECT f.stream, n.m AS n, round(s, 9) AS last FROM f JOIN n ON n.stream = f.stream AND n.m = f.seq""",
    "level_stalls": f"WITH {LEVELS_SQL}, w AS (SELECT stream, seq, lead(secs) OVER (PARTITION BY stream ORDER BY seq) - secs AS gap FROM levels) SELECT stream, seq, round(gap, 3) AS gap_seconds FROM w WHERE gap > 36000",
    "level_silence_runs": f"WITH {LEVELS_SQL}, w AS (SELECT stream, seq, db, count(*) FILTER (db >= -30) OVER (PARTITION BY stream ORDER BY seq ROWS UNBOUNDED PRECEDING) AS loud FROM levels) SELECT stream, min(seq) AS first_seq, count(*) AS n FROM w WHERE db < -30 GROUP BY stream, loud",
    "level_gap_filled": f"""WITH {LEVELS_SQL}, t AS (SELECT stream, CAST(floor(secs / 86400) AS BIGINT) AS tick, sum(value) AS value FROM levels GROUP BY 1, 2), e AS (SELECT stream, unnest(range(min(tick), max(tick) + 1)) AS tick FROM t GROUP BY stream)
SELECT stream, tick, round(coalesce(value, 0), 6) AS value, value IS NULL AS inserted FROM e LEFT JOIN t USING (stream, tick)""",
    "level_inserted_share": f"""WITH {LEVELS_SQL}, t AS (SELECT DISTINCT stream, CAST(floor(secs / 86400) AS BIGINT) AS tick FROM levels), g AS (SELECT stream, 1 - count(*) / CAST(max(tick) - min(tick) + 1 AS DOUBLE) AS share FROM t GROUP BY stream) SELECT stream, round(share, 9) AS share FROM g WHERE share >= 0.001""",
    "sample_dc_block": _FOLD.format(levels=LEVELS_SQL) + """
l AS MATERIALIZED (SELECT stream, seq, value FROM levels),
f AS (SELECT stream, seq, value AS x, value AS y FROM l WHERE seq = 1 UNION ALL SELECT l.stream, l.seq, l.value, l.value - f.x + (1 - 2 * pi() * 20 / 16000) * f.y FROM f JOIN l ON l.stream = f.stream AND l.seq = f.seq + 1)
SELECT stream, seq - 1 AS pos, round(y, 9) AS y FROM f""",
    "sample_mix": f"WITH {LEVELS_SQL} SELECT stream // 2 AS meeting_id, seq - 1 AS pos, round((coalesce(sum(value) FILTER (stream % 2 = 0), 0) + coalesce(sum(value) FILTER (stream % 2 = 1), 0)) * pow(10, CAST(-8.178746 AS DOUBLE) / 20), 9) AS y FROM levels GROUP BY 1, 2",
    "sample_downmix": f"WITH {LEVELS_SQL} SELECT stream, (seq - 1) // 2 AS pos, round(sum(value) / 2, 9) AS y FROM levels GROUP BY 1, 2 HAVING count(*) = 2",
    "sample_normalised": f"""WITH {LEVELS_SQL}, p AS (SELECT stream, max(abs(value)) AS peak FROM levels GROUP BY stream), g0 AS (SELECT stream, CASE WHEN peak > 1e-9 THEN least(pow(10, CAST(-0.05 AS DOUBLE)) / peak, 10) ELSE 1 END AS gain FROM p),
g AS (SELECT stream, CASE WHEN abs(20 * log10(gain)) < 0.1 THEN 1 ELSE gain END AS gain FROM g0) SELECT stream, seq - 1 AS pos, round(value * gain, 9) AS y FROM levels JOIN g USING (stream)""",
    "sample_quantised": f"WITH {LEVELS_SQL} SELECT stream, seq - 1 AS pos, CAST(round_even(least(greatest(value, -1.0), 1.0) * 32767, 0) AS BIGINT) AS y FROM levels",
    "sample_interpolated": f"""WITH {LEVELS_SQL}, w AS (SELECT stream, seq, coalesce(lag(value) OVER o, value) AS a, value AS b, coalesce(lead(value) OVER o, value) AS c, coalesce(lead(value, 2) OVER o, lead(value) OVER o, value) AS d FROM levels WINDOW o AS (PARTITION BY stream ORDER BY seq))
SELECT stream, seq, round(-a / 16 + 9 * b / 16 + 9 * c / 16 - d / 16, 9) AS y FROM w""",
    "vector_cosines": """WITH u AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e, lead(CAST(embedding AS DOUBLE[])) OVER (PARTITION BY label ORDER BY vec_id) AS f FROM embeddings)
SELECT vec_id, label, round(list_dot_product(e, f) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(f, f))), 6) AS cosine FROM u WHERE f IS NOT NULL""",
    "vector_statistics": """WITH u AS (SELECT label, unnest(range(len(embedding))) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) SELECT label, i, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS deviation FROM u GROUP BY label, i""",
    "model_lookups": """WITH r AS (SELECT c_custkey AS request_id, ['WHISPER-TINY-Q5_1', 'whisper-small-q5_1', 'Whisper-Base-q5_1', 'no-such'][c_custkey % 4 + 1] AS wanted FROM customer)
SELECT request_id, wanted, CASE WHEN wanted <> 'no-such' THEN lower(wanted) END AS model_id FROM r""",
    "diarizer_settings": "SELECT o_orderkey AS run_id, o_orderstatus = 'O' AND o_totalprice > 100000 AND o_orderkey % 3 <> 0 AS diarizer FROM orders",
    "meeting_abilities": """WITH f AS (SELECT l_orderkey AS id, bool_or(l_linenumber IN (1, 4)) AS s, bool_or(l_linenumber = 2) AS i FROM lineitem WHERE l_quantity < 10 GROUP BY 1)
SELECT o_orderkey AS meeting_id, o_orderpriority = '1-URGENT' AS is_imported, coalesce(s OR i, false) AS can_transcribe, coalesce(s, false) AS has_attribution FROM orders LEFT JOIN f ON id = o_orderkey""",
    "smoothing_coefficients": "SELECT event_id, round(CASE WHEN value - 10 > 0 AND event_type <> 'error' THEN exp(-1 / (16000 * (value - 10) / 1000)) ELSE 0 END, 9) AS coefficient FROM events",
    "model_choice": f"""WITH {_MODELS}, m AS (SELECT c_custkey AS machine_id, CAST(c_custkey % 16 + 1 AS INTEGER) AS cores, CAST(c_custkey % 33 AS DOUBLE) AS ram, (c_custkey % 97) / 20.0 AS score FROM customer),
s AS (SELECT *, row_number() OVER (ORDER BY cost) AS rank FROM models WHERE purpose = 'speech'),
p AS (SELECT m.*, s.*, CAST(1.1 AS DOUBLE) * cost / greatest(score, 0.05) AS factor FROM m JOIN s ON ram * 1024 >= ram_mb * 3 OR rank = 1 WHERE CAST(1.1 AS DOUBLE) * cost / greatest(score, 0.05) <= 1.5 OR rank = 1),
t AS (SELECT machine_id, arg_max(model_id, ram_mb) AS text_model FROM m JOIN models ON purpose = 'text' AND license LIKE 'Apache%' AND ram * 1024 >= ram_mb * 3 GROUP BY machine_id)
SELECT machine_id, arg_max(model_id, rank) AS speech_model, round(arg_max(factor, rank), 9) AS factor, any_value(text_model) AS text_model, CAST(least(greatest(any_value(cores) // 2, 2), 6) AS INTEGER) AS threads, any_value(cores) >= 4 AS diarization, any_value(ram) >= 8 AS minutes
FROM p LEFT JOIN t USING (machine_id) GROUP BY machine_id""",
    "storage_footprint": """WITH s AS (SELECT c_custkey AS k, CASE WHEN k % 2 = 0 THEN (96 + k % 4 * 32) * 1000 / 8 ELSE 96000.0 END AS kept, CASE WHEN k % 3 <> 0 AND k % 5 <> 0 THEN 64000.0 ELSE 0.0 END AS working FROM customer)
SELECT k AS setting_id, CAST(96000 + working AS DOUBLE) AS recording_bytes_s, round(CAST((kept + CASE WHEN k % 7 = 0 THEN 0 ELSE working END) AS DOUBLE) * 3600 / 1e6, 6) AS kept_mb_h, round(k * 1000000 / CAST((96000 + working) * 3600 AS DOUBLE), 9) AS hours_that_fit FROM s""",
    "preflight_overall": """WITH c AS (SELECT s_suppkey AS k, unnest([CASE WHEN k * 104857600 < 524288000 THEN 3 WHEN k * 104857600 < 2147483648 THEN 2 ELSE 1 END, CASE WHEN k % 11 <> 0 THEN 1 ELSE 3 END, CASE WHEN k % 7 > 0 THEN 1 ELSE 3 END, CASE WHEN k % 3 = 0 THEN 1 ELSE 2 END]) AS s FROM supplier)
SELECT k AS report_id, ['NotTested', 'Ok', 'Warning', 'Error'][max(s) + 1] AS overall, count(*) FILTER (s = 3) AS n_error, count(*) FILTER (s = 2) AS n_warning, CAST(CASE WHEN max(s) = 3 THEN 1 ELSE 0 END AS INTEGER) AS exit_code FROM c GROUP BY k""",
    "folder_names": r"""WITH b AS (SELECT o_orderkey AS created_seq, strftime(o_orderdate, '%Y-%m-%d_%H%M') || '_' || left(regexp_replace(regexp_replace(o_orderpriority || ' / a|b', '[<>:"/\\|?* ]', '_', 'g'), '^_+|_+$', '', 'g'), 60) AS base FROM orders),
n AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY created_seq) AS n FROM b) SELECT created_seq, base, CASE WHEN n = 1 THEN base ELSE base || '_' || n END AS path FROM n""",
    "perf_log_fields": """WITH l AS (SELECT user_id AS log, event_id AS line_no, CASE WHEN event_type = 'purchase' THEN 'h' WHEN event_type = 'click' AND event_id % 3 = 0 THEN 'p' ELSE 'f' END AS kind, event_type AS key, CAST(event_id % 13 AS VARCHAR) AS value FROM events),
b AS (SELECT *, count(*) FILTER (kind = 'h') OVER (PARTITION BY log ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS block FROM l),
e AS (SELECT *, count(*) FILTER (kind = 'p') OVER (PARTITION BY log, block ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS ended FROM b)
SELECT log, block, key, arg_min(value, line_no) AS value FROM e WHERE kind = 'f' AND block > 0 AND ended = 0 GROUP BY log, block, key""",
    "settings_migrated": """WITH e AS (SELECT event_id AS k, event_id % 11 = 0 AS bad FROM events)
SELECT k AS id, CAST(CASE WHEN bad THEN 1 ELSE k % 3 END AS INTEGER) AS version, CAST(CASE WHEN bad THEN 192 WHEN k % 2 = 1 THEN 128 WHEN k % 3 < 2 THEN 192 ELSE 96 END AS INTEGER) AS bitrate, bad OR k % 5 <> 1 AS keep_audio,
  CASE WHEN bad OR k % 3 < 2 THEN 'Balanced' WHEN k % 7 = 0 THEN 'Fast' ELSE 'Accurate' END AS profile FROM e""",
    "meeting_totals": f"""WITH {SEGMENTS_SQL} SELECT meeting_id, max(end_ms) AS duration_ms, CAST(sum(end_ms - start_ms) AS BIGINT) AS speech_ms, round(sum(end_ms - start_ms) / greatest(max(end_ms), 1), 9) AS factor FROM segments GROUP BY meeting_id""",
    "source_files": """WITH f AS (SELECT DISTINCT p_partkey // 3 AS meeting_id, p_partkey % 4 AS ord FROM part) SELECT meeting_id, ['mic.wav', 'system.wav', 'imported.wav'][ord + 1] AS name, ['Microphone', 'SystemAudio', 'Imported'][ord + 1] AS kind, CAST(ord AS INTEGER) AS ord FROM f WHERE ord < 3""",
    "decoder_choice": """SELECT CAST(p_partkey AS VARCHAR) AS path, CASE WHEN p_partkey % 3 = 0 THEN 'decoder0' WHEN p_partkey % 5 = 0 THEN 'decoder1' WHEN p_partkey % 7 = 0 THEN 'decoder2' END AS decoder,
  CASE WHEN p_partkey % 3 <> 0 AND p_partkey % 5 <> 0 AND p_partkey % 7 <> 0 THEN 'refused ' || p_type END AS refusal FROM part""",
    "decoder_extensions": """WITH e AS (SELECT s_name, s_suppkey AS k, unnest([0, 1]) AS pos, unnest(['.x' || (s_suppkey % 9), CASE WHEN s_suppkey % 2 = 0 THEN '.X' || (s_suppkey % 9) ELSE '.Wav' END]) AS ext FROM supplier)
SELECT arg_min(ext, k * 2 + pos) AS extension, arg_min(s_name, k * 2 + pos) AS decoder FROM e GROUP BY lower(ext)""",
    "capture_formats": """WITH f AS (SELECT s_suppkey AS device_id, [8000, 16000, 44100, 48000, 96000][s_suppkey % 5 + 1] AS rate FROM supplier)
SELECT device_id, rate, rate = 48000 AS pass_through, rate < 48000 AS band_limited, rate <= 16000 AS speech_band_limited, CAST(rate / 2 AS DOUBLE) AS nyquist, CASE WHEN rate = 48000 THEN 'pass-through' ELSE 'resampled ' || rate || ' -> 48000 Hz' END AS conversion FROM f""",
    "transcode_results": """WITH c AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 6 = 0 THEN 'unavailable' WHEN c_custkey % 7 = 0 THEN 'failed' WHEN c_custkey % 5 = 0 THEN 'empty' END AS bad FROM customer)
SELECT k AS run_id, CASE WHEN bad IS NULL THEN 'mp3' ELSE 'wav' END AS kept, coalesce(bad, CASE WHEN k % 3 <> 1 THEN 'other bitrate' END) AS warning FROM c""",
    "generator_choice": "SELECT c_custkey AS setting_id, CASE WHEN c_custkey % 2 = 0 AND c_custkey % 3 < 2 AND c_custkey % 5 <> 0 AND c_custkey % 7 BETWEEN 1 AND 4 THEN 'local' ELSE 'extractive' END AS generator FROM customer",
    "meeting_warnings": "WITH f AS (SELECT user_id AS meeting_id, event_type AS warning, min(event_id) AS ord FROM events GROUP BY ALL) SELECT meeting_id, row_number() OVER (PARTITION BY meeting_id ORDER BY ord) AS position, warning FROM f",
    "connections": "SELECT user_id % 20 AS pid, 'host' || (event_id % 6) AS remote, min(event_id) AS first_seen, count(*) AS n FROM events WHERE event_type = 'view' GROUP BY 1, 2",
    "cpu_use": f"WITH {LEVELS_SQL} SELECT stream AS process, CAST(seq AS DOUBLE) AS at_, round(least(greatest(25 * value, 0.0), 100.0), 6) AS percent FROM levels WHERE seq > 1".replace("at_", '"at"'),
    "ring_buffers": """WITH RECURSIVE e AS MATERIALIZED (SELECT user_id AS stream, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq, CAST(floor(value) AS BIGINT) AS w, CAST(floor(value / 2) AS BIGINT) AS r FROM events),
m AS (SELECT stream, max(seq) AS last FROM e GROUP BY stream),
f AS (SELECT stream, CAST(0 AS BIGINT) AS seq, CAST(0 AS BIGINT) AS written, CAST(0 AS BIGINT) AS held, CAST(0 AS BIGINT) AS overruns, CAST(0 AS BIGINT) AS lost FROM m
  UNION ALL SELECT stream, seq, written + kept, greatest(held + kept - pushed - r, 0), overruns + CAST(w > 100 AS BIGINT) + CAST(pushed > 0 AS BIGINT), lost + w - kept + pushed
  FROM (SELECT *, greatest(held + kept - 100, 0) AS pushed FROM (SELECT e.stream, e.seq, e.w, e.r, least(e.w, 100) AS kept, f.written, f.held, f.overruns, f.lost FROM f JOIN e ON e.stream = f.stream AND e.seq = f.seq + 1)))
SELECT f.stream, written, held, overruns, lost FROM f JOIN m ON m.stream = f.stream AND m.last = f.seq""",
    "model_checks": """SELECT p_partkey AS model_id, CASE WHEN p_partkey % 4 = 0 OR p_partkey % 3 < 2 THEN 'missing' WHEN p_partkey % 5 = 0 THEN 'unverified' WHEN p_partkey % 7 = p_partkey % 2 THEN 'verified' ELSE 'mismatch' END AS status,
  CASE WHEN p_partkey * 1000000 >= 1073741824 THEN printf('%.1f GB', p_partkey * 1000000 / 1073741824) WHEN p_partkey * 1000000 >= 1048576 THEN printf('%.0f MB', p_partkey * 1000000 / 1048576) ELSE printf('%d KB', p_partkey * 1000000 // 1024) END AS size FROM part""",
    "device_reports": """WITH d AS (SELECT s_suppkey // 10 AS machine_id, CASE WHEN s_suppkey % 3 = 0 THEN 'capture' ELSE 'render' END AS kind, s_name AS name, s_suppkey % 10 <> 4 AS later FROM supplier),
g AS (SELECT machine_id, kind, count(*) || ': ' || string_agg(name, ', ' ORDER BY later, name) AS detail FROM d GROUP BY machine_id, kind),
e AS (SELECT DISTINCT machine_id, unnest(['capture', 'render', 'loopback']) AS kind FROM d)
SELECT machine_id, kind, CASE WHEN detail IS NULL THEN 'Error' ELSE 'Ok' END AS severity, coalesce(detail, 'none') AS detail FROM e LEFT JOIN g USING (machine_id, kind)""",
    "run_metrics": """WITH r AS (SELECT c_custkey AS k, c_custkey % 50 * 2.0 AS d, CAST(c_custkey % 64 / 4.0 AS DOUBLE) + CAST(0.001 AS DOUBLE) AS t FROM customer)
SELECT k AS run_id, printf('Transcription performance:\n  Meeting duration      = %.1f s\n  Speech detected       = %.1f s\n  Speech audio submitted= %.1f s\n  Chunks                = %d (encoder ran %d s of padded window)\n  Segments              = %d\n  Model                 = small\n  Total                 = %.2f s\n  RTF                   = %.2f x meeting duration',
  CAST(d AS DOUBLE), k % 40 / 2, k % 40 / 5, k % 9, k % 9 * 30, k % 20, CAST(t AS DOUBLE), CAST(CASE WHEN d > 0 THEN t / d ELSE 0 END AS DOUBLE)) AS block FROM r""".replace("\\n", "' || chr(10) || '").replace("printf('", "printf(('", 1).replace("duration',\n", "duration'),\n", 1),
    "check_reports": """SELECT n_regionkey AS report_id, string_agg('[' || [' OK ', 'WARN', 'FAIL', ' -- '][n_nationkey % 4 + 1] || '] ' || n_name || chr(10) || '      detail' || chr(10) || chr(10), '' ORDER BY n_nationkey) || 'overall: ' ||
  ['not tested', 'ok', 'warning', 'error'][max([1, 2, 3, 0][n_nationkey % 4 + 1]) + 1] AS text FROM nation GROUP BY n_regionkey""",
    "process_tree": """WITH RECURSIVE t AS (SELECT p_partkey AS pid, p_partkey // 3 AS parent_pid FROM part), f AS (SELECT pid AS root, pid FROM t WHERE pid IN (1, 2, 7) UNION SELECT f.root, t.pid FROM f JOIN t ON t.parent_pid = f.pid) SELECT * FROM f""",
    "minutes_text": f"""WITH {_MINUTES}, r AS (SELECT repeat('-', 40) || chr(10) AS rule, '  要確認' || chr(10) AS nothing)
SELECT meeting_id, '会議議事録' || chr(10) || repeat('=', 40) || chr(10) || '会議名   : ' || name || chr(10) || '日時     : ' || strftime(begun, '%Y-%m-%d %H:%M') || chr(10) || '録音時間 : ' || {_STAMP.format("ms")} || chr(10) ||
  replace('生成方法 : 抽出型（ローカル・AIモデル不使用）~~※ 文字起こしに存在しない情報は「要確認」と記載しています。~~1. 概要~', '~', chr(10)) || rule || overview || chr(10) || chr(10) || '2. 決定事項' || chr(10) || rule || coalesce('  ' || replace(rtrim(decision, chr(10)), chr(10) || '- [', chr(10) || '  - [') || chr(10), nothing) || chr(10) ||
  '3. 議題別内容' || chr(10) || rule || coalesce(plain, nothing || chr(10)) || '4. ToDo・ネクストアクション' || chr(10) || rule || coalesce(action, nothing) || chr(10) || '5. 継続検討事項' || chr(10) || rule || coalesce('  ' || replace(rtrim(open, chr(10)), chr(10) || '- [', chr(10) || '  - [') || chr(10), nothing) || chr(10) ||
  '6. 補足' || chr(10) || rule || '  - ' || note1 || chr(10) || '  - ' || note2 || chr(10) || CASE WHEN meeting_id % 3 = 0 THEN replace('  - 録音時の警告: gap ' || meeting_id || '~  - 録音時の警告: clipped~', '~', chr(10)) ELSE '' END || chr(10) AS text FROM doc CROSS JOIN r""",
    "transcript_headers": f"""WITH {SEGMENTS_SQL}, {_MEETINGS}
SELECT meeting_id, replace('  会議名      : ' || name || '~  開始日時    : ' || strftime(begun, '%Y-%m-%d %H:%M:%S') || ' +09:00~  録音時間    : ' ||
  {_STAMP.format("ms")} || '~  音声ファイル: audio.wav~  マイク      : ' || CASE WHEN meeting_id % 5 <> 0 THEN 'mic' ELSE '未設定' END || '~  PC音声      : ' || CASE WHEN meeting_id % 7 <> 0 THEN 'out|put' ELSE '未設定' END ||
  '~  認識モデル  : ' || CASE WHEN meeting_id % 4 <> 0 THEN 'small' ELSE 'なし' END || '~' || CASE WHEN meeting_id % 3 = 0 THEN '  備考        : 異常終了から復旧したデータです~' ELSE '' END, '~', chr(10)) AS header FROM meetings""",
    "transcript_cleared": f"WITH {SEGMENTS_SQL} SELECT meeting_id, id FROM segments WHERE meeting_id % 3 <> 0",
    "decode_options": """WITH s AS (SELECT c_custkey AS setting_id, ['Fast', 'Balanced', 'Accurate', '?'][c_custkey % 4 + 1] AS profile, CASE WHEN c_custkey % 7 <> 0 THEN ['ja', 'JA-jp', 'en', ' ', 'fr'][c_custkey % 5 + 1] END AS language FROM customer)
SELECT *, CASE profile WHEN 'Fast' THEN 1 WHEN 'Accurate' THEN 5 ELSE 2 END AS beam, CAST(CASE WHEN profile = 'Fast' THEN 0 ELSE 0.2 END AS DOUBLE) AS temperature_step,
  CASE WHEN trim(coalesce(language, '')) = '' OR lower(language) LIKE 'ja%' THEN '以下は会議の日本語の音声です。句読点を付けて書き起こします。' END AS initial_prompt FROM s""",
    "progress_fractions": """WITH r AS (SELECT c_custkey AS run_id, CAST(c_custkey % 50 * 1.5 AS DOUBLE) AS p, CAST(c_custkey % 11 * 5 AS DOUBLE) AS t, c_custkey % 50 * 4 AS received, CASE WHEN c_custkey % 6 <> 0 THEN c_custkey % 9 * 16 END AS total, CAST(c_custkey % 4 AS DOUBLE) AS b FROM customer)
SELECT run_id, round(CASE WHEN t > 0 THEN least(greatest(p / t, 0), 1) ELSE 0 END, 9) AS run_fraction, round(CASE WHEN total > 0 THEN least(greatest(received / total, 0), 1) END, 9) AS fraction, round(CASE WHEN total > 0 AND b > 1 THEN (total - received) / b END, 9) AS remaining_seconds FROM r""",
    "minutes_run_totals": """WITH e AS (SELECT user_id AS run_id, event_id % 5 = 0 AS last, event_id % 900 AS p, event_id % 70 AS o, CAST(event_id % 8 AS DOUBLE) / 4 AS s FROM events)
SELECT run_id, count(*) AS inferences, count(*) FILTER (NOT last) AS map_inferences, count(*) FILTER (last) AS reduce_inferences, CAST(sum(p) AS BIGINT) AS prompt_tokens, CAST(sum(o) AS BIGINT) AS output_tokens, sum(s) AS seconds,
  round(CASE WHEN sum(s) > 0 THEN CAST(sum(o) AS DOUBLE) / sum(s) ELSE 0 END, 9) AS tokens_per_second FROM e GROUP BY run_id""",
    "page_hashes": "SELECT page_id, sha256(coalesce(html, '')) AS measured, page_id % 2 = 0 AS matches FROM pages",
    "prompts_assembled": """WITH s AS (SELECT '次は会議の文字起こし全文です。この内容だけを使って議事録を作成してください。' AS task,
  replace('出力は次の6つの見出しを、この順序で、必ずすべて書いてください。~各見出しは行頭に単独で書き、その下に内容を「- 」で始まる箇条書きで書いてください。~該当する内容が無い見出しの下には「なし」とだけ書いてください。~~【概要】~【決定事項】~【議題別内容】~【ToDo】~【継続検討】~【補足】~', '~', chr(10)) AS six,
  replace('あなたは日本語の会議議事録作成アシスタントです。次の規則を厳守してください。~1. 与えられた文字起こしに書かれている内容だけを使うこと。書かれていない情報を推測・補完しては絶対にいけません。~2. 担当者名・期限・数値が文字起こしに明記されていない場合は必ず「要確認」と書くこと。~3. 人物名を推測してはいけません。文字起こしに現れる呼称のみを使うこと。~4. 出力は日本語の簡潔な箇条書きにすること。前置きや感想は書かないこと。~5. 該当する内容が無い場合は「なし」とだけ出力すること。', '~', chr(10)) AS rules),
p AS (SELECT doc_id, task || chr(10) || chr(10) || six || chr(10) || '---' || chr(10) || coalesce(text, '') || chr(10) || '---' AS prompt, length(rules || task || six) + 11 AS frame FROM documents CROSS JOIN s)
SELECT doc_id, sha256(prompt) AS prompt_sha256, length(prompt) AS n_chars, CAST(greatest(400, frame + 128) AS BIGINT) AS overhead FROM p""",
    "sample_low_pass": _biquad("2 * pi() * 3400 / 16000", "sin(w) / (2 * sqrt(CAST(0.5 AS DOUBLE))) AS alpha", "(1 - c) / 2 AS b0, 1 - c AS b1, (1 - c) / 2 AS b2, 1 + alpha AS a0, -2 * c AS a1, 1 - alpha AS a2"),
    "sample_band_pass": _biquad("2 * pi() * 1000 / 16000", "sin(w) / 3 AS alpha", "alpha AS b0, 0 AS b1, -alpha AS b2, 1 + alpha AS a0, -2 * c AS a1, 1 - alpha AS a2"),
    "sample_high_shelf": _biquad("2 * pi() * 3000 / 16000", "pow(10, CAST(6 AS DOUBLE) / 40) AS g, sqrt(2 * pow(10, CAST(6 AS DOUBLE) / 40)) * sin(w) AS r",
                                 "g * (g + 1 + (g - 1) * c + r) AS b0, -2 * g * (g - 1 + (g + 1) * c) AS b1, g * (g + 1 + (g - 1) * c - r) AS b2, g + 1 - (g - 1) * c + r AS a0, 2 * (g - 1 - (g + 1) * c) AS a1, g + 1 - (g - 1) * c - r AS a2"),
    "sample_band_levels": _FOLD.format(levels=LEVELS_SQL) + f"""l AS MATERIALIZED (SELECT stream, seq, value AS x FROM levels), {_band(1, 300.0, 1000.0, 2400)}, {_band(2, 1000.0, 1140.0, 2400)},
e AS (SELECT stream, (seq - 1) // 48 AS frame, count(*) AS n, sqrt(avg(x * x)) >= pow(10, CAST(-50 AS DOUBLE) / 20) AS loud FROM l GROUP BY ALL),
y AS (SELECT 'low-mid' AS band, stream, seq, y FROM f1 UNION ALL SELECT 'mid', stream, seq, y FROM f2),
r AS (SELECT y.stream, y.band, coalesce(sqrt(avg(y * y) FILTER (loud)), 0) AS rms, count(*) FILTER (loud) AS n FROM y JOIN e ON e.stream = y.stream AND e.frame = (y.seq - 1) // 48 WHERE y.seq > 0 GROUP BY ALL)
SELECT r.stream, r.band, round(r.rms, 9) AS rms, round(CASE WHEN r.n > 1200 AND q.rms > 0 AND r.rms > 0 THEN 20 * log10(r.rms / q.rms) ELSE -120 END, 6) AS relative_db FROM r JOIN r q ON q.stream = r.stream AND q.band = 'low-mid'""",
    "sample_upsampled": f"""WITH {LEVELS_SQL}, s AS (SELECT stream, list(value ORDER BY seq) AS x FROM levels GROUP BY stream), i AS (SELECT stream, x, unnest(range(2 * len(x))) AS i FROM s),
p AS (SELECT stream, i, CAST(i % 2 AS DOUBLE) / 2 AS t, x[greatest(i // 2 - 2, 1)] AS p0, x[greatest(i // 2 - 1, 1)] AS p1, x[greatest(i // 2, 1)] AS p2, x[i // 2 + 1] AS p3 FROM i)
SELECT stream, i AS pos, round(p1 + t * (p2 - p0) / 2 + t * t * (p0 - 2.5 * p1 + 2 * p2 - 0.5 * p3) + t * t * t * (1.5 * p1 - 0.5 * p0 - 1.5 * p2 + 0.5 * p3), 9) AS y FROM p""",
    "sample_muted": f"WITH {LEVELS_SQL} SELECT stream, seq - 1 AS pos, CASE WHEN stream % 3 = 0 THEN 0 ELSE round(value, 9) END AS y FROM levels",
    "sample_slices": f"""WITH {LEVELS_SQL}, s AS (SELECT stream, list(value ORDER BY seq)[stream % 5 + 1 : stream % 7 * 10] AS part FROM levels GROUP BY stream)
SELECT stream, len(part) AS n, round(part[1], 9) AS first FROM s WHERE len(part) >= 2""",
    "drift_drops": _FOLD.format(levels=LEVELS_SQL) + """
l AS MATERIALIZED (SELECT stream, seq, 300 + stream % 5 * 150 + seq % 7 * 10 AS backlog FROM levels),
f AS (SELECT stream, seq, CAST(backlog AS DOUBLE) / 1000 AS smooth, CASE WHEN backlog > 400 THEN 1 ELSE 0 END AS lasted, 0 AS dropped FROM l WHERE seq = 1
      UNION ALL SELECT stream, seq, now - dropped / 1000, lasted, CAST(dropped AS INTEGER) FROM (
        SELECT *, CAST(CASE WHEN lasted >= 5 THEN greatest(least(floor((now - 0.25) * 1000), 1, backlog), 0) ELSE 0 END AS DOUBLE) AS dropped FROM (
          SELECT stream, seq, now, backlog, CASE WHEN now > 0.4 THEN lasted + 1 ELSE 0 END AS lasted FROM (
            SELECT l.stream, l.seq, l.backlog, f.lasted, f.smooth + (CAST(l.backlog AS DOUBLE) / 1000 - f.smooth) / 2 AS now FROM f JOIN l ON l.stream = f.stream AND l.seq = f.seq + 1))))
SELECT stream, seq, CAST(dropped AS BIGINT) AS dropped FROM f""",
    "capture_probes": """SELECT event_id AS probe_id, CASE WHEN event_id % 7 = 0 THEN 'Error' WHEN event_id % 5 = 0 OR event_id % 90 >= 70 THEN 'Warning' ELSE 'Ok' END AS severity,
  round(CASE WHEN event_id % 3 > 0 THEN CAST(event_id % 5 * 1200000 AS DOUBLE) / (event_id % 3 * 48000) ELSE 0 END, 9) AS coverage FROM events""",
    "leg_clipping": """SELECT c_custkey AS meeting_id, CASE WHEN c_custkey % 13 >= c_custkey % 7 THEN 'Microphone' ELSE 'SystemAudio' END AS worse, CAST(greatest(c_custkey % 13, c_custkey % 7) AS DOUBLE) / 20000 AS share
FROM customer WHERE greatest(c_custkey % 13, c_custkey % 7) >= 2""",
    "manifest_upserts": """WITH n AS (SELECT 'M' || (p_partkey // 8) AS id, max(p_partkey) AS verified_at FROM part WHERE p_partkey % 4 = 0 GROUP BY 1)
SELECT id, verified_at, verified_at AS bytes FROM n UNION ALL SELECT 'm' || p_partkey, p_partkey, p_partkey * 10 FROM part WHERE 'M' || p_partkey NOT IN (SELECT id FROM n)""",
    "import_refusals": """WITH f AS (SELECT p_partkey AS p, ['.wav', '.MP3', '.txt', '', '.m4a'][p_partkey % 5 + 1] AS e FROM part)
SELECT 'folder/f' || p || e AS path, CASE WHEN p % 11 = 0 THEN 'missing' WHEN e IN ('.txt', '') THEN 'unsupported' WHEN p % 13 = 0 THEN 'empty' WHEN p % 17 = 0 THEN 'unreadable' WHEN p % 3 = 0 THEN 'undecodable' END AS refusal FROM f""",
    "spoken_spans": f"WITH {SEGMENTS_SQL} SELECT meeting_id, id FROM segments WHERE arrival_seq % 10 <> 9",
    "speech_run_totals": f"WITH {SEGMENTS_SQL} SELECT meeting_id, source, count(*) AS n_chunks, CAST(sum(end_ms - start_ms) AS DOUBLE) / 1000 AS submitted_seconds, count(*) * 30 AS encoder_seconds FROM segments GROUP BY ALL",
    "speaker_names_merged": f"WITH {SEGMENTS_SQL}, {_NAMES} SELECT meeting_id, source, speaker_id, CASE WHEN meeting_id % 3 <> 1 THEN 'Typed ' || speaker_id ELSE name END AS name FROM names",
    "journals_dismissed": f"WITH {JOURNAL_SQL} SELECT meeting_id, line_no, kind FROM journal WHERE meeting_id % 4 <> 0",
    "recognition_audio_kept": "SELECT c_custkey AS run_id, c_custkey % 6 <> 0 AS kept FROM customer",
    "meaningful_lines": f"""WITH r AS (SELECT conv_id, turn, ['- ' || text, 'なし', '・ ' || role, '```' || role, '* -', '* x', text] AS x FROM conversations),
b AS (SELECT conv_id, turn, list_transform(x, lambda v: {_trim("regexp_replace(" + _trim("v") + ", '^[-*・　 ]+', '')")}) AS x FROM r)
SELECT conv_id, turn, coalesce(array_to_string(list_filter(x, lambda v: length(v) >= 2 AND v <> 'なし' AND NOT starts_with(v, '```')), '|'), '') AS kept FROM b""",
    "mel_scale": """SELECT c_custkey AS id, round(2595 * log10(1 + CAST(c_custkey % 8000 AS DOUBLE) / 700), 6) AS mel, round(700 * (pow(10, CAST(c_custkey % 3000 AS DOUBLE) / 2595) - 1), 6) AS hertz,
  round(greatest(CAST(60 - c_custkey % 70 AS DOUBLE) / 60, 0), 9) AS meter FROM customer""",
}
