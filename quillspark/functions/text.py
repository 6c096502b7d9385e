"""Text functions as Column expressions: trimming, sentences, cues, labels, names of files, lines of model output."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode has it; both Java's and RE2's patterns read it.
SPACE = r"[\x{9}-\x{D} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
SENTENCE_END = "[。！？!?\n]"
LEAST_SENTENCE = 4
UNKNOWN = "要確認"
NONE = "なし"


# The cue words that the minutes look for.
@dataclass(frozen=True)
class Cues:
    """Patterns that mark a sentence as decision, action or open point, and that find a due date."""

    decision: str = "(決定|決まりました|決めました|承認|合意|了承|確定|ことにします|ことにしましょう|でいきましょう|で進めます|に決め)"
    action: str = "(お願いします|お願いいたします|対応します|やります|やっておきます|進めます|作成します|共有します|確認します|送ります|準備します|次回まで|までに)"
    open: str = "(検討|保留|持ち帰り|次回|要確認|確認が必要|未定|課題|懸念|リスク)"
    due: str = r"((今日|本日|明日|明後日|今週|来週|再来週|今月|来月|月末|週末|次回)|(\p{Nd}{1,2}" + SPACE + r"*月" + SPACE + r"*\p{Nd}{1,2}" + SPACE + r"*日)|(\p{Nd}{1,2}/\p{Nd}{1,2}))"
    sentence_end: str = SENTENCE_END


def trimmed(text: Column) -> Column:
    """Without white space of any kind at its ends; ``trim`` knows the space only."""
    return F.btrim(text, F.lit(SPACES))


def is_blank(text: Column) -> Column:
    return F.coalesce(trimmed(text) == "", F.lit(True))


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units, in which the limits of names and headings are given."""
    return (F.octet_length(F.encode(text, "UTF-16LE")) / 2).cast("int")


def sentences(text: Column, end: str = SENTENCE_END, least: int = LEAST_SENTENCE) -> Column:
    """The trimmed sentences of at least ``least`` units, in order."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), end), trimmed)
    return F.filter(parts, lambda s: utf16_length(s) >= least)


def due_date(text: Column, cues: Cues) -> Column:
    """The first due date in the text, or ``UNKNOWN``."""
    found = F.regexp_extract(text, cues.due, 0)
    return F.when(found != "", found).otherwise(F.lit(UNKNOWN))


def sanitised_name(title: Column) -> Column:
    """A title as part of a folder name: forbidden characters and spaces become ``_``; at most 60 units; never empty."""
    marked = F.regexp_replace(trimmed(title), r'[<>:"/\\|?*\x{0}-\x{1F} ]', "_")
    cut = F.left(F.regexp_replace(marked, "^_+|_+$", ""), F.lit(60))
    return F.when(is_blank(title) | (cut == ""), F.lit("Meeting")).otherwise(cut)


def folder_name(started: Column, title: Column) -> Column:
    return F.concat_ws("_", F.date_format(started, "yyyy-MM-dd_HHmm"), sanitised_name(title))


def markdown_escaped(text: Column) -> Column:
    """As a table cell: bars escaped, line breaks as spaces."""
    return F.regexp_replace(F.replace(text, F.lit("|"), F.lit("\\|")), "\r?\n", " ")


def clean_line(line: Column) -> Column:
    """A line of model output without bullets and headings' marks; code fences become empty."""
    bare = trimmed(F.ltrim(line, F.lit("-*・　 #")))
    return F.when(bare.startswith("```"), F.lit("")).otherwise(bare)


#: The headings of the six sections, in their order.
HEADINGS = {"概要": "overview", "決定事項": "decisions", "議題別内容": "topics", "ToDo": "actions", "継続検討": "open", "補足": "notes"}


def heading_section(line: Column) -> Column:
    """The section that a heading line opens, or null: decoration aside, at most 24 units that begin with a heading."""
    bare = trimmed(F.btrim(trimmed(line), F.lit("#* \u3000:：-")))
    bare = trimmed(F.btrim(bare, F.lit("【】[]「」")))

    def section(low: Column) -> Column:
        fits = (F.length(low) > 0) & (F.length(low) <= 24) & (utf16_length(low) <= 24)
        return F.when(fits, F.coalesce(*[F.when(low.startswith(heading.lower()), F.lit(name)) for heading, name in HEADINGS.items()]))

    # as the element of an array the bare line is computed once, not once for each heading
    return F.element_at(F.transform(F.array(F.lower(bare)), section), 1)


def meaningful(lines: Column) -> Column:
    """Lines without bullets, without those shorter than two units, ``なし`` and code fences."""
    bare = F.transform(lines, lambda x: trimmed(F.ltrim(trimmed(x), F.lit("-*・　 "))))
    return F.filter(bare, lambda x: (utf16_length(x) >= 2) & (x != NONE) & ~x.startswith("```"))


def block_time_range(block: Column) -> Column:
    """``first 〜 last`` of the ``[h:mm:ss]`` marks in a block, one where they are the same; empty without marks."""
    marks = F.regexp_extract_all(block, F.lit(r"\[(\d+:\d{2}:\d{2})\]"), F.lit(1))
    first, last = F.get(marks, F.lit(0)), F.get(marks, F.size(marks) - 1)
    return F.when(F.size(marks) == 0, "").when(first == last, first).otherwise(F.concat(first, F.lit(" 〜 "), last))


def key_value(line: Column) -> Column:
    """struct(key, value) of an indented ``key = value`` line, or null."""
    pattern = r"^\s{2,}([^=]+?)\s*=\s*(.*)$"
    return F.when(line.rlike(pattern), F.struct(trimmed(F.regexp_extract(line, pattern, 1)).alias("key"), trimmed(F.regexp_extract(line, pattern, 2)).alias("value")))
