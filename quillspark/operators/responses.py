"""Responses of a language model, line by line: which section a line belongs to; prompts within a token budget."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.text import clean_line, heading_section, trimmed, utf16_length

MARGIN = 0.12
LEAST_BLOCK = 200
MOST_BLOCKS = 60


def sections(lines: DataFrame) -> DataFrame:
    """response_id, section, position, line: the lines (response_id, ord, line) under the headings before them.

    Lines before any heading belong to the overview; a response without headings is all overview.
    """
    rows = lines.select("response_id", "ord", trimmed(F.col("line")).alias("line")).where("line <> ''").withColumn("heading", heading_section(F.col("line")))
    so_far = Window.partitionBy("response_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("section", F.coalesce(F.last("heading", ignorenulls=True).over(so_far), F.lit("overview"))).where("heading IS NULL")
    rows = rows.withColumn("line", clean_line(F.col("line"))).where("line <> ''")
    place = Window.partitionBy("response_id", "section").orderBy("ord")
    return rows.select("response_id", "section", F.row_number().over(place).cast("long").alias("position"), "line")


def recognised(lines: DataFrame) -> DataFrame:
    """response_id, recognised_markers, fell_back: how many different headings a response holds."""
    rows = lines.select("response_id", heading_section(F.col("line")).alias("heading"))
    return rows.groupBy("response_id").agg(F.count_distinct("heading").alias("recognised_markers")).withColumn("fell_back", F.col("recognised_markers") == 0)


def budget(context_tokens: int) -> int:
    return int(context_tokens * (1.0 - MARGIN))


def plan(lines: DataFrame, prompt_tokens: int, output_tokens: int, context_tokens: int) -> DataFrame:
    """response_id, tokens, single_pass, block_budget; a character counts as a token unless lines bring ``tokens``."""
    tokens = F.col("tokens") if "tokens" in lines.columns else utf16_length(F.col("line"))
    room = budget(context_tokens)
    rows = lines.groupBy("response_id").agg(F.sum(tokens).cast("long").alias("tokens"))
    return rows.withColumn("single_pass", F.col("tokens") + prompt_tokens + output_tokens <= room).withColumn("block_budget", F.lit(max(LEAST_BLOCK, room - prompt_tokens - output_tokens)).cast("long"))


def packed(lines: DataFrame, block_budget: int, most_blocks: int = MOST_BLOCKS) -> DataFrame:
    """response_id, block, ord, tokens: lines in blocks, each filled as far as the next line fits.

    A block begins where the running sum since the last beginning would pass the budget, which depends on all lines before; so the sizes of a response's
    lines (not its texts) are gone through in order, batch by batch, with one sum held. The lines that come after ``most_blocks`` full
    blocks are left out; ``left_out`` counts them.
    """
    tokens = F.col("tokens") if "tokens" in lines.columns else utf16_length(F.col("line"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        response, block, held, filled = None, 0, 0, False
        for batch in batches:
            blocks = []
            for name, size in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if name != response:
                    response, block, held, filled = name, 0, 0, False
                if filled and held + size > block_budget:
                    block, held = block + 1, 0
                held, filled = held + size, filled or size > 0
                blocks.append(block)
            out = pa.RecordBatch.from_arrays([batch.column(0), pa.array(blocks, pa.int64()), batch.column(1), batch.column(2)], ["response_id", "block", "ord", "tokens"])
            yield out.filter(pc.less(out.column(1), most_blocks))

    kind = dict(lines.dtypes)["response_id"]
    rows = lines.select("response_id", F.col("ord").cast("long").alias("ord"), F.coalesce(tokens, F.lit(0)).cast("long").alias("tokens")).repartition("response_id").sortWithinPartitions("response_id", "ord")
    return rows.mapInArrow(pack, f"response_id {kind}, block long, ord long, tokens long")


def left_out(lines: DataFrame, packed_lines: DataFrame) -> DataFrame:
    """response_id, left_out, left_out_tokens: how many of the lines ``packed`` has no block for, for each response."""
    tokens = F.col("tokens") if "tokens" in lines.columns else utf16_length(F.col("line"))
    whole = lines.groupBy("response_id").agg(F.count("*").alias("n"), F.sum(tokens).cast("long").alias("t"))
    kept = packed_lines.groupBy("response_id").agg(F.count("*").alias("kept"), F.sum("tokens").alias("kept_tokens"))
    rest = lambda a, b: F.col(a) - F.coalesce(F.col(b), F.lit(0))
    return whole.join(kept, "response_id", "left").select("response_id", rest("n", "kept").alias("left_out"), rest("t", "kept_tokens").alias("left_out_tokens"))


def prefix_within(lines: DataFrame, most_tokens: int) -> DataFrame:
    """The first lines whose tokens together stay within ``most_tokens``; the very first always stays."""
    tokens = F.col("tokens") if "tokens" in lines.columns else utf16_length(F.col("line"))
    so_far = Window.partitionBy("response_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = lines.withColumn("so_far", F.sum(tokens).over(so_far).cast("long")).withColumn("first", F.min("ord").over(Window.partitionBy("response_id")))
    return rows.where((F.col("ord") == F.col("first")) | (F.col("so_far") <= most_tokens)).drop("first")


#: Tokens that a prompt's frame is taken to have at least, and those of a chat template on top of what is counted.
LEAST_OVERHEAD, TEMPLATE_TOKENS = 400, 128


# What a model is told.
SYSTEM_PROMPT = """あなたは日本語の会議議事録作成アシスタントです。次の規則を厳守してください。
1. 与えられた文字起こしに書かれている内容だけを使うこと。書かれていない情報を推測・補完しては絶対にいけません。
2. 担当者名・期限・数値が文字起こしに明記されていない場合は必ず「要確認」と書くこと。
3. 人物名を推測してはいけません。文字起こしに現れる呼称のみを使うこと。
4. 出力は日本語の簡潔な箇条書きにすること。前置きや感想は書かないこと。
5. 該当する内容が無い場合は「なし」とだけ出力すること。"""
WHOLE_TRANSCRIPT = "次は会議の文字起こし全文です。この内容だけを使って議事録を作成してください。"
MARKERS = ("概要", "決定事項", "議題別内容", "ToDo", "継続検討", "補足")
SIX_SECTIONS = """出力は次の6つの見出しを、この順序で、必ずすべて書いてください。
各見出しは行頭に単独で書き、その下に内容を「- 」で始まる箇条書きで書いてください。
該当する内容が無い見出しの下には「なし」とだけ書いてください。
"""


def format_instructions() -> str:
    """How to answer: the six headings, each on a line of its own."""
    return SIX_SECTIONS + "\n" + "".join(f"【{name}】\n" for name in MARKERS)


def assembled(requests: DataFrame, instructions: str | None = None) -> DataFrame:
    """Adds ``prompt`` to requests (instruction, body): the instruction, how to answer (by default in six sections), and the body between rules."""
    return requests.withColumn("prompt", F.concat("instruction", F.lit(f"\n\n{format_instructions() if instructions is None else instructions}\n---\n"), "body", F.lit("\n---")))


def frame_overhead(count: Callable[[str], int] = len) -> int:
    """Tokens to set aside for what stands around a transcript: the rules for the model and a prompt with an empty body, by ``count``."""
    frame = f"{SYSTEM_PROMPT}{WHOLE_TRANSCRIPT}\n\n{format_instructions()}\n---\n\n---"
    return max(LEAST_OVERHEAD, count(frame) + TEMPLATE_TOKENS)


def prompt_overhead(frame_tokens: Column) -> Column:
    """Tokens to set aside for a prompt's frame, given those counted in it."""
    return F.greatest(F.lit(LEAST_OVERHEAD), frame_tokens + TEMPLATE_TOKENS)
