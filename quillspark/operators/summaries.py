"""Minutes by a language model: blocks to summaries, summaries folded until they fit, the answer's sections; extractive minutes where that fails.

The model is an injected callable, text to text, called by Arrow batches; without one the extractive minutes are the answer.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import NONE, block_time_range, is_blank, meaningful, trimmed

from . import responses
from .lineage import cut
from .minutes import filled_template

#: Rounds of folding before what does not fit is cut.
MOST_ROUNDS = 3
Model = Callable[[str], str]


def inferred(prompts: DataFrame, make: Callable[[], Model]) -> DataFrame:
    """``prompts`` (response_id, block, prompt) with ``answer``; the model is made once in each task, and its failure is a null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()

        def ask(prompt: str) -> str | None:
            try:
                return model(prompt)
            except Exception:  # any failure of the model: the extractive minutes are used instead
                return None

        for batch in batches:
            yield batch[["response_id", "block"]].assign(answer=[ask(p) for p in batch["prompt"]])

    return prompts.select("response_id", "block", "prompt").mapInPandas(run, "response_id long, block long, answer string")


def blocks_of(lines: DataFrame, block_budget: int, most_blocks: int = responses.MOST_BLOCKS) -> DataFrame:
    """response_id, block, prompt: the lines (response_id, ord, line) packed into blocks, as text."""
    packed = responses.packed(lines, block_budget, most_blocks).select("response_id", "ord", "block")
    joined = lines.join(packed, ["response_id", "ord"]).groupBy("response_id", "block").agg(F.sort_array(F.collect_list(F.struct("ord", "line"))).alias("x"))
    return joined.select("response_id", "block", F.array_join(F.transform("x", lambda r: r["line"]), "").alias("prompt"))


def useful(answers: DataFrame) -> DataFrame:
    """Answers that say something: not blank, not ``なし``."""
    text = trimmed(F.col("answer"))
    return answers.withColumn("answer", text).where(~is_blank(F.col("answer")) & (F.col("answer") != NONE))


def map_topics(blocks: DataFrame, answers: DataFrame) -> DataFrame:
    """response_id, block, title, time_range, points: one topic for each useful answer, with the time range of its own block."""
    rows = useful(answers).join(blocks.select("response_id", "block", block_time_range(F.col("prompt")).alias("time_range")), ["response_id", "block"])
    points = meaningful(F.split("answer", "\n"))
    return rows.select("response_id", "block", F.concat(F.lit("要点 "), (F.col("block") + 1).cast("string")).alias("title"), "time_range", points.alias("points")).where(F.size("points") > 0)


def folded(answers: DataFrame, make: Callable[[], Model], block_budget: int) -> DataFrame:
    """Answers summarised again, block by block, until each response's fit in one block; then the first that fit.

    A response is left as it is once another round would be of one block, or has not made its answers fewer; at most MOST_ROUNDS rounds. The results of
    a round are checkpointed, so a model is never asked twice.
    """
    rows, open_ones = cut(useful(answers)), None
    for _ in range(MOST_ROUNDS):
        lines = rows.select("response_id", F.col("block").alias("ord"), F.concat("answer", F.lit("\n")).alias("line"))
        if open_ones is not None:
            lines = lines.join(open_ones, "response_id", "left_semi")
        large = responses.plan(lines, 0, 0, 1).where(F.col("tokens") > block_budget).select("response_id")
        again = blocks_of(lines.join(large, "response_id", "left_semi"), block_budget)
        several = again.groupBy("response_id").agg(F.max("block").alias("last")).where("last > 0").select("response_id")
        again = cut(again.join(several, "response_id", "left_semi"))
        if again.isEmpty():
            break
        shorter = cut(useful(inferred(again, make)))
        count = lambda d, name: d.groupBy("response_id").agg(F.count("*").alias(name))
        open_ones = cut(count(shorter, "now").join(count(rows, "before"), "response_id").where("now < before").select("response_id"))
        rows = cut(rows.join(open_ones, "response_id", "left_anti").unionByName(shorter.join(open_ones, "response_id", "left_semi")))
    lines = rows.select("response_id", F.col("block").alias("ord"), F.concat("answer", F.lit("\n")).alias("line"))
    kept = responses.prefix_within(lines, block_budget).select("response_id", F.col("ord").alias("block"))
    return rows.join(kept, ["response_id", "block"], "left_semi")


def minutes_of(answers: DataFrame, map_topics: DataFrame | None = None) -> DataFrame:
    """The minutes' template (``minutes.TEMPLATE``) of each answer (response_id, answer) of the last step, parsed by its headings."""
    lines = useful(answers).select("response_id", F.posexplode(F.split("answer", "\n")).alias("ord", "line"))
    return filled_template(responses.sections(lines), map_topics)


def minutes_or_fallback(answers: DataFrame, extractive: DataFrame) -> DataFrame:
    """response_id, markdown, generator, reason: the model's answer, or the extractive minutes where there is none."""
    joined = extractive.join(useful(answers).select("response_id", "answer"), "response_id", "left")
    failed = F.col("answer").isNull()
    return joined.select("response_id", F.coalesce("answer", "markdown").alias("markdown"), F.when(failed, "extractive").otherwise("local").alias("generator"), F.when(failed, F.lit("no answer of the model")).alias("reason"))
