"""Resampling and adaptive downmix of long streams with their blocks in parallel.

What a block needs of those before it is small: for resampling the number of samples and the last three of them, for the downmix sums of energies.
A window over one small row a block brings it to each block; then the blocks are worked on in any order, on any task. The low-passes before a
lower rate run in parallel too (``recurrence``).

Defined cases: a stream's blocks have any lengths; an empty or null block gives an empty one; an empty table gives an empty one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import recurrence
from .filters import Biquad, Downmixer, interpolated
from .lineage import written

#: Samples before a block that the interpolation looks at.
REACH = 3


def low_passes(source_rate: int, target_rate: int) -> recurrence.Bank:
    """What a stream goes through before it is resampled: two low-passes where the new rate is lower, else nothing."""
    return recurrence.Bank([[Biquad.low_pass(source_rate, 0.45 * target_rate)] * 2 if target_rate < source_rate else []])


def _interpolated(blocks: DataFrame, target_rate: int) -> DataFrame:
    """``blocks`` (stream, block, sample_rate, samples) at ``target_rate``, without a filter. Output i lies at i * sample_rate / target_rate, in whole numbers."""
    kind = dict(blocks.dtypes)["stream"]
    before = Window.partitionBy("stream").orderBy("block")
    rows = blocks.where(F.size("samples") > 0).select("stream", "block", F.size("samples").alias("n"), F.slice("samples", F.greatest(F.size("samples") - (REACH - 1), F.lit(1)), REACH).alias("tail"), F.get("samples", F.lit(0)).alias("head"))
    # three blocks before have three samples, however short they are; the first sample stands for what was before it
    none = F.array().cast("array<double>")
    earlier = [F.coalesce(F.lag("tail", i).over(before), none) for i in range(REACH, 0, -1)]
    line = F.concat(F.array_repeat(F.first("head").over(before), REACH), *earlier)
    start = F.coalesce(F.sum("n").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.select("stream", "block", start.alias("start"), F.slice(line, -REACH, REACH).alias("history"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for rate, x, start, history in zip(frame["sample_rate"], frame["samples"], frame["start"], frame["history"], strict=True):
                if x is None or not len(x):
                    out.append(np.zeros(0))
                    continue
                rate, start = int(rate), int(start)
                if rate == target_rate:
                    out.append(np.asarray(x, np.float64))
                    continue
                first, end = -(-start * target_rate // rate), -(-(start + len(x)) * target_rate // rate)
                # where output ``first`` lies, in parts of 1 / target_rate of a sample from the block's start
                place = first * rate - start * target_rate + rate * np.arange(end - first, dtype=np.int64)
                out.append(interpolated(np.r_[np.asarray(history, np.float64), np.asarray(x, np.float64)], place // target_rate, place % target_rate / target_rate))
            yield frame[["stream", "block"]].assign(samples=out)

    return blocks.join(rows, ["stream", "block"], "left").select("stream", "block", "sample_rate", "samples", "start", "history").mapInPandas(run, f"stream {kind}, block long, samples array<double>")


def resampled_each(blocks: DataFrame, target_rate: int) -> DataFrame:
    """``blocks`` (stream, block, sample_rate, samples), each stream from its own rate to ``target_rate``: Catmull-Rom interpolation, after two
    low-passes at 0.45 of the new rate where it is lower."""
    if target_rate <= 0:
        raise ValueError("sample rates must be positive")
    rates = blocks.select("stream", "block", F.col("sample_rate").cast("long").alias("sample_rate"), F.coalesce("samples", F.array()).cast("array<double>").alias("samples"))
    wrong = F.raise_error(F.lit("sample rates must be positive")).cast("long")
    rates = rates.withColumn("sample_rate", F.when(F.col("sample_rate") > 0, F.col("sample_rate")).otherwise(wrong))
    passed = recurrence.through(rates, lambda rate: low_passes(int(rate), target_rate), by="sample_rate")
    # read twice, for the ends of the blocks and for the blocks
    return _interpolated(written(passed.select("stream", "block", "sample_rate", F.element_at("outputs", 1).alias("samples"))), target_rate)


def resampled(blocks: DataFrame, source_rate: int, target_rate: int) -> DataFrame:
    """``blocks`` (stream, block, samples) from ``source_rate`` to ``target_rate``."""
    if min(source_rate, target_rate) <= 0:
        raise ValueError("sample rates must be positive")
    rows = blocks.select("stream", "block", F.coalesce("samples", F.array()).cast("array<double>").alias("samples"))
    if source_rate == target_rate:
        return rows
    if target_rate < source_rate:
        rows = written(recurrence.filtered(rows, low_passes(source_rate, target_rate).chains[0]))
    return _interpolated(rows.withColumn("sample_rate", F.lit(source_rate).cast("long")), target_rate)


def adaptively_downmixed(blocks: DataFrame, channels: int, rate: int) -> DataFrame:
    """Mean of the interleaved channels of ``blocks`` (stream, block, samples), until half a second of sound shows that they cancel each other: then, from the
    next block on, the first channel alone. Quiet blocks don't count; what is left of a block after its last whole frame is dropped."""
    kind = dict(blocks.dtypes)["stream"]
    rows = blocks.select("stream", "block", F.coalesce("samples", F.array()).cast("array<double>").alias("samples"))
    if channels <= 1:
        return rows
    frames_of = lambda x: np.asarray(x, np.float64)[: len(x) // channels * channels].reshape(-1, channels)

    def energies(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for x in frame["samples"]:
                y = frames_of(x)
                energy = (y**2).sum() / channels
                loud = len(y) > 0 and math.sqrt(energy / len(y)) >= 10 ** (Downmixer.FLOOR_DB / 20)
                out.append(((y.mean(axis=1) ** 2).sum(), energy, len(y)) if loud else (0.0, 0.0, 0))
            yield frame[["stream", "block"]].assign(of_mean=[o[0] for o in out], of_channels=[o[1] for o in out], heard=[o[2] for o in out])

    sums = rows.mapInPandas(energies, f"stream {kind}, block long, of_mean double, of_channels double, heard long")
    in_order = Window.partitionBy("stream").orderBy("block")
    so_far, before = in_order.rowsBetween(Window.unboundedPreceding, 0), in_order.rowsBetween(Window.unboundedPreceding, -1)
    ratio = 10 * F.log10(F.greatest(F.sum("of_mean").over(so_far) / F.sum("of_channels").over(so_far), F.lit(1e-12)))
    alone = F.when(F.sum("heard").over(so_far) >= Downmixer.LEAST_SECONDS * rate, ratio < -10 * math.log10(channels) - Downmixer.MARGIN_DB)
    # the first answer counts, for the blocks after it
    shown = sums.select("stream", "block", alone.alias("shown"))
    decided = shown.select("stream", "block", F.coalesce(F.first("shown", ignorenulls=True).over(before), F.lit(False)).alias("first_only"))

    def mix(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = [frames_of(x)[:, 0] if alone else frames_of(x).mean(axis=1) for x, alone in zip(frame["samples"], frame["first_only"], strict=True)]
            yield frame[["stream", "block"]].assign(samples=out)

    return rows.join(decided, ["stream", "block"]).select("stream", "block", "samples", "first_only").mapInPandas(mix, f"stream {kind}, block long, samples array<double>")
