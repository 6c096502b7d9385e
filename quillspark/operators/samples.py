"""Blocks of audio samples as array columns: mixing, downmix, normalising, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.audio import normalising_gain, peak

#: Fixed value: decibels that leave head-room for two streams and the interpolation's overshoot.
MIX_GAIN_DB = -8.178746
SKIP_DB = 0.1


def mixed(a: Column, b: Column, gain_db: float = MIX_GAIN_DB) -> Column:
    """(a + b) times a constant gain; a side that ends early is silent from there."""
    gain = 10.0 ** (gain_db / 20.0)
    return F.zip_with(a, b, lambda x, y: (F.coalesce(x.cast("double"), F.lit(0.0)) + F.coalesce(y.cast("double"), F.lit(0.0))) * gain)


def aligned_mix(microphone: DataFrame, system: DataFrame) -> DataFrame:
    """meeting_id, block, samples: two sources mixed block by block; either one alone where the other has no block."""
    a = microphone.select("meeting_id", "block", F.col("samples").alias("a"))
    b = system.select("meeting_id", "block", F.col("samples").alias("b"))
    empty = F.expr("cast(array() as array<double>)")
    return a.join(b, ["meeting_id", "block"], "full").select("meeting_id", "block", mixed(F.coalesce("a", empty), F.coalesce("b", empty)).alias("samples"))


def muted(samples: Column, mute: Column) -> Column:
    return F.when(mute, F.transform(samples, lambda x: x * 0)).otherwise(samples)


def downmixed(interleaved: Column, channels: int) -> Column:
    """Mean of the channels of each frame."""
    frames = F.sequence(F.lit(0), (F.size(interleaved) / channels).cast("int") - 1)
    mean = lambda f: F.aggregate(F.slice(interleaved, f * channels + 1, channels), F.lit(0.0), lambda s, v: s + v.cast("double")) / channels
    return F.when(F.size(interleaved) >= channels, F.transform(frames, mean)).otherwise(F.expr("cast(array() as array<double>)"))


def normalised(blocks: DataFrame, target_db: float = -1.0, most_db: float = 20.0) -> DataFrame:
    """Each stream's blocks (stream, …, samples) times one constant that brings its peak to the target; not where it hardly changes.

    Two passes: the peak of a stream is an aggregate over its blocks, whose gain is joined back.
    """
    peaks = blocks.groupBy("stream").agg(F.max(peak(F.col("samples"))).alias("peak"))
    gain = normalising_gain(F.col("peak"), target_db, most_db)
    gains = peaks.select("stream", F.when(F.abs(20.0 * F.log10(gain)) < SKIP_DB, F.lit(1.0)).otherwise(gain).alias("gain"))
    return blocks.join(gains, "stream").withColumn("samples", F.transform("samples", lambda x: x.cast("double") * F.col("gain")))


def spans(blocks: DataFrame, wanted: DataFrame, rate: int, block_samples: int, least_seconds: float = 0.25) -> DataFrame:
    """stream, span, samples of the ``wanted`` spans (stream, span, start_ms, end_ms) over ``blocks`` (stream, block, samples) of ``block_samples`` each but the last.

    A span meets only the blocks that it touches; one that holds less than ``least_seconds`` is left out.
    """
    at = lambda ms: F.greatest(F.floor(ms * rate / 1000), F.lit(0)).cast("long")
    pieces = wanted.select("stream", "span", at(F.col("start_ms")).alias("first"), at(F.col("end_ms")).alias("end")).where("end > first")
    pieces = pieces.withColumn("block", F.explode(F.sequence(F.expr(f"first div {block_samples}"), F.expr(f"(end - 1) div {block_samples}"))))
    joined = pieces.join(blocks.select("stream", "block", "samples"), ["stream", "block"])
    low = F.greatest(F.col("first") - F.col("block") * block_samples, F.lit(0)).cast("int")
    high = F.least(F.col("end") - F.col("block") * block_samples, F.size("samples")).cast("int")
    part = F.slice("samples", low + 1, F.greatest(high - low, F.lit(0)))
    rows = joined.groupBy("stream", "span").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("block", part.alias("part")))), lambda r: r["part"])).alias("samples"))
    return rows.where(F.size("samples") >= int(least_seconds * rate))
