"""Ordered measurements of streams: statistics, clipping, meters, voice activity, stalls, gaps.

A measurement has stream, seq, at (seconds) and value or db. What a reduction can tell is an aggregate; what depends on order is a window or,
where each step needs the state before it, a fold over the stream's array inside the JVM or a walk through the stream's sorted batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.audio import SILENCE_DB, to_db

CLIP_LEVEL, CLIP_SHARE = 0.999, 1e-4
DECAY_DB = 40.0


def statistics(levels: DataFrame) -> DataFrame:
    """stream, n, rms, peak, rms_db, peak_db, n_clipped, clipped, looks_silent."""
    v = F.abs("value")
    rows = levels.groupBy("stream").agg(F.count("value").alias("n"), F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("rms"), F.max(v).alias("peak"), F.count_if(v >= CLIP_LEVEL).alias("n_clipped"))
    rows = rows.withColumn("rms_db", to_db(F.col("rms"))).withColumn("peak_db", to_db(F.col("peak")))
    clipped = (F.col("n_clipped") > 0) & (F.col("n_clipped") / F.col("n") >= CLIP_SHARE)
    return rows.withColumn("clipped", clipped).withColumn("looks_silent", F.col("peak_db") < -65.0)


def leg_clipping(samples: DataFrame, threshold: float = CLIP_LEVEL, least: float = CLIP_SHARE) -> DataFrame:
    """meeting_id, n, microphone, system, worst_fraction, clipped of ``samples`` (meeting_id, source, value): flattened samples of each leg, and the share of the worse one in the samples of a leg."""
    of = lambda source: F.col("source") == source
    flat = F.abs("value") >= threshold
    rows = samples.groupBy("meeting_id").agg(F.count_if(of("Microphone")).alias("n"), F.count_if(of("Microphone") & flat).alias("microphone"), F.count_if(of("SystemAudio") & flat).alias("system"))
    worst = F.when(F.col("n") > 0, F.greatest("microphone", "system") / F.col("n")).otherwise(F.lit(0.0))
    return rows.withColumn("worst_fraction", worst).withColumn("clipped", (F.col("n") > 0) & (F.col("worst_fraction") >= least))


def capture_probe(levels: DataFrame, seconds: float) -> DataFrame:
    """stream, samples, peak_db, rms_db of the first ``seconds`` of each stream: what a probe of its device would measure."""
    begin = F.min("at").over(Window.partitionBy("stream"))
    rows = levels.withColumn("begin", begin).where(F.col("at") - F.col("begin") < seconds)
    rows = rows.groupBy("stream").agg(F.count("value").alias("samples"), F.max(F.abs("value")).alias("peak"), F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("rms"))
    return rows.select("stream", "samples", to_db(F.coalesce("peak", F.lit(0.0))).alias("peak_db"), to_db(F.coalesce("rms", F.lit(0.0))).alias("rms_db"))


def peak_hold(levels: DataFrame, decay_db: float = DECAY_DB) -> DataFrame:
    """stream, seq, held: each peak falls ``decay_db`` a second, at most a second's worth from one measurement to the next."""
    order = Window.partitionBy("stream").orderBy("seq")
    gap = F.least(F.greatest(F.col("at") - F.lag("at").over(order), F.lit(0.0)), F.lit(1.0))
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = levels.withColumn("gap", F.coalesce(gap, F.lit(0.0)))
    rows = rows.withColumn("fallen", decay_db * F.sum("gap").over(so_far))
    # max(new, old - decay) unrolled: every earlier peak less what has fallen since
    held = F.max(F.col("db") + F.col("fallen")).over(so_far) - F.col("fallen")
    return rows.select("stream", "seq", F.greatest(held, F.lit(SILENCE_DB)).alias("held"))


def meters(levels: DataFrame, decay_db: float = DECAY_DB) -> DataFrame:
    """stream, seq, rms, peak, hold: a meter's three marks after each measurement (rms_db, peak_db); the hold falls at a quarter of the others' rate, none below silence."""
    order = Window.partitionBy("stream").orderBy("seq")
    gap = F.least(F.greatest(F.col("at") - F.lag("at").over(order), F.lit(0.0)), F.lit(1.0))
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = levels.withColumn("gap", F.coalesce(gap, F.lit(0.0))).withColumn("fallen", decay_db * F.sum("gap").over(so_far))
    mark = lambda db, rate: F.greatest(F.max(F.col(db) + F.col("fallen") * rate).over(so_far) - F.col("fallen") * rate, F.lit(SILENCE_DB))
    return rows.select("stream", "seq", mark("rms_db", 1.0).alias("rms"), mark("peak_db", 1.0).alias("peak"), mark("peak_db", 0.25).alias("hold"))


# The detector's thresholds in decibels and frames.
FALL, RISE, LOWEST, HIGHEST, MARGIN, LEAST_DB, ONSET, HANGOVER, START_DB = 0.25, 0.002, -90.0, -20.0, 8.0, -65.0, 2, 30, -60.0


class VoiceDetector:
    """An adaptive threshold over a noise floor that falls fast and rises slowly, one level after another; a level that is missing is as the noise."""

    def __init__(self, onset: int = ONSET, hangover: int = HANGOVER) -> None:
        self.onset, self.hangover = onset, hangover
        self.noise, self.run, self.hold, self.speech = START_DB, 0, 0, False

    def __call__(self, db: float | None) -> bool:
        if db is None:
            db = self.noise
        if db < self.noise:
            self.noise += (db - self.noise) * FALL
        elif not self.speech:
            self.noise += (db - self.noise) * RISE
        self.noise = min(max(self.noise, LOWEST), HIGHEST)
        if db > max(self.noise + MARGIN, LEAST_DB):
            self.run += 1
            if self.run >= self.onset:
                self.speech, self.hold = True, self.hangover
        else:
            self.run = 0
            if self.hold:
                self.hold -= 1
            else:
                self.speech = False
        return self.speech


def voice_activity(levels: DataFrame, onset: int = ONSET, hangover: int = HANGOVER) -> DataFrame:
    """stream, seq, noise_db, speech of each level (stream, seq, db) by a ``VoiceDetector`` for each stream.

    A stream goes through its task batch by batch in order of seq, so what is held is a batch, however long the stream.
    """

    def detect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, detector = None, None
        for batch in batches:
            noise, spoken = [], []
            for name, db in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if detector is None or name != stream:
                    stream, detector = name, VoiceDetector(onset, hangover)
                spoken.append(detector(db))
                noise.append(detector.noise)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(noise, pa.float64()), pa.array(spoken, pa.bool_())], ["stream", "seq", "noise_db", "speech"])

    rows = levels.select(F.col("stream").cast("long"), F.col("seq").cast("long"), F.col("db").cast("double")).repartition("stream").sortWithinPartitions("stream", "seq")
    return rows.mapInArrow(detect, "stream long, seq long, noise_db double, speech boolean")


def stalls(levels: DataFrame, longest_gap: float = 3.0) -> DataFrame:
    """stream, seq, gap_seconds: measurements after which the stream was silent for longer."""
    following = F.lead("at").over(Window.partitionBy("stream").orderBy("seq"))
    return levels.withColumn("gap_seconds", following - F.col("at")).where(F.col("gap_seconds") > longest_gap).select("stream", "seq", "gap_seconds")


def silence_runs(levels: DataFrame, silent_db: float) -> DataFrame:
    """stream, first_seq, n: maximal runs of measurements below ``silent_db``."""
    order = Window.partitionBy("stream").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = levels.withColumn("loud", F.sum((F.col("db") >= silent_db).cast("int")).over(order)).where(F.col("db") < silent_db)
    return rows.groupBy("stream", "loud").agg(F.min("seq").alias("first_seq"), F.count("*").alias("n")).drop("loud")


def gap_filled(levels: DataFrame, tick_seconds: int) -> DataFrame:
    """stream, tick, value, inserted: one value for each tick from a stream's first to its last; ticks without data are 0."""
    ticks = levels.withColumn("tick", F.floor(F.col("at") / tick_seconds)).groupBy("stream", "tick").agg(F.sum("value").alias("value"))
    spans = ticks.groupBy("stream").agg(F.min("tick").alias("a"), F.max("tick").alias("b"))
    every = spans.select("stream", F.explode(F.sequence("a", "b")).alias("tick"))
    return every.join(ticks, ["stream", "tick"], "left").select("stream", "tick", F.coalesce("value", F.lit(0.0)).alias("value"), F.col("value").isNull().alias("inserted"))


def inserted_share(filled: DataFrame, least: float = 0.001) -> DataFrame:
    """stream, share: of ticks without data, where it reaches ``least``."""
    rows = filled.groupBy("stream").agg(F.avg(F.col("inserted").cast("double")).alias("share"))
    return rows.where(F.col("share") >= least)


# The drift correction's seconds and samples.
SMOOTHING_S, TARGET_S, EXCESS_S, SUSTAINED_S, MOST_A_TICK_MS = 2.0, 0.25, 0.15, 5.0, 1


class DriftControl:
    """How many samples to drop at each tick: the smoothed backlog's excess, a little at a time, once it has lasted."""

    def __init__(self, rate: int, tick_seconds: float) -> None:
        self.rate, self.tick = rate, tick_seconds
        self.alpha = min(1.0, max(0.0, tick_seconds / SMOOTHING_S))
        self.most = int(rate * MOST_A_TICK_MS / 1000)
        self.smooth, self.lasted = -1.0, 0.0

    def __call__(self, backlog: int, inserted: int = 0) -> int:
        """A tick with ``backlog`` samples waiting, before which ``inserted`` samples of silence made up for a lack."""
        if inserted > 0:  # a stream that starves doesn't run fast
            self.smooth = self.lasted = 0.0
        now = backlog / self.rate
        self.smooth = now if self.smooth < 0 else self.smooth + (now - self.smooth) * self.alpha
        if self.smooth <= TARGET_S + EXCESS_S:
            self.lasted = 0.0
            return 0
        self.lasted += self.tick
        if self.lasted < SUSTAINED_S:
            return 0
        dropped = max(0, min(int((self.smooth - TARGET_S) * self.rate), self.most, backlog))
        self.smooth -= dropped / self.rate
        return dropped


def drift_corrections(backlogs: DataFrame, rate: int, tick_seconds: float) -> DataFrame:
    """stream, seq, dropped: samples to drop at each tick of a stream's ``backlog`` and, if given, ``inserted`` (in samples). Streams are gone through batch by batch."""
    columns = ["stream", "seq", "backlog", *(["inserted"] if "inserted" in backlogs.columns else [])]

    def control(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, tick = None, None
        for batch in batches:
            out = []
            for name, _, *counts in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if tick is None or name != stream:
                    stream, tick = name, DriftControl(rate, tick_seconds)
                out.append(tick(*counts))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.int64())], ["stream", "seq", "dropped"])

    rows = backlogs.select(*[F.col(c).cast("long") for c in columns]).repartition("stream").sortWithinPartitions("stream", "seq")
    return rows.mapInArrow(control, "stream long, seq long, dropped long")
