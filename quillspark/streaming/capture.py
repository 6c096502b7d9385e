"""Live streams: frames from blocks, levels with stalls, speech chunks as they are completed, journals written in intervals.

The jitter delay of a capture is a watermark; what comes later than it is lost, and its place is silence when the timeline is filled. Streams end with an
``availableNow`` trigger or a timer, which flushes what is open.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from quillspark.operators.speech import CHUNK, FRAME_MS, Chunker, Pauses

JITTER, FLUSH = "250 milliseconds", "15 seconds"


def window_levels(samples: DataFrame, width: str = "20 milliseconds", delay: str = JITTER) -> DataFrame:
    """stream, frame (window), n, energy, peak of tumbling windows over ``samples`` (stream, ts, value); for batch or streaming."""
    rows = samples.withWatermark("ts", delay) if samples.isStreaming else samples
    v = F.col("value").cast("double")
    return rows.groupBy("stream", F.window("ts", width).alias("frame")).agg(F.count("*").alias("n"), F.sum(v * v).alias("energy"), F.max(F.abs(v)).alias("peak"))


def sessions(samples: DataFrame, gap: str, delay: str = JITTER) -> DataFrame:
    """stream, first, last, n: runs of ``samples`` (stream, ts) without a gap of that length."""
    rows = samples.withWatermark("ts", delay) if samples.isStreaming else samples
    return rows.groupBy("stream", F.session_window("ts", gap).alias("session")).agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("n")).drop("session")


class StallMonitor(StatefulProcessor):
    """Tells when a stream that was heard is silent for longer than ``longest`` seconds of event time."""

    def __init__(self, longest: float) -> None:
        self.longest = longest

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "at timestamp")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        found, last = [], self.last.get()[0] if self.last.exists() else None
        for at in sorted(pd.to_datetime(pd.concat([r["ts"] for r in rows]))):
            if last is not None and (at - pd.Timestamp(last)).total_seconds() > self.longest:
                found.append((key[0], pd.Timestamp(last), (at - pd.Timestamp(last)).total_seconds()))
            last = at
        self.last.update((last.to_pydatetime() if hasattr(last, "to_pydatetime") else last,))
        yield pd.DataFrame(found, columns=["stream", "since", "gap_seconds"])

    def close(self) -> None:
        pass


def stall_alerts(samples: DataFrame, longest: float = 3.0) -> DataFrame:
    """stream, since, gap_seconds of a streaming ``samples`` (stream, ts)."""
    return samples.groupBy("stream").transformWithStateInPandas(StallMonitor(longest), "stream long, since timestamp, gap_seconds double", "Append", "None")


class LiveChunks(StatefulProcessor):
    """Speech chunks of a stream's frames as they are completed; frames come in order of their number within a trigger and over triggers.

    A frame that is missing is silence, so the timeline never waits; one that comes after its place is taken is lost.
    """

    def __init__(self, pauses: Pauses = Pauses()) -> None:
        self.pauses = pauses

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("chunker", "noise double, run int, hold int, speech boolean, at long, silence int, spare int, start long, seq long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        machine, seq = Chunker(self.pauses), 0
        if self.state.exists():
            voice = machine.voice
            voice.noise, voice.run, voice.hold, voice.speech, machine.at, machine.silence, machine.spare, machine.start, seq = self.state.get()
        out = []
        frames = pd.concat(list(rows)).sort_values("frame")
        ends = False
        for frame, db, last in zip(frames["frame"], frames["db"], frames["last"], strict=True):
            found = []
            while machine.at < frame:
                found.append(machine.feed(-120.0))
            if machine.at == frame:
                found.append(machine.feed(float(db)))
            ends = ends or bool(last)
            for chunk in [*found, *([machine.end()] if last else [])]:
                if chunk:
                    out.append((*key, seq, *chunk, chunk[0] * FRAME_MS, chunk[1] * FRAME_MS))
                    seq += 1
        if ends:
            self.state.clear()
        else:
            voice = machine.voice
            self.state.update((voice.noise, voice.run, voice.hold, voice.speech, machine.at, machine.silence, machine.spare, machine.start, seq))
        yield pd.DataFrame(out, columns=[x.split()[0] for x in CHUNK.split(", ")])

    def close(self) -> None:
        pass


def live_chunks(frames: DataFrame, pauses: Pauses = Pauses()) -> DataFrame:
    """Chunks of a streaming ``frames`` (meeting_id, source, frame, db, last); ``last`` marks the end of a stream."""
    return frames.groupBy("meeting_id", "source").transformWithStateInPandas(LiveChunks(pauses), CHUNK, "Append", "None")


def read_stream(spark, path: str, schema: str | StructType, files_a_trigger: int = 100) -> DataFrame:
    """Rows of the JSON files that arrive below ``path``."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_trigger).json(path)


def write_journal(entries: DataFrame, path: str, checkpoint: str, interval: str | None = FLUSH):
    """Appends a stream of entries as JSON lines every ``interval``; without one, all there is, then ends."""
    writer = entries.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def degraded_union(*sources: DataFrame | None) -> DataFrame:
    """The streams that there are, as one; fails only if there is none."""
    found = [s for s in sources if s is not None]
    if not found:
        raise ValueError("no source to record from")
    out = found[0]
    for s in found[1:]:
        out = out.unionByName(s)
    return out
