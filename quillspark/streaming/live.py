"""Streams whose state ends by the clock: stalls, speech chunks of a source that just stops, a timeline without gaps, drift, and the state of a recording.

``clock`` names the time that timers go by. ``EventTime`` follows the watermark of ``ts``: a silent stream is noticed while others deliver, or when a row
without sound (a heartbeat: null ``tick``, ``frame`` or ``seen``) moves the watermark; a run over the same rows gives the same result. ``ProcessingTime`` follows the
wall clock, so it notices that nothing at all arrives, with a result that depends on when rows came.
"""

from __future__ import annotations

import threading
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener

from quillspark.operators.levels import DriftControl
from quillspark.operators.speech import CHUNK, FRAME_MS, RATE, Chunker, Pauses

JITTER = "250 milliseconds"
TICK_MS, PASS_TICKS = 20, 50


def _ms(at) -> int:
    return int(pd.Timestamp(at).value // 1_000_000)


def _heard(rows: DataFrame, column: str) -> DataFrame:
    """``rows`` with a watermark, without the heartbeats: they have moved it, and all of them would be one key of one task.

    The second condition never holds; naming ``ts`` keeps the filter behind the watermark, where an optimiser would move one on other columns before it.
    """
    return rows.where(F.col(column).isNotNull() | (F.col("ts") < F.lit("0001-01-01").cast("timestamp")))


def _came(rows: Iterator[pd.DataFrame], column: str) -> pd.DataFrame:
    """The rows of all batches but heartbeats, which are dropped batch by batch."""
    return pd.concat([batch.dropna(subset=[column]) for batch in rows])


class _Timed(StatefulProcessor):
    """One timer for each key."""

    def __init__(self, clock: str) -> None:
        if clock not in ("EventTime", "ProcessingTime"):
            raise ValueError(f"no such clock: {clock}")
        self.clock = clock

    def rearm(self, timers, last_ms: int, wait_ms: int) -> None:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        self.handle.registerTimer((last_ms if self.clock == "EventTime" else timers.getCurrentProcessingTimeInMs()) + wait_ms)

    def close(self) -> None:
        pass


class StallMonitor(_Timed):
    """Tells once that a stream has been silent for ``longest`` seconds, and when it is heard again."""

    def __init__(self, longest: float, clock: str) -> None:
        super().__init__(clock)
        self.longest = longest

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("last", "at long, told boolean")

    def _rows(self, key, found: list) -> pd.DataFrame:
        return pd.DataFrame([(*key, kind, pd.Timestamp(since * 1_000_000), gap) for kind, since, gap in found], columns=["stream", "event", "since", "gap_seconds"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, told = self.state.get() if self.state.exists() else (None, False)
        found = []
        for at in sorted(_ms(t) for batch in rows for t, seen in zip(batch["ts"], batch["seen"], strict=True) if seen):
            if last is not None and at - last > self.longest * 1000:
                found += [*([] if told else [("stalled", last, self.longest)]), ("resumed", last, (at - last) / 1000)]
            last, told = max(at, at if last is None else last), False
        if last is not None:
            self.state.update((last, told))
            if not told:
                self.rearm(timerValues, last, int(self.longest * 1000) + 1)
        yield self._rows(key, found)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last, told = self.state.get()
        self.state.update((last, True))
        yield self._rows(key, [] if told else [("stalled", last, self.longest)])


STALL = "stream long, event string, since timestamp, gap_seconds double"


def stall_events(samples: DataFrame, longest: float = 3.0, delay: str = JITTER, clock: str = "EventTime") -> DataFrame:
    """stream, event, since, gap_seconds of ``samples`` (stream, ts, and ``seen``, false for heartbeats, if there are any).

    ``stalled`` comes once a stream has been silent for more than ``longest`` seconds, without waiting for it to return; ``resumed`` when it does,
    with the whole gap. A batch gives what a stream by event time gives; its clock ends at the newest row less ``delay``.
    """
    rows = samples.select("stream", "ts", (F.col("seen") if "seen" in samples.columns else F.lit(True)).alias("seen"))
    if rows.isStreaming:
        return rows.withWatermark("ts", delay).groupBy("stream").transformWithStateInPandas(StallMonitor(longest, clock), STALL, "Append", clock)
    end = F.lit(rows.agg((F.max("ts") - F.expr(f"interval {delay}")).alias("end")).first()["end"]).cast("timestamp")
    seconds = lambda a, b: (F.unix_millis(a) - F.unix_millis(b)) / 1000
    gaps = rows.where("seen").withColumn("back", F.lead("ts").over(Window.partitionBy("stream").orderBy("ts")))
    gaps = gaps.withColumn("gap", seconds(F.coalesce("back", end), F.col("ts"))).where(F.col("gap") > longest)
    event = lambda name, gap: F.struct(F.lit(name).alias("event"), F.col("ts").alias("since"), gap.alias("gap_seconds"))
    both = F.when(F.col("back").isNull(), F.array(event("stalled", F.lit(longest)))).otherwise(F.array(event("stalled", F.lit(longest)), event("resumed", F.col("gap"))))
    return gaps.select("stream", F.inline(both))


class IdleChunks(_Timed):
    """Speech chunks of a stream's frames; a stream that is silent for ``idle`` frames has ended, with what it has open as its last chunk."""

    def __init__(self, pauses: Pauses, idle: int, clock: str) -> None:
        super().__init__(clock)
        self.pauses, self.idle = pauses, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("chunker", "noise double, run int, hold int, speech boolean, at long, silence int, spare int, start long, seq long")

    def _machine(self) -> tuple[Chunker, int]:
        machine = Chunker(self.pauses)
        if not self.state.exists():
            return machine, 0
        voice = machine.voice
        voice.noise, voice.run, voice.hold, voice.speech, machine.at, machine.silence, machine.spare, machine.start, seq = self.state.get()
        return machine, seq

    def _done(self, key, machine: Chunker, seq: int, found: list) -> pd.DataFrame:
        chunks = [(*key, seq + i, *c, c[0] * FRAME_MS, c[1] * FRAME_MS) for i, c in enumerate(found)]
        voice = machine.voice
        self.state.update((voice.noise, voice.run, voice.hold, voice.speech, machine.at, machine.silence, machine.spare, machine.start, seq + len(found)))
        return pd.DataFrame(chunks, columns=[x.split()[0] for x in CHUNK.split(", ")])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        machine, seq = self._machine()
        frames = _came(rows, "frame").sort_values("frame")
        found = [c for frame, db in zip(frames["frame"], frames["db"], strict=True) for c in machine.placed(int(frame), float(db), self.idle)]
        if len(frames):
            self.rearm(timerValues, _ms(frames["ts"].iloc[-1]), self.idle * FRAME_MS + 1)
        yield self._done(key, machine, seq, found)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        machine, seq = self._machine()
        last = machine.end()
        machine.restart(machine.at)
        yield self._done(key, machine, seq, [last] if last else [])


def idle_chunks(frames: DataFrame, pauses: Pauses = Pauses(), idle: int = 150, delay: str = JITTER, clock: str = "EventTime") -> DataFrame:
    """Chunks of a streaming ``frames`` (meeting_id, source, frame, db, ts), as ``speech.speech_chunks(frames, pauses, idle)`` gives them for a batch."""
    rows = frames.select("meeting_id", "source", "frame", "db", "ts").withWatermark("ts", delay)
    return _heard(rows, "frame").groupBy("meeting_id", "source").transformWithStateInPandas(IdleChunks(pauses, idle, clock), CHUNK, "Append", clock)


class Timeline(StatefulProcessor):
    """Puts out a stream's ticks in order up to the watermark; where none came, silence."""

    def __init__(self, tick_ms: int) -> None:
        self.tick_ms = tick_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.next = handle.getValueState("next", "tick long")
        self.held = handle.getMapState("held", "tick long", "value double")

    def _passed(self, key, at: int, held: dict[int, float], clock_ms: int) -> Iterator[pd.DataFrame]:
        """The ticks from ``at`` to the last one held that ``clock_ms`` has passed, PASS_TICKS at most in each frame: what follows the last is no gap until something comes after it."""
        end = min(clock_ms // self.tick_ms, max(held, default=at - 1) + 1)
        while at < end:
            ticks = range(at, min(end, at + PASS_TICKS))
            yield pd.DataFrame([(*key, t, held.get(t, 0.0), t not in held) for t in ticks], columns=["stream", "tick", "value", "inserted"])
            at = ticks.stop
        self.next.update((at,))
        gone = [t for t in held if t < at]
        if len(gone) == len(held):
            self.held.clear()
        else:
            for t in gone:
                self.held.removeKey((t,))
            # called again once the clock has passed the last one
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer((max(held) + 1) * self.tick_ms)

    def _held(self) -> dict[int, float]:
        return {k[0]: v[0] for k, v in self.held.iterator()}

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        came = _came(rows, "tick")
        if not len(came):
            return
        first = self.next.get()[0] if self.next.exists() else int(came["tick"].min())
        held, sums = self._held(), came.groupby("tick")["value"].sum()
        for tick, value in sums[sums.index >= first].items():
            held[int(tick)] = held.get(int(tick), 0.0) + float(value)
            self.held.updateValue((int(tick),), (held[int(tick)],))
        yield from self._passed(key, first, held, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._passed(key, self.next.get()[0], self._held(), expiredTimerInfo.getExpiryTimeInMs())

    def close(self) -> None:
        pass


def live_timeline(ticks: DataFrame, tick_ms: int = TICK_MS, delay: str = JITTER) -> DataFrame:
    """stream, tick, value, inserted of a streaming ``ticks`` (stream, tick, value, ts): one row for each tick from a stream's first on, without waiting.

    A tick is put out once the watermark has passed its end. One that hasn't come by then is 0 and ``inserted``; should it come later, it is lost. Values of one tick
    are added up. A heartbeat (null ``tick``) moves the watermark, and so the end of a stream out of its buffer. ``ts`` lies in the tick; ticks count from the epoch.
    """
    rows = ticks.select("stream", "tick", "value", "ts").withWatermark("ts", delay)
    return _heard(rows, "tick").groupBy("stream").transformWithStateInPandas(Timeline(tick_ms), "stream long, tick long, value double, inserted boolean", "Append", "EventTime")


class LiveDrift(StatefulProcessor):
    """Drops a stream's oldest samples while its smoothed backlog stays too high."""

    def __init__(self, rate: int, tick_seconds: float) -> None:
        self.rate, self.tick_seconds = rate, tick_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("drift", "smooth double, lasted double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        control = DriftControl(self.rate, self.tick_seconds)
        if self.state.exists():
            control.smooth, control.lasted = self.state.get()
        out = []
        for r in pd.concat(list(rows)).sort_values("seq").itertuples():
            dropped = control(int(r.backlog), int(r.inserted))
            out.append((*key, r.seq, dropped, list(r.samples)[dropped:]))
        self.state.update((control.smooth, control.lasted))
        yield pd.DataFrame(out, columns=["stream", "seq", "dropped", "samples"])

    def close(self) -> None:
        pass


def without_drift(blocks: DataFrame, rate: int, tick_seconds: float) -> DataFrame:
    """stream, seq, dropped, samples: a streaming ``blocks`` (stream, seq, backlog, inserted, samples) without the samples that drift correction drops.

    ``dropped`` is what ``levels.drift_corrections`` gives for a batch; rows come in order of ``seq`` within a trigger and over triggers.
    """
    schema = "stream long, seq long, dropped long, samples array<float>"
    return blocks.select("stream", "seq", "backlog", "inserted", "samples").groupBy("stream").transformWithStateInPandas(LiveDrift(rate, tick_seconds), schema, "Append", "None")


@dataclass(frozen=True)
class Status:
    """What a recording has come to: lengths in ms, bytes of 16-bit samples."""

    elapsed_ms: float = 0.0
    inserted_ms: float = 0.0
    corrected_ms: float = 0.0
    overruns: int = 0
    bytes_written: int = 0


class RecordingStatus(StreamingQueryListener):
    """The status of a running recording, from what ``observed`` counts in each trigger. Add it with ``spark.streams.addListener``."""

    def __init__(self, name: str, rate: int = RATE) -> None:
        self.name, self.rate = name, rate
        self._sums = {"written": 0, "inserted": 0, "dropped": 0, "overruns": 0}
        self._seen: dict[str, int] = {}
        self._lock = threading.Lock()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        row, run = event.progress.observedMetrics.get(self.name), str(event.progress.runId)
        with self._lock:
            if row is None or self._seen.get(run, -1) >= event.progress.batchId:
                return
            self._seen[run] = event.progress.batchId
            for name in self._sums:
                self._sums[name] += row[name] or 0

    def onQueryTerminated(self, event) -> None:
        pass

    def snapshot(self) -> Status:
        with self._lock:
            s = dict(self._sums)
        ms = lambda samples: samples * 1000.0 / self.rate
        return Status(ms(s["written"]), ms(s["inserted"]), ms(s["dropped"]), s["overruns"], 2 * s["written"])


def observed(blocks: DataFrame, name: str) -> DataFrame:
    """``blocks`` (samples, inserted, dropped, overruns: counts of samples), counted for ``RecordingStatus``."""
    counts = [F.coalesce(F.sum(F.size("samples")), F.lit(0)).alias("written"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("inserted", "dropped", "overruns")]]
    return blocks.observe(name, *counts)
