"""From audio to recognised speech: frames, chunks at pauses, an injected recogniser, features and clusters of speakers.

Chunks and clusters depend on what came before in their stream, so the unit of work is a stream (meeting_id, source). Chunking runs on one
level for each 20 ms frame, not on samples, so an hour of a stream is 180,000 numbers.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .levels import VoiceDetector

RATE, FRAME = 16_000, 320
FRAME_MS = FRAME * 1000 // RATE


@dataclass(frozen=True)
class Pauses:
    """Lengths in frames of 20 ms."""

    pre_roll: int = 15
    flush: int = 40
    carried: int = 150
    least: int = 50
    target: int = 1000
    most: int = 1350
    overlap: int = 10


class Chunker:
    """Ranges of frames to recognise: speech with its pre-roll, carried on over pauses up to a target length."""

    def __init__(self, pauses: Pauses = Pauses()) -> None:
        self.p, self.voice = pauses, VoiceDetector()
        self.at = self.silence = self.spare = 0
        self.start: int | None = None

    def feed(self, db: float) -> tuple[int, int] | None:
        """The chunk that this frame completes, as (first frame, frame after the last)."""
        p, speech, frame = self.p, self.voice(db), self.at
        self.at += 1
        if speech:
            if self.start is None:
                self.start, self.spare = frame - self.spare, 0
            self.silence = 0
        elif self.start is not None:
            self.silence += 1
        else:
            self.spare = min(p.pre_roll, self.spare + 1)
            return None
        n = self.at - self.start
        paused = self.silence >= p.flush and n >= p.least and (n >= max(p.least, p.target) or self.silence >= p.carried)
        if paused or n >= p.most:
            return self._cut(keep=not paused)
        return None

    def placed(self, frame: int, db: float, idle: int) -> list[tuple[int, int]]:
        """The chunks completed by a frame that comes at its number: missing frames are silence, and after more than ``idle`` of them all begins anew."""
        found = []
        if frame - self.at > idle:
            found.append(self.end())
            self.restart(frame)
        while self.at < frame:
            found.append(self.feed(-120.0))
        if self.at == frame:
            found.append(self.feed(db))
        return [x for x in found if x]

    def restart(self, frame: int) -> None:
        self.voice, self.at, self.silence, self.spare, self.start = VoiceDetector(), frame, 0, 0, None

    def end(self) -> tuple[int, int] | None:
        """What is left when the stream ends, however short."""
        return self._cut(keep=False) if self.start is not None else None

    def _cut(self, keep: bool) -> tuple[int, int]:
        n = self.at - self.start
        stop = self.at - min(max(0, self.silence - self.p.flush), max(0, n - self.p.least))
        found = (self.start, stop)
        # a chunk cut for its length is followed by its own tail
        self.start = stop - self.p.overlap if keep and stop - found[0] > self.p.overlap > 0 else None
        self.silence = self.spare = 0
        return found


CHUNK = "meeting_id long, source string, seq long, first_frame long, end_frame long, start_ms long, end_ms long"


def frame_levels(blocks: DataFrame) -> DataFrame:
    """meeting_id, source, frame, db of 16 kHz blocks (meeting_id, source, block, start_sample, samples).

    Frames that lie in two blocks are put together by their number: each block gives its part of a frame's energy.
    """

    def energies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples():
                x = np.asarray(row.samples, np.float64)
                if len(x):
                    first = row.start_sample // FRAME
                    at = np.r_[0, np.arange((first + 1) * FRAME - row.start_sample, len(x), FRAME)]
                    out.append(pd.DataFrame({"meeting_id": row.meeting_id, "source": row.source, "frame": first + np.arange(len(at)), "energy": np.add.reduceat(x * x, at), "n": np.diff(np.r_[at, len(x)])}))
            yield pd.concat(out) if out else pd.DataFrame({c: [] for c in ("meeting_id", "source", "frame", "energy", "n")})

    rows = blocks.select("meeting_id", "source", "start_sample", "samples").mapInPandas(energies, "meeting_id long, source string, frame long, energy double, n long")
    parts = rows.groupBy("meeting_id", "source", "frame").agg(F.sum("energy").alias("energy"), F.sum("n").alias("n"))
    level = F.sqrt(F.col("energy") / F.col("n"))
    return parts.where(F.col("n") == FRAME).select("meeting_id", "source", "frame", F.when(level <= 1e-12, F.lit(-120.0)).otherwise(20 * F.log10(level)).alias("db"))


def speech_chunks(frames: DataFrame, pauses: Pauses = Pauses(), idle: int | None = None) -> DataFrame:
    """The chunks of each stream of ``frames`` (meeting_id, source, frame, db).

    Frames follow one another whatever their numbers; with ``idle``, a missing frame is silence, and a stream without frames for longer has ended and begins anew.
    """

    def chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stream, machine, seq, out = None, Chunker(pauses), 0, []

        def put(found: tuple[int, int] | None) -> None:
            nonlocal seq
            if found:
                out.append((*stream, seq, *found, found[0] * FRAME_MS, found[1] * FRAME_MS))
                seq += 1

        for batch in batches:
            for meeting, source, frame, db in zip(batch["meeting_id"], batch["source"], batch["frame"], batch["db"], strict=True):
                if (meeting, source) != stream:
                    put(machine.end())
                    stream, machine, seq = (meeting, source), Chunker(pauses), 0
                for found in [machine.feed(db)] if idle is None else machine.placed(frame, db, idle):
                    put(found)
            yield pd.DataFrame(out, columns=[x.split()[0] for x in CHUNK.split(", ")])
            out.clear()
        put(machine.end())
        yield pd.DataFrame(out, columns=[x.split()[0] for x in CHUNK.split(", ")])

    rows = frames.select("meeting_id", "source", "frame", "db").repartition("meeting_id", "source").sortWithinPartitions("meeting_id", "source", "frame")
    return rows.mapInPandas(chunks, CHUNK)


def run_totals(chunks: DataFrame, window_seconds: int = 30) -> DataFrame:
    """meeting_id, source, n_chunks, submitted_seconds, encoder_seconds; words repeated at a seam are submitted twice."""
    seconds = F.sum(F.col("end_ms") - F.col("start_ms")) / 1000
    return chunks.groupBy("meeting_id", "source").agg(F.count("*").alias("n_chunks"), seconds.alias("submitted_seconds"), (F.count("*") * window_seconds).alias("encoder_seconds"))


Recogniser = Callable[[np.ndarray, int], list[tuple[int, int, str, float]]]


def recognised(chunks: DataFrame, make: Callable[[], Recogniser], least_samples: int = RATE) -> DataFrame:
    """Segments of ``chunks`` (meeting_id, source, seq, start_ms, samples) by a recogniser that ``make`` loads once in each task.

    A recogniser takes samples (padded to ``least_samples``) and the chunk's number and returns (start_ms, end_ms, text, confidence); blank texts are left out and
    times are put on the meeting's clock.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        recogniser = make()
        for batch in batches:
            out = []
            for row in batch.itertuples():
                x = np.asarray(row.samples, np.float32)
                for start, end, text, confidence in recogniser(np.pad(x, (0, max(0, least_samples - len(x)))), row.seq):
                    if text.strip():
                        out.append((row.meeting_id, row.source, row.seq, row.start_ms + start, row.start_ms + end, text.strip(), confidence))
            yield pd.DataFrame(out, columns=["meeting_id", "source", "seq", "start_ms", "end_ms", "text", "confidence"])

    return chunks.select("meeting_id", "source", "seq", "start_ms", "samples").mapInPandas(run, "meeting_id long, source string, seq long, start_ms long, end_ms long, text string, confidence double")


def spoken(spans: DataFrame, most_no_speech: float = 0.85) -> DataFrame:
    """Spans without those that the recogniser takes for no speech."""
    return spans.where(F.col("no_speech_prob") <= most_no_speech)


def mel_bank(rate: int = RATE, size: int = 512, filters: int = 26, low: float = 80.0, high: float = 8000.0) -> np.ndarray:
    """Triangles evenly spaced in mel, as filters x bins."""
    mel = lambda hz: 2595 * np.log10(1 + hz / 700)
    edges = 700 * (10 ** (np.linspace(mel(low), mel(min(high, rate / 2)), filters + 2) / 2595) - 1) * size / rate
    bins = np.arange(size // 2 + 1)
    up = (bins - edges[:-2, None]) / (edges[1:-1] - edges[:-2])[:, None]
    down = (edges[2:, None] - bins) / (edges[2:] - edges[1:-1])[:, None]
    return np.clip(np.minimum(up, down), 0, None)


def cepstra(samples: np.ndarray, rate: int = RATE, coefficients: int = 13, filters: int = 26) -> np.ndarray:
    """Mel cepstra of 25 ms frames every 10 ms, as frames x coefficients."""
    size, hop = rate * 25 // 1000, rate // 100
    if len(samples) < size:
        return np.zeros((0, coefficients))
    fft = 1 << (size - 1).bit_length()
    frames = np.lib.stride_tricks.sliding_window_view(np.asarray(samples, np.float64), size)[::hop] * np.hamming(size)
    power = np.abs(np.fft.rfft(frames, fft)) ** 2 / fft
    energies = np.log(np.maximum(power @ mel_bank(rate, fft, filters).T, 1e-10))
    cosines = np.cos(np.pi * np.arange(coefficients)[:, None] * (2 * np.arange(filters) + 1) / (2 * filters))
    return energies @ cosines.T


def cepstra_rows(blocks: DataFrame, rate: int = RATE) -> DataFrame:
    """stream, block, frame, coefficient, value: the cepstra of each block (stream, block, samples) by itself."""
    kind = dict(blocks.dtypes)["stream"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for stream, block, samples in zip(batch["stream"], batch["block"], batch["samples"], strict=True):
                c = cepstra(np.asarray(samples, np.float64), rate)
                frame, coefficient = np.indices(c.shape)
                yield pd.DataFrame({"stream": stream, "block": block, "frame": frame.reshape(-1), "coefficient": coefficient.reshape(-1), "value": c.reshape(-1)})

    return blocks.select("stream", "block", "samples").mapInPandas(run, f"stream {kind}, block long, frame long, coefficient long, value double")


def voice_print(samples: np.ndarray) -> np.ndarray | None:
    """Unit vector of the means and deviations of the cepstra but for loudness; None if there is too little or too quiet sound."""
    if len(samples) < 0.6 * RATE or math.sqrt(float(np.mean(np.square(samples, dtype=np.float64)))) < 10 ** (-55 / 20):
        return None
    c = cepstra(samples)[:, 1:]
    if len(c) < 5:
        return None
    v = np.r_[c.mean(axis=0), c.std(axis=0)]
    norm = np.linalg.norm(v)
    return v / norm if norm >= 1e-9 else v


class SpeakerClusters:
    """Clusters found one after another: the nearest centroid absorbs a print that is like it, else a new cluster begins."""

    def __init__(self, similarity: float = 0.82, most: int = 8) -> None:
        self.similarity, self.most = similarity, most
        self.centroids: list[np.ndarray] = []
        self.counts: list[int] = []

    def __call__(self, print_: np.ndarray) -> int:
        near = [float(c @ print_) for c in self.centroids]
        best = int(np.argmax(near)) if near else -1
        if best < 0 or (near[best] < self.similarity and len(near) < self.most):
            self.centroids.append(print_.copy())
            self.counts.append(1)
            return len(self.counts) - 1
        self.counts[best] += 1
        c = self.centroids[best] + (print_ - self.centroids[best]) / self.counts[best]
        norm = np.linalg.norm(c)
        self.centroids[best] = c / norm if norm >= 1e-9 else c
        return best


def speaker_clusters(prints: DataFrame, similarity: float = 0.82, most: int = 8) -> DataFrame:
    """stream, seq, cluster for ``prints`` (stream, seq, vector); a null vector has no cluster. A stream's vectors go in order of seq."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, clusters, begun = None, SpeakerClusters(similarity, most), False
        for batch in batches:
            out = []
            for name, vector in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if not begun or name != stream:
                    stream, clusters, begun = name, SpeakerClusters(similarity, most), True
                v = None if vector is None else np.asarray(vector, np.float64)
                out.append(None if v is None else clusters(v / (np.linalg.norm(v) if np.linalg.norm(v) >= 1e-9 else 1.0)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.int64())], ["stream", "seq", "cluster"])

    rows = prints.select(F.col("stream").cast("long"), F.col("seq").cast("long"), F.col("vector").cast("array<double>")).repartition("stream").sortWithinPartitions("stream", "seq")
    return rows.mapInArrow(assign, "stream long, seq long, cluster long")
