"""WAV files: read as blocks of mono samples, written from blocks.

Files are read by Spark's ``binaryFile`` source, so by any path it knows. A file yields blocks of BLOCK_SAMPLES, so that an hour of audio is
many rows; a truncated file is read as far as it goes; what is no WAV file yields no block.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK_SAMPLES = 1 << 16
SCHEMA = "path string, sample_rate int, channels int, block long, start_sample long, samples array<float>"
PCM, FLOAT, EXTENSIBLE = 1, 3, 0xFFFE


def parse_head(data: bytes) -> dict:
    """rate, channels, bits, is_float and where the samples lie; raises ``ValueError`` for anything else than a WAV file."""
    if len(data) < 12 or data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, head = 12, {}
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        body = at + 8
        if name == b"fmt " and body + 16 <= len(data):
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", data, body)
            if kind == EXTENSIBLE and size >= 40 and body + 26 <= len(data):
                kind = struct.unpack_from("<H", data, body + 24)[0]
            if kind not in (PCM, FLOAT):
                raise ValueError(f"WAV encoding {kind} is not read")
            head = {"rate": rate, "channels": channels, "bits": bits, "is_float": kind == FLOAT}
        elif name == b"data" and head:
            return head | {"start": body, "stop": body + min(size, len(data) - body)}
        at = body + size + size % 2
    raise ValueError("no format or data in the WAV file")


def decode(raw: bytes, bits: int, is_float: bool) -> np.ndarray:
    """Samples of -1 to 1 from packed PCM."""
    if is_float:
        return np.frombuffer(raw, "<f8" if bits == 64 else "<f4").astype(np.float64)
    if bits == 8:
        return (np.frombuffer(raw, np.uint8).astype(np.float64) - 128) / 128
    if bits == 24:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        return ((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) >> 8) / float(1 << 23)
    return np.frombuffer(raw, {16: "<i2", 32: "<i4"}[bits]).astype(np.float64) / float(1 << (bits - 1))


def mono_blocks(data: bytes, block_samples: int = BLOCK_SAMPLES) -> Iterator[tuple[int, np.ndarray]]:
    """(first sample, samples) of each block of a file, channels averaged."""
    head = parse_head(data)
    frame = head["bits"] // 8 * head["channels"]
    frames = (head["stop"] - head["start"]) // frame
    for at in range(0, frames, block_samples):
        n = min(block_samples, frames - at)
        raw = data[head["start"] + at * frame : head["start"] + (at + n) * frame]
        yield at, decode(raw, head["bits"], head["is_float"]).reshape(n, head["channels"]).mean(axis=1).astype(np.float32)


def read_blocks(spark: SparkSession, path: str, block_samples: int = BLOCK_SAMPLES) -> DataFrame:
    """The blocks of every WAV file below ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.wav").load(path).select("path", "content")
    kind = pa.schema([("path", pa.string()), ("sample_rate", pa.int32()), ("channels", pa.int32()), ("block", pa.int64()), ("start_sample", pa.int64()), ("samples", pa.list_(pa.float32()))])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = content.as_py()
                try:
                    head = parse_head(data)
                except ValueError:
                    continue
                for i, (at, x) in enumerate(mono_blocks(data, block_samples)):
                    yield pa.RecordBatch.from_pydict({"path": [name], "sample_rate": [head["rate"]], "channels": [head["channels"]], "block": [i], "start_sample": [at], "samples": [x]}, kind)

    return files.mapInArrow(blocks, SCHEMA)


def durations(blocks: DataFrame) -> DataFrame:
    """path, duration_seconds."""
    return blocks.groupBy("path").agg((F.sum(F.size("samples")) / F.first("sample_rate")).alias("duration_seconds"))


def import_checks(files: DataFrame, extensions: tuple[str, ...] = (".wav", ".mp3", ".m4a", ".aac")) -> DataFrame:
    """path, refusal: why a listed file (path, exists, length, readable, decodable) can't be imported, the first reason only."""
    extension = F.lower(F.regexp_extract("path", r"(\.[^./\\]+)$", 1))
    reason = F.when(~F.col("exists"), "missing").when(~extension.isin(*extensions), "unsupported").when(F.col("length") == 0, "empty").when(~F.col("readable"), "unreadable").when(~F.col("decodable"), "undecodable")
    return files.select("path", reason.alias("refusal"))


def encode_wav(samples: np.ndarray, rate: int) -> bytes:
    """A 16-bit mono file: clamped to full scale, halves rounded to even."""
    body = np.rint(np.clip(samples, -1.0, 1.0) * 32767).astype("<i2").tobytes()
    return b"RIFF" + struct.pack("<I", 36 + len(body)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, PCM, 1, rate, rate * 2, 2, 16) + b"data" + struct.pack("<I", len(body)) + body


def write_wav(blocks: DataFrame, folder: str) -> DataFrame:
    """Writes a file for each ``path`` of ``blocks`` (path, block, sample_rate, samples) below ``folder``; returns path, n_samples.

    Each file is written under a name of its own and then moved, so a repeated task replaces it as a whole.
    """

    def write(frame: pd.DataFrame) -> pd.DataFrame:
        import uuid

        from pyarrow import fs

        frame = frame.sort_values("block")
        where, top = fs.FileSystem.from_uri(folder)
        where.create_dir(top, recursive=True)
        samples = np.concatenate([np.asarray(x, np.float64) for x in frame["samples"]])
        target = f"{top}/{frame['path'].iloc[0].rsplit('/', 1)[-1]}"
        part = f"{target}.{uuid.uuid4().hex}.part"
        with where.open_output_stream(part) as out:
            out.write(encode_wav(samples, int(frame["sample_rate"].iloc[0])))
        where.move(part, target)
        return pd.DataFrame({"path": [target], "n_samples": [len(samples)]})

    return blocks.groupBy("path").applyInPandas(write, "path string, n_samples long")
