"""WAV files as a Spark data source: read by ranges of bytes, written file by file and put in place when the whole job commits.

Reading plans tasks from the files' sizes alone: a long file is split into ranges, short ones share a task, and a task reads the chunks' heads and then only the blocks that begin in
its range, HELD bytes at a time. A task opens some FILES files at most, and there are no more than some TASKS tasks while they are shorter than SPLIT_BYTES. Columns that the schema leaves out are not decoded. Writing goes to a staging folder inside the target: each task streams
its blocks behind an unfinished head, which it mends at the end of the file; the driver moves the files when all tasks are done. A task that fails or runs twice, and a
job that is killed, leave what was there before; what they staged is never read and goes with the next commit or abort of that job.

Paths are those that pyarrow's file systems open on every executor (local or mounted, hdfs, s3, gs). For any other path Spark knows there is ``wav.read_blocks``.
"""

from __future__ import annotations

import struct
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .wav import BLOCK_SAMPLES, EXTENSIBLE, FLOAT, PCM, SCHEMA, decode

SPLIT_BYTES = 64 << 20
FILES, TASKS, HELD = 512, 1024, 1 << 20
STAGING = ".staging-"
LONGEST = (1 << 32) - 1 - 80
NOT_READ = 0xFFFFFFFF


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def head_of(file, length: int) -> dict:
    """rate, channels, bits, is_float, start and stop of an open file's samples, from the heads of its chunks only; raises ``ValueError`` for no WAV file."""
    first = file.read(12)
    if len(first) < 12 or first[:4] not in (b"RIFF", b"RF64") or first[8:] != b"WAVE":
        raise ValueError("not a WAV file")
    at, head, large = 12, {}, None
    while at + 8 <= length:
        file.seek(at)
        name, size = struct.unpack("<4sI", file.read(8))
        if name == b"ds64" and size >= 16:
            large = struct.unpack("<QQ", file.read(16))[1]
        elif name == b"fmt " and size >= 16:
            body = file.read(min(size, 40))
            if len(body) < 16:
                break
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", body)
            kind = struct.unpack_from("<H", body, 24)[0] if kind == EXTENSIBLE and len(body) >= 26 else kind
            if kind not in (PCM, FLOAT) or not channels or bits not in ((32, 64) if kind == FLOAT else (8, 16, 24, 32)):
                raise ValueError(f"WAV encoding {kind} of {channels} channels and {bits} bits is not read")
            head = {"rate": rate, "channels": channels, "bits": bits, "is_float": kind == FLOAT}
        elif name == b"data" and head:
            size = large if size == NOT_READ and large is not None else size
            return head | {"start": at + 8, "stop": min(at + 8 + size, length)}
        at += 8 + size + size % 2
    raise ValueError("no format or data in the WAV file")


@dataclass
class Range:
    """The bytes of a file from ``first`` up to ``end``."""

    path: str
    length: int
    first: int
    end: int


@dataclass
class Ranges(InputPartition):
    """What one task reads: a range of a long file, or several short files."""

    ranges: list[Range]


class WavReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict) -> None:
        self.schema, self.path = schema, options["path"]
        self.block, self.split = int(options.get("blocksamples", BLOCK_SAMPLES)), int(options.get("splitbytes", SPLIT_BYTES))

    def partitions(self) -> list[Ranges]:
        where, top = opened(self.path)
        info = where.get_file_info(top)
        files = [info] if info.is_file else where.get_file_info(fs.FileSelector(top, recursive=True))
        wavs = sorted((f.path, f.size) for f in files if f.is_file and f.path.lower().endswith(".wav") and STAGING not in f.path)
        split = max(self.split, min(SPLIT_BYTES, sum(size for _, size in wavs) // TASKS))
        tasks, room = [Ranges([])], split
        for path, size in wavs:
            for at in range(0, size, split):
                some = Range(path, size, at, min(size, at + split))
                if some.end - at > room and tasks[-1].ranges:
                    tasks.append(Ranges([]))
                    room = split
                tasks[-1].ranges.append(some)
                # opening a file costs too
                room -= some.end - at + split // FILES
        return tasks

    def read(self, task: Ranges) -> Iterator[pa.RecordBatch]:
        kind, where = to_arrow_schema(self.schema), opened(self.path)[0]
        rows, held = [], 0
        put = lambda: pa.RecordBatch.from_pydict({c: [row[c] for row in rows] for c in kind.names}, kind)
        for part in task.ranges:
            for row in self._blocks(where, part, "samples" in kind.names):
                rows.append(row)
                held += 256 + (row["samples"].nbytes if "samples" in row else 0)
                if held >= HELD:
                    yield put()
                    rows, held = [], 0
        if rows:
            yield put()

    def _blocks(self, where: fs.FileSystem, part: Range, with_samples: bool) -> Iterator[dict]:
        with where.open_input_file(part.path) as file:
            try:
                head = head_of(file, part.length)
            except ValueError:
                return
            width = head["bits"] // 8 * head["channels"]
            frames, step = (head["stop"] - head["start"]) // width, self.block * width
            due = lambda byte: max(0, -(-(byte - head["start"]) // step))  # noqa: E731  blocks that begin before a byte
            for i in range(due(part.first), min(due(part.end), -(-frames // self.block))):
                at = i * self.block
                row = {"path": part.path, "sample_rate": head["rate"], "channels": head["channels"], "block": i, "start_sample": at}
                if with_samples:
                    n = min(self.block, frames - at)
                    file.seek(head["start"] + at * width)
                    row["samples"] = decode(file.read(n * width), head["bits"], head["is_float"]).reshape(n, head["channels"]).mean(axis=1).astype(np.float32)
                yield row


@dataclass
class Staged(WriterCommitMessage):
    files: list[tuple[str, str]]


class WavWriter(DataSourceArrowWriter):
    """Mono files of 16 bits, one for each ``path``, whose blocks come one after another."""

    def __init__(self, options: dict, overwrite: bool) -> None:
        self.path, self.overwrite, self.staging = options["path"], overwrite, STAGING + uuid.uuid4().hex

    def write(self, batches: Iterator[pa.RecordBatch]) -> Staged:
        where, top = opened(self.path)
        where.create_dir(f"{top}/{self.staging}", recursive=True)
        name, out, done, count, rate, staged = None, None, [], 0, 0, ""

        def close() -> None:
            if out is not None:
                out.close()
                finished(where, staged, count, rate)
                done.append((staged, f"{top}/{name}"))

        for batch in batches:
            samples = batch.column("samples")
            for i, (path, its_rate) in enumerate(zip(batch.column("path").to_pylist(), batch.column("sample_rate").to_pylist(), strict=True)):
                if path != name or out is None:
                    close()
                    name, count, rate, staged = path, 0, its_rate, f"{top}/{self.staging}/{uuid.uuid4().hex}"
                    out = where.open_output_stream(staged)
                    out.write(wav_head(0, rate))
                x = samples[i].values.to_numpy(zero_copy_only=False).astype(np.float64)
                body = np.rint(np.clip(x, -1.0, 1.0) * 32767).astype("<i2").tobytes()
                out.write(body)
                count += len(body)
        close()
        return Staged(done)

    def commit(self, messages: list[Staged | None]) -> None:
        where, top = opened(self.path)
        moves = [m for message in messages if message for m in message.files]
        targets = [final for _, final in moves]
        twice = {t for t, n in Counter(targets).items() if n > 1}
        there = [] if self.overwrite else [t for t in targets if where.get_file_info(t).type != fs.FileType.NotFound]
        if twice or there:
            self.abort(messages)
            raise ValueError(f"files that two tasks wrote: {sorted(twice)[:5]}, files that exist: {there[:5]}")
        for folder in {final.rsplit("/", 1)[0] for final in targets}:
            where.create_dir(folder, recursive=True)
        for staged, final in moves:
            where.move(staged, final)
        where.delete_dir(f"{top}/{self.staging}")

    def abort(self, messages: list[Staged | None]) -> None:
        where, top = opened(self.path)
        if where.get_file_info(f"{top}/{self.staging}").type == fs.FileType.Directory:
            where.delete_dir(f"{top}/{self.staging}")


def wav_head(size: int, rate: int) -> bytes:
    """The head of a mono file of 16 bits and ``size`` bytes of samples; beyond 32 bits that of an RF64 file."""
    form = b"fmt " + struct.pack("<IHHIIHH", 16, PCM, 1, rate, rate * 2, 2, 16) + b"data"
    if size <= LONGEST:
        return b"RIFF" + struct.pack("<I", 36 + size) + b"WAVE" + form + struct.pack("<I", size)
    return b"RF64" + struct.pack("<I", NOT_READ) + b"WAVEds64" + struct.pack("<IQQQI", 28, 72 + size, size, size // 2, 0) + form + struct.pack("<I", NOT_READ)


def finished(where: fs.FileSystem, path: str, size: int, rate: int) -> None:
    """Puts the right head before the ``size`` bytes of samples of a staged file: in place where the file system can, else by a copy."""
    head, old = wav_head(size, rate), len(wav_head(0, rate))
    if isinstance(where, fs.LocalFileSystem) and len(head) == old:
        with open(path, "r+b") as file:
            file.write(head)
        return
    with where.open_input_stream(path) as source, where.open_output_stream(f"{path}.whole") as out:
        source.read(old)
        out.write(head)
        while piece := source.read(1 << 20):
            out.write(piece)
    where.move(f"{path}.whole", path)


class WavSource(DataSource):
    """``spark.read.format("wav")``: options path, blockSamples, splitBytes. ``df.write.format("wav")`` takes path (relative), block, sample_rate, samples."""

    @classmethod
    def name(cls) -> str:
        return "wav"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WavReader:
        return WavReader(schema, {k.lower(): v for k, v in self.options.items()})

    def writer(self, schema: StructType, overwrite: bool) -> WavWriter:
        return WavWriter({k.lower(): v for k, v in self.options.items()}, overwrite)


def read_wav(spark: SparkSession, path: str, schema: str = SCHEMA, block_samples: int = BLOCK_SAMPLES, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """The blocks of the WAV files below ``path``, each file by as many tasks as it has ranges of ``split_bytes``; only the columns of ``schema``."""
    spark.dataSource.register(WavSource)
    return spark.read.format("wav").schema(schema).option("blockSamples", block_samples).option("splitBytes", split_bytes).load(path)


def save_wav(blocks: DataFrame, folder: str, overwrite: bool = True) -> None:
    """Writes ``blocks`` (path, block, sample_rate, samples), each path as a file below ``folder``; all of them or none.

    A file is the work of one task, which holds one batch of blocks at a time.
    """
    blocks.sparkSession.dataSource.register(WavSource)
    rows = blocks.select("path", "block", "sample_rate", "samples").repartition("path").sortWithinPartitions("path", "block")
    rows.write.format("wav").mode("overwrite" if overwrite else "append").save(folder)
