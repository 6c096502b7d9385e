"""Balance of a stream's frequency bands over its frames that are not silent.

The bands' filters run in parallel over the blocks; each block gives for each 20 ms frame that it touches the energy of the samples and of each band, and Spark adds the
parts of a frame up, leaves out the silent ones and sums the rest. So what is held is a block, however long the stream.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .filters import ACTIVE_DB, FRAME_MS, bands_at
from .recurrence import Bank, alike, flat, states

LEAST_SECONDS = 0.5


def frame_energies(blocks: DataFrame, rate: int) -> DataFrame:
    """stream, frame, n, energy, bands (one energy for each of ``bands_at``) of ``blocks`` (stream, block, start_sample, samples); every frame moves the filters."""
    bank, size = Bank(list(bands_at(rate).values())), max(1, rate * FRAME_MS // 1000)
    kind = dict(blocks.dtypes)["stream"]

    def energies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            samples, lengths = flat(batch.column("samples"))
            starts, before = np.cumsum(lengths) - lengths, batch.column("start_sample").to_numpy()
            for rows, n, _ in alike(lengths, [0] * len(lengths)):
                if not n:
                    continue
                x = samples[starts[rows][:, None] + np.arange(n)]
                state = flat(batch.column("state").take(pa.array(rows)))[0].reshape(len(rows), bank.size)
                # the rows one after another: a frame begins with each row and wherever a multiple of ``size`` is passed
                at = before[rows][:, None] + np.arange(n)
                frame = at // size
                begins = np.flatnonzero(np.c_[np.ones(len(rows), bool), frame[:, 1:] != frame[:, :-1]].ravel())
                sums = [np.add.reduceat((y * y).ravel(), begins) for y in (x, *bank.run(x, state)[0])]
                bands = pa.ListArray.from_arrays(pa.array(np.arange(len(begins) + 1) * (len(sums) - 1), pa.int32()), pa.array(np.stack(sums[1:], axis=1).ravel()))
                made = [pa.array(frame.ravel()[begins], pa.int64()), pa.array(np.diff(np.r_[begins, x.size]), pa.int64()), pa.array(sums[0]), bands]
                yield pa.RecordBatch.from_arrays([batch.column("stream").take(pa.array(rows[begins // n])), *made], ["stream", "frame", "n", "energy", "bands"])

    joined = blocks.select("stream", "block", F.col("start_sample").cast("long").alias("start_sample"), F.col("samples").cast("array<double>").alias("samples")).join(states(blocks, bank), ["stream", "block"])
    rows = joined.mapInArrow(energies, f"stream {kind}, frame long, n long, energy double, bands array<double>")
    bands = F.array(*[F.sum(F.element_at("bands", i + 1)) for i in range(len(bank.chains))])
    return rows.groupBy("stream", "frame").agg(F.sum("n").alias("n"), F.sum("energy").alias("energy"), bands.alias("bands"))


def spectral_balance(blocks: DataFrame, rate: int) -> DataFrame:
    """stream, band, rms, relative_db of ``blocks`` (stream, block, start_sample, samples): to the first band, and silence where too little was heard to say."""
    names = list(bands_at(rate))
    loud = F.sqrt(F.col("energy") / F.col("n")) >= 10 ** (ACTIVE_DB / 20)
    sums = frame_energies(blocks, rate).groupBy("stream").agg(F.coalesce(F.sum(F.when(loud, F.col("n"))), F.lit(0)).alias("n"), *[F.coalesce(F.sum(F.when(loud, F.element_at("bands", i + 1))), F.lit(0.0)).alias(f"e{i}") for i in range(len(names))])
    rms = lambda i: F.when(F.col("n") > 0, F.sqrt(F.col(f"e{i}") / F.col("n"))).otherwise(0.0)
    signal = (F.col("n") > LEAST_SECONDS * rate) & (rms(0) > 0)
    db = lambda i: F.when(signal & (rms(i) > 0), 20 * F.log10(rms(i) / rms(0))).otherwise(-120.0)
    rows = F.array(*[F.struct(F.lit(name).alias("band"), rms(i).alias("rms"), db(i).alias("relative_db")) for i, name in enumerate(names)])
    return sums.select("stream", F.inline(rows))


def band_tilt(balance: DataFrame, rate: int) -> DataFrame:
    """stream, tilt_db: how far the highest band lies below the first."""
    last = list(bands_at(rate))[-1]
    return balance.where(F.col("band") == last).select("stream", F.col("relative_db").alias("tilt_db"))


# From how many decibels on a difference is told, and how.
LEAST_DIFFERENCE_DB = 6.0
DULLER = (
    "マイク音声の高域（4〜7 kHz）がPC内部音声より {} dB 少なく測定されました。マイク側だけがこもって聞こえる場合、原因は録音デバイスまたはWindows側の設定である可能性が高いです。"
    "ログの「Microphone capture format」の行で、マイクのサンプルレートを確認してください。"
)


def tilt_differences(microphone: DataFrame, system: DataFrame, rate: int) -> DataFrame:
    """meeting_id, difference_db, message of meetings whose ``microphone`` is duller than their ``system`` audio by LEAST_DIFFERENCE_DB or more.

    Both are balances (meeting_id in place of stream, band, rms, relative_db); one of which too little was heard tells nothing. The message rounds halves to even.
    """
    first, last = list(bands_at(rate))[0], list(bands_at(rate))[-1]

    def tilt(balance: DataFrame, name: str) -> DataFrame:
        of = lambda band: F.max(F.when(F.col("band") == band, F.col("relative_db")))
        return balance.groupBy("meeting_id").agg(of(last).alias(name), of(first).alias("own")).where("own = 0").drop("own")

    rows = tilt(microphone, "mic").join(tilt(system, "sys"), "meeting_id").select("meeting_id", (F.col("sys") - F.col("mic")).alias("difference_db"))
    before, after = DULLER.split("{}")
    return rows.where(F.col("difference_db") >= LEAST_DIFFERENCE_DB).withColumn("message", F.concat(F.lit(before), F.bround("difference_db").cast("long").cast("string"), F.lit(after)))
