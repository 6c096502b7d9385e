"""Recursive filters of long streams with their blocks in parallel.

What a linear filter's state becomes over a block is an affine map of the state before: a power of the filter's step matrix, which depends on the block's
length alone, and an offset, which is the state that the block leaves behind when it begins from rest. Such maps compose, so the true state before every block
follows from a scan over one small row a block; then all blocks run from their states, in any order, on any task. The scan itself goes in two steps,
within groups of GROUP blocks and over the groups, so a stream of any length is the work of many tasks, and none holds more than GROUP small rows.

A block's samples are filtered twice, once for its offset and once for its output. Blocks of one length are filtered side by side, and groups come one after
another in a task, in order, so short streams cost rows and not calls. Streams have stream, block (ascending) and samples.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .filters import Biquad, listening_eq
from .lineage import written

GROUP = 1024
#: Samples that are filtered side by side.
HELD = 1 << 20


class Bank:
    """Chains of sections side by side, all over the same samples; their states as one vector."""

    def __init__(self, chains: list[list[Biquad]], scale: float = 1.0) -> None:
        self.chains, self.scale = chains, scale
        self.size = 2 * sum(len(c) for c in chains)
        self._powers: dict[int, np.ndarray] = {0: np.eye(self.size)}
        self._step: np.ndarray | None = None

    def run(self, x: np.ndarray, state: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """The output of each chain and the state after the samples, or after each row of them."""
        state, out, at = state.copy(), [], 0
        for chain in self.chains:
            y = x
            for section in chain:
                y, state[..., at : at + 2] = section.process(y, state[..., at : at + 2])
                at += 2
            out.append(y * self.scale)
        return out, state

    def power(self, n: int) -> np.ndarray:
        """How ``n`` samples move a state, whatever the samples."""
        if self._step is None:
            self._step = np.array([self.run(np.zeros(1), unit)[1] for unit in np.eye(self.size)]).reshape(self.size, self.size).T
        if n not in self._powers:
            self._powers[n] = np.linalg.matrix_power(self._step, n)
        return self._powers[n]


class Banks:
    """The bank for a value that all blocks of a stream have, such as their rate; each is made once in a task."""

    def __init__(self, make: Callable[[object], Bank]) -> None:
        self.make, self.made = make, {}

    def __call__(self, value: object) -> Bank:
        if value not in self.made:
            self.made[value] = self.make(value)
        return self.made[value]


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all arrays of ``column`` and the length of each; null is empty."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)


def alike(lengths: np.ndarray, by: list) -> Iterator[tuple[np.ndarray, int, object]]:
    """Rows of one length and one value of ``by``, HELD samples or one row at most at once."""
    rows: dict[tuple, list[int]] = {}
    for i, key in enumerate(zip(lengths.tolist(), by, strict=True)):
        rows.setdefault(key, []).append(i)
    for (n, value), of in rows.items():
        most = max(1, HELD // max(n, 1))
        for at in range(0, len(of), most):
            yield np.array(of[at : at + most]), n, value


def _chosen(blocks: DataFrame, bank: Bank | Callable[[object], Bank], by: str | None) -> tuple[DataFrame, Banks, str]:
    """``blocks`` with the value that chooses a stream's bank as ``by``, and its type."""
    samples = F.col("samples").cast("array<double>").alias("samples")
    if by is None:
        return blocks.select("stream", "block", samples, F.lit(0).alias("by")), Banks(lambda _: bank), "int"
    return blocks.select("stream", "block", samples, F.col(by).alias("by")), Banks(bank), dict(blocks.dtypes)[by]


def _in_order(rows: DataFrame, *keys: str, then: str) -> DataFrame:
    """The rows of each key one after another in one task, in the order of ``then``."""
    return rows.repartition(*keys).sortWithinPartitions(*keys, then)


def states(blocks: DataFrame, bank: Bank | Callable[[object], Bank], initial: Callable[[float], np.ndarray] | None = None, by: str | None = None) -> DataFrame:
    """stream, block, state: the filters' state before each block; a stream begins from rest, or as ``initial`` makes of its first sample.

    With ``by``, a column that is the same in all blocks of a stream, ``bank`` makes the stream's bank of its value.
    """
    kind = dict(blocks.dtypes)["stream"]
    blocks, banks, of = _chosen(blocks, bank, by)
    states_of = pa.list_(pa.float64())

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, lengths = flat(batch.column("samples"))
            starts = np.cumsum(lengths) - lengths
            first, offsets = np.full(len(lengths), np.nan), [None] * len(lengths)
            first[lengths > 0] = x[starts[lengths > 0]]
            for rows, n, value in alike(lengths, batch.column("by").to_pylist()):
                bank = banks(value)
                end = bank.run(x[starts[rows][:, None] + np.arange(n)], np.zeros((len(rows), bank.size)))[1]
                for i, offset in zip(rows, end, strict=True):
                    offsets[i] = offset
            made = [pa.array(lengths, pa.int64()), pa.array(first, from_pandas=True), pa.array(offsets, states_of)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("stream", "block", "by")], *made], ["stream", "block", "by", "n", "first", "offset"])

    rows = blocks.mapInArrow(ends, f"stream {kind}, block long, by {of}, n long, first double, offset array<double>")
    rows = written(rows.withColumn("part", F.floor(F.col("block") / GROUP)))

    def composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What the blocks of each part do to a state of rest, its length and first sample."""
        key = state = None
        names = ["stream", "by", "part", "n", "first", "offset"]
        held: list = []

        def put(kinds: list[pa.DataType]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names)

        kinds = None
        for batch in batches:
            kinds = [batch.schema.field(c).type for c in names[:-1]] + [states_of]
            for stream, value, part, n, first, offset in zip(*[batch.column(c).to_pylist() for c in names], strict=True):
                if key != (stream, part):
                    if len(held) >= 4096:
                        yield put(kinds)
                        held = []
                    key, bank = (stream, part), banks(value)
                    state = np.zeros(bank.size)
                    held.append([stream, value, part, 0, None, state])
                last = held[-1]
                state = bank.power(n) @ state + np.array(offset, np.float64)
                last[3], last[4], last[5] = last[3] + n, first if last[4] is None else last[4], state
        if held:
            yield put(kinds)

    def passed(names: list[str], at: str, put: str, start: Callable[[Bank, object], np.ndarray]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        """A scan that tells each row the state before it; ``start`` is that of the first row of a key (the columns ``names``), made of the column ``begin``."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key = state = bank = None
            for batch in batches:
                before, keys = [], zip(*[batch.column(c).to_pylist() for c in names], strict=True)
                for this, value, n, offset, begin in zip(keys, *[batch.column(c).to_pylist() for c in ("by", "n", "offset", "begin")], strict=True):
                    if key != this:
                        key, bank = this, banks(value)
                        state = start(bank, begin)
                    before.append(state)
                    state = bank.power(n) @ state + np.array(offset, np.float64)
                yield pa.RecordBatch.from_arrays([batch.column("stream"), batch.column(at), pa.array(before, states_of)], ["stream", at, put])

        return run

    parts = _in_order(rows, "stream", "part", then="block").mapInArrow(composed, f"stream {kind}, by {of}, part long, n long, first double, offset array<double>")
    whole = Window.partitionBy("stream").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    parts = parts.withColumn("begin", F.first("first", ignorenulls=True).over(whole))
    begun = passed(["stream"], "part", "begin", lambda bank, first: np.zeros(bank.size) if initial is None or first is None else np.asarray(initial(first), np.float64))
    starts = _in_order(parts, "stream", then="part").mapInArrow(begun, f"stream {kind}, part long, begin array<double>")
    within = passed(["stream", "part"], "block", "state", lambda _, begin: np.array(begin, np.float64))
    return _in_order(rows.join(starts, ["stream", "part"]), "stream", "part", then="block").mapInArrow(within, f"stream {kind}, block long, state array<double>")


def through(blocks: DataFrame, bank: Bank | Callable[[object], Bank], initial: Callable[[float], np.ndarray] | None = None, by: str | None = None) -> DataFrame:
    """stream, block, outputs: what each chain of ``bank`` makes of each block, as an array of arrays; and the column ``by``, if given (see ``states``)."""
    kind, before = dict(blocks.dtypes)["stream"], states(blocks, bank, initial, by)
    blocks, banks, of = _chosen(blocks, bank, by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, lengths = flat(batch.column("samples"))
            starts, state = np.cumsum(lengths) - lengths, batch.column("state")
            for rows, n, value in alike(lengths, batch.column("by").to_pylist()):
                bank, few = banks(value), batch.select(["stream", "block", "by"]).take(pa.array(rows))
                given = flat(state.take(pa.array(rows)))[0].reshape(len(rows), bank.size)
                made = np.stack(bank.run(x[starts[rows][:, None] + np.arange(n)], given)[0], axis=1)
                chains = made.shape[1]
                inner = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) * chains + 1) * n, pa.int32()), pa.array(made.ravel()))
                yield pa.RecordBatch.from_arrays([*few.columns, pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * chains, pa.int32()), inner)], ["stream", "block", "by", "outputs"])

    out = blocks.join(before, ["stream", "block"]).mapInArrow(run, f"stream {kind}, block long, by {of}, outputs array<array<double>>")
    return out.withColumnRenamed("by", by) if by else out.drop("by")


def filtered(blocks: DataFrame, sections: list[Biquad], scale: float = 1.0) -> DataFrame:
    """``blocks`` (stream, block, samples) through ``sections`` one after another."""
    return through(blocks, Bank([sections], scale)).select("stream", "block", F.element_at("outputs", 1).alias("samples"))


def equalised(blocks: DataFrame, rate: int) -> DataFrame:
    """The listening equaliser: a high shelf that can't exceed full scale."""
    chain = listening_eq(rate)
    return filtered(blocks, chain.sections, chain.scale)


def processed(blocks: DataFrame, rate: int, dc_block: bool = True) -> DataFrame:
    """What a recording goes through before it is mixed: the DC blocker, if it is wanted; nothing is delayed."""
    return dc_blocked(blocks, rate) if dc_block else blocks.select("stream", "block", "samples")


def dc_blocked(blocks: DataFrame, rate: int, cutoff: float = 20.0) -> DataFrame:
    """y = x - x1 + R * y1, from rest."""
    return filtered(blocks, [Biquad.dc_block(rate, cutoff)])


def smoothed(blocks: DataFrame, alpha: float) -> DataFrame:
    """y = y1 + alpha * (x - y1), from the first sample."""
    bank = Bank([[Biquad((alpha, 0.0, 0.0), (alpha - 1.0, 0.0))]])
    return through(blocks, bank, lambda first: np.array([(1.0 - alpha) * first, 0.0])).select("stream", "block", F.element_at("outputs", 1).alias("samples"))


def smoothed_levels(levels: DataFrame, alpha: float, block_rows: int = 4096) -> DataFrame:
    """stream, n, last of ``levels`` (stream, seq, value): the exponentially smoothed value after all measurements; the first one starts it."""
    rows = levels.groupBy("stream", F.floor(F.col("seq") / block_rows).alias("block")).agg(F.sort_array(F.collect_list(F.struct("seq", F.col("value").cast("double").alias("value")))).alias("x"))
    out = smoothed(rows.select("stream", "block", F.transform("x", lambda v: v["value"]).alias("samples")), alpha)
    return out.groupBy("stream").agg(F.sum(F.size("samples")).cast("long").alias("n"), F.max_by(F.element_at("samples", -1), "block").alias("last"))
