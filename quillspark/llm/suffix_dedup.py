"""Substring deduplication by sparse suffix arrays.

Of the suffixes of all texts (by words, A-Z in lower case) only those are retained that start at a minimiser: the
smallest hash of KGRAM words in some window of WINDOW starts. Equal passages select equal places, so a passage of
PASSAGE words or more that occurs twice holds, within its first WINDOW starts, a place that both occurrences retain,
with CORE words of the passage from there on.

The retained suffixes are sorted and neighbours compared. First an aggregate over hashes of the suffixes' first CORE
words leaves only those whose core occurs twice; it combines in the map tasks, so a core that a third of all documents
share sends one row from each. The rest are sorted by range over (core, the WINDOW words beyond it, the WINDOW words
before it in reverse, document, place). The words carried reach to the next and the last minimiser, whose own extensions
take over there, so passages of any length are covered without carrying them.

Neighbours that agree in all of that are one run: all but its first, the earliest of them, are repeated, core and context.
A sort key ends with document and place, so a hot passage spreads over several ranges; a range learns from one row of the
range before it whether its first suffix continues a run. The firsts of runs with one core differ in context: each is
extended left and right over the earliest of them, and is repeated as far as both agree if that is PASSAGE words. What it
shares with others than that must go on, to the right or to the left, with the word at which it leaves the earliest: only
firsts that have that word (and all up to it) in common with another are compared further, by every division of the
PASSAGE words around the core, again with the earliest occurrence. So each repeated word refers to an earlier place, no
passage loses its first occurrence, and pairs that never stand side by side are found as well.

A match needs equal 64-bit hashes of CORE words and equal 32-bit codes of at least PASSAGE - CORE words around them.

Defined cases: null counts as empty; texts of fewer than PASSAGE words hold no passage; rows with a null doc_id take no
part; a document is an id with a text: repeated rows (same id, same text) are one document and remove nothing from each
other, several texts of one id are told apart by 32 bits of a hash and marked each for itself; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .stages import cut, marked_documents, written
from .words import Words, by_bytes, mix, words_of

PASSAGE = 50
WINDOW, KGRAM = 20, 5
#: Words of a passage that follow the first place retained in it, at least.
CORE = PASSAGE - WINDOW + 1
#: Words that a match needs around its core.
AROUND = PASSAGE - CORE


def _run_hash(h: np.ndarray, n: int, salt: int) -> np.ndarray:
    """A hash of every run of ``n`` words: running sums of a polynomial, mixed."""
    base = np.uint64((0x9E3779B97F4A7C15 * (2 * salt + 1) | 1) & ((1 << 64) - 1))
    power = np.full(len(h) + 1, base, np.uint64)
    power[0] = 1
    power = np.multiply.accumulate(power)
    back = np.full(len(h) + 1, np.uint64(pow(int(base), -1, 1 << 64)), np.uint64)
    back[0] = 1
    back = np.multiply.accumulate(back)
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * power[:-1], out=sums[1:])
    starts = np.arange(len(h) - n + 1)
    return mix((sums[n:] - sums[:-n]) * back[starts])


def retained(h: np.ndarray) -> np.ndarray:
    """Places of the minimisers of one text's word hashes that have CORE words from there on."""
    if len(h) < PASSAGE:
        return np.zeros(0, np.int64)
    keys = _run_hash(h, KGRAM, 1)
    windows = np.lib.stride_tricks.sliding_window_view(keys, WINDOW)
    places = []
    for at in range(0, len(windows), 1 << 16):
        some = windows[at : at + (1 << 16)]
        places.append(np.unique(some.argmin(axis=1) + np.arange(at, at + len(some))))
    found = np.unique(np.concatenate(places))
    return found[found <= len(h) - CORE]


def _each_text(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(row, word hashes) of every text of a column, in bounded pieces."""
    for a, b in by_bytes(column):
        words: Words = words_of(column[a:b])[2]
        for i in range(b - a):
            yield a + i, words.hash[words.first[i] : words.first[i + 1]]


def suffixes(documents: DataFrame) -> DataFrame:
    """doc_id, mark (of the text), place, core: the retained suffixes of ``marked_documents`` and the hash of their first CORE words."""

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, marks, places, cores = [], [], [], []
            owner, mark = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for i, h in _each_text(batch.column(2)):
                at = retained(h)
                if len(at):
                    ids.append(np.full(len(at), owner[i]))
                    marks.append(np.full(len(at), mark[i]))
                    places.append(at)
                    cores.append(_run_hash(h, CORE, 2)[at].view(np.int64))
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (ids, marks, places, cores)], ["doc_id", "mark", "place", "core"])

    return documents.mapInArrow(select, "doc_id long, mark int, place long, core long")


def with_context(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id, mark, place, core, right, left for the ``wanted`` (doc_id, mark, places) suffixes of each document.

    ``right`` packs the WINDOW words beyond the core and ``left`` the WINDOW words before the place, nearest first, four bytes a
    word; at a text's end they are shorter.
    """

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            owner, mark, wanted_places = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)
            for i, h in _each_text(batch.column(3)):
                core, short = _run_hash(h, CORE, 2).view(np.int64), (h >> np.uint64(32)).astype(">u4")
                forward, back = short.tobytes(), short[::-1].tobytes()
                for p in wanted_places[i].values.to_numpy().tolist():
                    if p > len(h) - CORE:
                        continue  # of another text of the id whose mark is the same
                    behind = 4 * (len(h) - p)
                    out.append((owner[i], mark[i], p, int(core[p]), forward[4 * (p + CORE) : 4 * (p + CORE + WINDOW)], back[behind : behind + 4 * WINDOW]))
                if len(out) > 20_000:
                    yield _suffix_batch(out)
                    out = []
            if out:
                yield _suffix_batch(out)

    joined = documents.join(wanted, ["doc_id", "mark"]).select("doc_id", "mark", "places", "text")
    return joined.mapInArrow(cut_out, "doc_id long, mark int, place long, core long, right binary, left binary")


_SUFFIX = pa.schema([("doc_id", pa.int64()), ("mark", pa.int32()), ("place", pa.int64()), ("core", pa.int64()), ("right", pa.binary()), ("left", pa.binary())])


def _suffix_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SUFFIX, strict=True)], schema=_SUFFIX)


def common_words(a: bytes, b: bytes) -> int:
    """Leading words in which two packed runs agree."""
    n = min(len(a), len(b)) // 4
    differs = int.from_bytes(a[: 4 * n]) ^ int.from_bytes(b[: 4 * n])
    return (32 * n - differs.bit_length()) // 32


CONTEXT = ["core", "right", "left"]
NEIGHBOUR = "doc_id long, mark int, place long, core long, right binary, left binary, n_right int, n_left int, source_id long, new boolean, part int, end string"


def neighbours(found: DataFrame) -> DataFrame:
    """doc_id, mark, place, core, right, left, n_right, n_left, new, source_id: the sorted array; ``new`` where a suffix differs from the one before it.

    ``source_id`` is the document of the first suffix that is equal, core and context; ``n_right`` and ``n_left`` are the context's words.
    Core and context themselves are left out where not needed further, but for the firsts.
    """
    kind = pa.schema([*_SUFFIX, ("n_right", pa.int32()), ("n_left", pa.int32()), ("source_id", pa.int64()), ("new", pa.bool_()), ("part", pa.int32()), ("end", pa.string())])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, first, last, source = TaskContext.get().partitionId(), None, None, None
        constant = lambda n, value, f: pa.array([value] * n, f.type)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            rows = pa.Table.from_batches([batch] if last is None else [last, batch]).combine_chunks()
            differs = np.zeros(len(rows) - 1, bool)
            for c in CONTEXT:
                differs |= pc.not_equal(rows[c].slice(1), rows[c].slice(0, len(rows) - 1)).to_numpy(zero_copy_only=False)
            new = differs if last is not None else np.r_[False, differs]
            again = ~differs
            for c in ("doc_id", "mark", "place"):
                again &= pc.equal(rows[c].slice(1), rows[c].slice(0, len(rows) - 1)).to_numpy(zero_copy_only=False)
            if again.any():  # repeated rows: one of them is enough
                keep = ~again if last is not None else np.r_[True, ~again]
                batch, new, n = batch.filter(pa.array(keep)), new[keep], int(keep.sum())
                if not n:
                    continue
            # where the range's first run goes on the source is not known here
            owner, at = batch.column(0).to_numpy(), np.maximum.accumulate(np.where(new, np.arange(n), -1))
            sources = pa.array(np.where(at >= 0, owner[np.maximum(at, 0)], source if source is not None else 0), mask=(at < 0) & (source is None))
            needed = new.copy()
            if first is None:
                first, needed[0] = batch.slice(0, 1), True
            last, source = batch.slice(n - 1, 1), sources[n - 1].as_py()
            kept = [pc.if_else(pa.array(needed), batch.column(c), None) for c in CONTEXT]
            sizes = [pc.divide(pc.binary_length(batch.column(c)), 4) for c in ("right", "left")]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *kept, *sizes, sources, pa.array(new), constant(n, part, kind.field("part")), constant(n, None, kind.field("end"))], schema=kind)
        if first is not None:
            for row, known, end in ((first, first.column(0)[0].as_py(), "first"), (last, source, "last")):
                yield pa.RecordBatch.from_arrays([*row.columns, *[pa.array([0], pa.int32())] * 2, pa.array([known], pa.int64()), pa.array([False]), pa.array([part], pa.int32()), pa.array([end])], schema=kind)

    order = [*CONTEXT, "doc_id", "mark", "place"]
    walked = cut(found.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(walk, NEIGHBOUR))
    # two rows for each range of the sort: their number is that of shuffle partitions, whatever the data
    here, over = F.struct("doc_id", "mark", "place"), Window.orderBy("part")
    ends = walked.where("end IS NOT NULL").groupBy("part").agg(*[F.max(F.when(F.col("end") == end, F.struct(*CONTEXT, "source_id", here.alias("at")))).alias(end) for end in ("first", "last")])
    ends = ends.withColumn("before", F.lag("last").over(over))
    goes_on = F.col("before").isNotNull() & F.struct(*[f"first.{c}" for c in CONTEXT]).eqNullSafe(F.struct(*[f"before.{c}" for c in CONTEXT]))
    ends = ends.withColumn("goes_on", goes_on)
    # the last run's source: known, or that of the range's first suffix, or that of the ranges before
    ends = ends.withColumn("own", F.coalesce("last.source_id", F.when(~F.col("goes_on"), F.col("first.source_id"))))
    carried = F.last("own", ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, -1))
    starts = ends.select("part", F.col("first.at").alias("opens"), "goes_on", F.when(F.col("goes_on"), carried).otherwise(F.col("first.source_id")).alias("carried"))
    rows = walked.where("end IS NULL").join(F.broadcast(starts), "part")
    opens = F.col("source_id").isNull() & (here == F.col("opens")) & ~F.col("goes_on")
    return rows.select("doc_id", "mark", "place", *CONTEXT, "n_right", "n_left", (F.col("new") | opens).alias("new"), F.coalesce("source_id", "carried").alias("source_id"))


def extended(firsts: DataFrame) -> DataFrame:
    """``firsts`` of runs, without the earliest of each core, with ``from_left``, ``from_right``: the words beyond the core that they share with it, of document ``source_id``."""
    at = F.struct("doc_id", "mark", "place")
    earliest = cut(firsts.groupBy("core").agg(F.min(F.struct(at.alias("at"), F.col("right").alias("first_right"), F.col("left").alias("first_left"))).alias("x"), F.count("*").alias("n")).where("n > 1").select("core", "x.*"))
    joined = firsts.join(earliest, "core").where(at != F.col("at")).select("doc_id", "mark", "place", *CONTEXT, "first_right", "first_left", F.col("at.doc_id").alias("source_id"))
    schema = "doc_id long, mark int, place long, core long, right binary, left binary, source_id long, from_left int, from_right int"

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [pa.array([common_words(a, b) for a, b in zip(batch.column(x).to_pylist(), batch.column(y).to_pylist(), strict=True)], pa.int32()) for x, y in (("left", "first_left"), ("right", "first_right"))]
            names = ["doc_id", "mark", "place", *CONTEXT, "source_id"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], *both], [*names, "from_left", "from_right"])

    return written(joined.mapInArrow(extend, schema))


def divided(firsts: DataFrame) -> DataFrame:
    """doc_id, mark, start, stop, source_id: what ``firsts`` (see ``extended``) share with others than the earliest of their core."""
    at = F.struct("doc_id", "mark", "place")
    leaves = lambda side: F.when((F.col(f"from_{side}") < AROUND) & (F.length(side) > 4 * F.col(f"from_{side}")), F.struct(F.lit(side).alias("side"), F.expr(f"substring({side}, 1, 4 * (from_{side} + 1))").alias("until")))
    ways = firsts.withColumn("way", F.explode(F.array_compact(F.array(leaves("left"), leaves("right"))))).select("doc_id", "mark", "place", *CONTEXT, "from_left", "from_right", "way.*")
    shared = cut(ways.groupBy("core", "side", "until").agg(F.count("*").alias("n")).where("n > 1").drop("n"))
    # words to the left in a division of the words around the core, the rest being to the right
    low = F.when(F.col("side") == "left", F.col("from_left") + 1).otherwise(F.lit(0))
    high = F.when(F.col("side") == "left", F.lit(AROUND)).otherwise(AROUND - F.col("from_right") - 1)
    parts = ways.join(shared, ["core", "side", "until"]).where(low <= high).withColumn("n_left", F.explode(F.sequence(low, high)))
    parts = parts.where(f"length(left) >= 4 * n_left AND length(right) >= 4 * ({AROUND} - n_left)")
    words = F.xxhash64(F.expr("substring(left, 1, 4 * n_left)"), F.expr(f"substring(right, 1, 4 * ({AROUND} - n_left))"))
    parts = written(parts.select("core", "n_left", words.alias("words"), "doc_id", "mark", "place"))
    earliest = cut(parts.groupBy("core", "n_left", "words").agg(F.min(at).alias("at"), F.count("*").alias("n")).where("n > 1").drop("n"))
    later = parts.join(earliest, ["core", "n_left", "words"]).where(at != F.col("at"))
    return later.select("doc_id", "mark", (F.col("place") - F.col("n_left")).alias("start"), (F.col("place") + PASSAGE - F.col("n_left")).alias("stop"), F.col("at.doc_id").alias("source_id"))


def repeated_passages(documents: DataFrame) -> DataFrame:
    """doc_id, mark, start, stop (words), source_id: passages of a document that occur earlier, with the document of an earlier occurrence.

    Earlier means in a document of smaller id, in another text of the id, or before in the same text.
    """
    found = suffixes(documents)
    cores = cut(found.groupBy("core").agg(F.count("*").alias("n")).where("n > 1").select("core"))
    wanted = found.join(cores, "core", "left_semi").groupBy("doc_id", "mark").agg(F.collect_set("place").alias("places"))
    rows = neighbours(with_context(documents, wanted))
    whole = rows.where("NOT new").select("doc_id", "mark", (F.col("place") - F.col("n_left")).alias("start"), (F.col("place") + CORE + F.col("n_right")).alias("stop"), "source_id")
    firsts = extended(rows.where("new").select("doc_id", "mark", "place", *CONTEXT))
    grown = firsts.where(F.col("from_left") + F.col("from_right") >= AROUND)
    grown = grown.select("doc_id", "mark", (F.col("place") - F.col("from_left")).alias("start"), (F.col("place") + CORE + F.col("from_right")).alias("stop"), "source_id")
    return whole.where(f"stop - start >= {PASSAGE}").union(grown).union(divided(firsts))


def without_passages(docs: DataFrame) -> DataFrame:
    """The documents that lose words: doc_id, source_ids, n_words, n_removed, cuts (start, stop in words), text (the rest)."""
    documents = marked_documents(docs)
    marks = repeated_passages(documents).groupBy("doc_id", "mark").agg(F.sort_array(F.collect_set("source_id")).alias("source_ids"), F.sort_array(F.collect_set(F.struct("start", "stop"))).alias("spans"))
    kind = pa.schema([("doc_id", pa.int64()), ("source_ids", pa.list_(pa.int64())), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("cuts", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), ("text", pa.string())])

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in by_bytes(batch.column(3)):
                data, offsets, words = words_of(batch.column(3)[a:b])
                out = []
                for i in range(b - a):
                    row, low, n = a + i, int(words.first[i]), int(words.first[i + 1] - words.first[i])
                    cuts: list[dict] = []
                    for x in batch.column(2)[row].as_py():
                        start, stop = x["start"], min(x["stop"], n)
                        if cuts and start <= cuts[-1]["stop"]:
                            cuts[-1]["stop"] = max(cuts[-1]["stop"], stop)
                        elif start < stop:
                            cuts.append({"start": start, "stop": stop})
                    kept, at = [], int(offsets[i])
                    for c in cuts:
                        kept.append(data[at : words.start[low + c["start"]]].tobytes())
                        at = int(words.stop[low + c["stop"] - 1])
                    kept.append(data[at : offsets[i + 1]].tobytes())
                    out.append({"doc_id": batch.column(0)[row].as_py(), "source_ids": batch.column(1)[row].as_py(), "n_words": n, "n_removed": sum(c["stop"] - c["start"] for c in cuts), "cuts": cuts, "text": b"".join(kept).decode("utf-8", "replace")})
                yield pa.RecordBatch.from_pylist(out, kind)

    joined = documents.join(marks, ["doc_id", "mark"]).select("doc_id", "source_ids", "spans", "text")
    return joined.mapInArrow(remove, "doc_id long, source_ids array<long>, n_words long, n_removed long, cuts array<struct<start: long, stop: long>>, text string")


def op8_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return without_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
