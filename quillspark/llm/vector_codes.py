"""Compression of vectors to codes: a codebook for each part of the vector, fitted by Lloyd's rounds in integers that are kept up by differences.

A component x is the integer floor(scale * x); a vector is cut into equal parts, and each part has a codebook of its own, begun with the
vectors of the smallest ids. In each round every part takes its nearest entry, and an entry becomes the floor of the mean of its parts.

The state of a round is a table in the shared folder: the vectors with their assignment before and now. Beside it stands the table of running
sums: for each entry the number of its parts and the sum of each component. A round moves between tasks only what parts whose assignment
changed add to one entry and take from another, summed up within each task first: at most two rows for each entry, component and task,
whatever the number of vectors. All sums are of integers, so neither the order of rows nor a task run anew changes the result.

What reaches the driver are the sums, entries * (dimension + parts) numbers. The nearest entry is found with numpy on whole batches.

Defined cases: vectors that are null or hold null or non-finite components are dropped, and so are those whose length is not the most frequent one
(of equally frequent ones the longest); a length that the parts don't divide raises, and so does a component beyond MOST, where the sums would
not be exact. Null ids take part and come last in the order of ids; vectors of one id are ordered by their components; repeated rows are
rows of their own. With fewer vectors than entries there are as many entries as vectors; an empty table gives an empty result,
and vectors without components have empty codes. At most 256 entries fit a code. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stages import cut, spread, with_columns_of

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: The largest component: squares of differences and their sums over 4,096 components stay exact.
MOST = 2.0**14
#: Groups up to which a table of one number each (a few MB) is broadcast.
FEW_GROUPS = 100_000


def integers(vectors: DataFrame, parts: int = PARTS, scale: int = SCALE) -> DataFrame:
    """vec_id, label and the integer vector ``v`` of the rows that have one."""
    rows = with_columns_of(vectors, vec_id="bigint", embedding="array<double>", label="bigint")
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(F.col("embedding").isNotNull() & ~bad).withColumn("n", F.size("embedding"))
    length = rows.groupBy("n").count().orderBy(F.desc("count"), F.desc("n")).first()
    if length is None:
        return rows.select("vec_id", "label", F.array().cast("array<int>").alias("v"))
    if length["n"] % parts:
        raise ValueError(f"vectors of {length['n']} components can't be cut into {parts} equal parts")
    far = F.raise_error(F.lit(f"a component lies beyond {MOST}, where sums are not exact")).cast("int")
    whole = F.transform("embedding", lambda x: F.when(F.abs(x) > MOST, far).otherwise(F.floor(x * scale).cast("int")))
    return rows.where(F.col("n") == length["n"]).select("vec_id", "label", whole.alias("v"))


def begun(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES) -> np.ndarray:
    """The first codebooks, part x entry x component: the parts of the vectors of the smallest ids."""
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    width = len(first[0]["v"]) // parts if first else 0
    return np.array([r["v"] for r in first], dtype=np.int64).reshape(len(first), parts, width).transpose(1, 0, 2)


def nearest(v: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry of each part (vector x part; ties to the lower index) and its squared distance, of integer vectors."""
    parts, _, width = books.shape
    x, codes, distances = v.reshape(len(v), parts, width), np.zeros((len(v), parts), np.int64), np.zeros((len(v), parts), np.int64)
    most = max(int(np.abs(books).max(initial=0)), int(np.abs(v).max(initial=0)))
    kind = np.float64 if 4 * most * most * width < 2**53 else np.int64  # both exact
    for p in range(parts):
        book = books[p].astype(kind)
        codes[:, p] = np.argmin((book * book).sum(1) - 2 * (x[:, p].astype(kind) @ book.T), axis=1)
        distances[:, p] = ((x[:, p] - books[p][codes[:, p]]) ** 2).sum(1)
    return codes, distances


def _vectors(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(batch.num_rows, -1)


def _codes(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column(name).to_pylist()), np.uint8).reshape(batch.num_rows, -1).astype(np.int64)


def assigned(state: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, v, the assignment so far as ``before`` (null at first) and the one by ``books`` as ``now``, a byte for each part."""
    schema = "vec_id long, label long, v array<int>, before binary, now binary"

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                codes = nearest(_vectors(batch), books)[0].astype(np.uint8)
                before = batch.column("now") if "now" in batch.schema.names else pa.nulls(batch.num_rows, pa.binary())
                now = pa.array([c.tobytes() for c in codes], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), batch.column("v"), before, now], names=["vec_id", "label", "v", "before", "now"])

    return state.mapInArrow(assign, schema)


def changes(state: DataFrame, books: np.ndarray) -> DataFrame:
    """part, entry, pos, change: what parts whose assignment changed add to the sums (pos -1: to the number of parts)."""
    parts, entries, width = books.shape

    def differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, seen = np.zeros((parts, entries, width + 1), np.int64), np.zeros((parts, entries), bool)
        for batch in batches:
            if not batch.num_rows:
                continue
            x, now = _vectors(batch).reshape(batch.num_rows, parts, width), _codes(batch, "now")
            first = batch.column("before").null_count == batch.num_rows
            before = now if first else _codes(batch, "before")
            for p in range(parts):
                changed = np.full(len(x), True) if first else before[:, p] != now[:, p]
                for codes, sign in ((now, 1), (before, -1))[: 1 if first else 2]:
                    np.add.at(sums[p, :, 0], codes[changed, p], sign)
                    np.add.at(sums[p, :, 1:], codes[changed, p], sign * x[changed, p])
                    seen[p, codes[changed, p]] = True
        p, e = np.nonzero(seen)
        found = [np.repeat(p, width + 1), np.repeat(e, width + 1), np.tile(np.arange(-1, width), len(p)), sums[p, e].reshape(-1)]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(found, (pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True)], names=["part", "entry", "pos", "change"])

    return state.select("v", "before", "now").mapInArrow(differ, "part int, entry int, pos int, change long")


def moved(sums: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks whose entries are the floors of their parts' means; entries without parts stay."""
    totals = np.zeros((books.shape[0], books.shape[1], books.shape[2] + 1), np.int64)
    for r in sums.collect():  # one row for each number of the codebooks, whatever the number of vectors
        totals[r["part"], r["entry"], r["pos"] + 1] = r["change"]
    count = totals[:, :, :1]
    return np.where(count > 0, totals[:, :, 1:] // np.maximum(count, 1), books)


def fitted(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """The last state (vec_id, label, v, before, now) and the codebooks after the rounds."""
    state = integers(vectors, parts, scale)
    books, sums = begun(state, parts, entries), None
    for _ in range(rounds if books.size else 0):
        state = cut(assigned(state, books))
        change = changes(state, books)
        sums = cut((change if sums is None else sums.unionByName(change)).groupBy("part", "entry", "pos").agg(F.sum("change").alias("change")))
        books = moved(sums, books)
    return state, books


def coded(state: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code (two hex digits for each part) and error (squared distances to the entries, summed up) of integer vectors."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                codes, distances = nearest(_vectors(batch), books)
                text = pa.array([c.tobytes().hex() for c in codes.astype(np.uint8)], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), text, pa.array(distances.sum(1), pa.int64())], names=["vec_id", "label", "code", "error"])

    return state.select("vec_id", "label", "v").mapInArrow(code, "vec_id long, label long, code string, error long")


def decoded(codes: DataFrame, books: np.ndarray, scale: int = SCALE) -> DataFrame:
    """``codes`` with the vector that each ``code`` stands for, as ``approximate``."""
    entries = F.array(*[F.array(*[F.array(*[F.lit(int(x)) for x in entry]) for entry in book]) for book in books])
    index = lambda p: F.conv(F.substring("code", p * 2 + 1, F.lit(2)), 16, 10).cast("int") + 1
    each = [F.element_at(F.element_at(entries, p + 1), index(F.lit(p))) for p in range(len(books))]
    return codes.withColumn("approximate", F.transform(F.concat(*each), lambda x: x.cast("double") / scale))


def books_digest(books: np.ndarray) -> str:
    """SHA-256 of the entries' components in decimal, by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def with_label_error(codes: DataFrame) -> DataFrame:
    """``codes`` (label, error, ...) with the sum of ``error`` over equal labels; null is a label too."""
    totals = cut(codes.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")))
    totals = F.broadcast(totals) if totals.count() <= FEW_GROUPS else spread(totals)
    return codes.join(totals, F.col("label").eqNullSafe(F.col("of"))).drop("of")


def op11_vector_codes(spark, sf_dir: str) -> DataFrame:
    state, books = fitted(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    if not books.size:
        return state.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    found = with_label_error(cut(coded(state, books)))
    return found.select("vec_id", "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))


def _round(n: int) -> str:
    return f"""
a{n} AS (
  SELECT x.row, x.part, min({{d: list_sum(list_transform(list_zip(x.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), e: c.entry}}) AS hit
  FROM x JOIN c{n} c ON c.part = x.part GROUP BY x.row, x.part
), s{n} AS (
  SELECT part, entry, pos, s, n, (s - ((s % n) + n) % n) // n AS mean FROM (
    SELECT x.part, a.hit.e AS entry, p.pos, CAST(sum(x.v[p.pos]) AS BIGINT) AS s, count(*) AS n
    FROM x JOIN a{n} a USING (row, part) JOIN p ON true GROUP BY ALL)
), c{n + 1} AS (
  SELECT c.part, c.entry, coalesce(m.v, c.v) AS v FROM c{n} c LEFT JOIN (SELECT part, entry, list(mean ORDER BY pos) AS v FROM s{n} GROUP BY part, entry) m USING (part, entry)
)"""


OP11_SQL = f"""
WITH whole AS (
  SELECT vec_id, label, list_transform(embedding, lambda y: CAST(floor(256 * CAST(y AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0
), k AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, v) - 1 AS row, vec_id, label, v FROM whole
  WHERE len(v) = (SELECT len(v) FROM whole GROUP BY len(v) ORDER BY count(*) DESC, len(v) DESC LIMIT 1)
), w AS (SELECT max(len(v)) // 16 AS width FROM k), p AS (SELECT unnest(range(1, width + 1)) AS pos FROM w),
x AS (SELECT row, part, v[part * width + 1 : part * width + width] AS v FROM k CROSS JOIN w CROSS JOIN (SELECT unnest(range(16)) AS part)),
c1 AS (SELECT part, row AS entry, v FROM x WHERE row < 64), {_round(1)}, {_round(2)},
a3 AS (
  SELECT x.row, x.part, min({{d: list_sum(list_transform(list_zip(x.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), e: c.entry}}) AS hit
  FROM x JOIN c3 c ON c.part = x.part GROUP BY x.row, x.part
), f AS (SELECT row, string_agg(printf('%02x', hit.e), '' ORDER BY part) AS code, CAST(sum(hit.d) AS BIGINT) AS error FROM a3 GROUP BY row),
h AS (SELECT sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY part, entry, pos)) AS books FROM (SELECT part, entry, unnest(v) AS y, generate_subscripts(v, 1) AS pos FROM c3))
SELECT k.vec_id, f.code, f.error, CAST(sum(f.error) OVER (PARTITION BY k.label) AS BIGINT) AS label_error, h.books AS codebooks_sha256
FROM k JOIN f USING (row) CROSS JOIN h
"""
