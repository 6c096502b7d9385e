"""Exact deduplication by deterministic block naming (Karp, Miller and Rosenberg's naming, as Spark jobs).

A text is cut into blocks of a fixed number of bytes. All blocks of all documents are sorted, and equal blocks get the
same integer, their name. Then the names of adjacent blocks are paired, the pairs sorted and named in turn, until
each document holds one name. Texts of equal length pass through equally many levels, so length and name together
identify a text without collisions: no hash decides.

A level is one range shuffle. Rows sort by (content, row), so a block that a third of all documents share spreads
over several ranges; what a range has to know of the one before it is whether its first block continues. That comes
from one summary row a range. Documents of one block, nearly all, leave after the first level.

Spark samples the sort key to the driver to find the ranges. So that this stays small, blocks sort by their first
bytes and a 64-bit hash, and every block is compared in full with the one before it, across ranges too. Should two
different blocks ever agree in both, the level is done again with another hash: the names never rest on it.

Defined cases: a null text counts as empty; rows with a null ``doc_id`` take part, and the row that stays is then any
row with the largest id, null only where all are null; repeated rows (same id, same text) form one group in which all
rows with the largest id count as kept; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stages import cut, with_columns_of

BLOCK_BYTES = 8192
#: Bytes of a block that the sort compares before the hash.
KEY_BYTES = 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: Column) -> Column:
    """A-Z in lower case, nothing else changed; null as the empty text."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def _named(rows: DataFrame, key: list[str], keep: list[str], proof: str | None = None) -> DataFrame | None:
    """``keep`` and ``name``: equal integers for equal ``key``, over all rows.

    ``row`` and ``pos`` must identify a row. Returns None if rows of equal key differ in ``proof``.
    """
    kinds, content = dict(rows.dtypes), [*key, *([proof] if proof else [])]
    schema = f"{', '.join(f'{c} {kinds[c]}' for c in keep)}, part int, local long, clash boolean"
    schema += "".join(f", first_{c} {kinds[c]}, last_{c} {kinds[c]}" for c in content)
    fields = [tuple(x.split()) for x in schema.split(", ")]
    types = {"int": pa.int32(), "bigint": pa.int64(), "long": pa.int64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary()}

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, first, last, n, clash = TaskContext.get().partitionId(), None, None, 0, False
        for batch in batches:
            if not batch.num_rows:
                continue
            # each row against the one before it, column by column; the batch's first row against the last one of the batch before
            head = {c: last is not None and batch.column(c)[0] == last[c] for c in content}
            same = {c: np.r_[head[c], pc.equal(batch.column(c)[1:], batch.column(c)[:-1]).to_numpy(zero_copy_only=False)].astype(bool) for c in content}
            known = np.logical_and.reduce([same[c] for c in key])
            clash = clash or bool(proof and (known & ~same[proof]).any())
            names = n - 1 + np.cumsum(~known)
            first, last, n = first or {c: batch.column(c)[0] for c in content}, {c: batch.column(c)[-1] for c in content}, int(names[-1]) + 1
            yield whole({c: batch.column(c) for c in keep} | {"part": pa.array(np.full(len(names), part, np.int32)), "local": pa.array(names.astype(np.int64))}, len(names))
        if first:
            ends = {f"{end}_{c}": pa.array([row[c].as_py()], row[c].type) for end, row in (("first", first), ("last", last)) for c in content}
            yield whole(ends | {"part": pa.array([part], pa.int32()), "local": pa.array([n], pa.int64()), "clash": pa.array([clash])}, 1)

    def whole(given: dict[str, pa.Array], rows: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([given[c] if c in given else pa.nulls(rows, types[kind]) for c, kind in fields], [c for c, _ in fields])

    order = [*key, "row", "pos"]
    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = cut(sorted_rows.mapInArrow(number, schema))
    # one row for each range of the sort: their number is that of shuffle partitions, whatever the data
    before = Window.orderBy("part")
    same = {c: F.col(f"first_{c}").eqNullSafe(F.lag(f"last_{c}").over(before)) for c in content}
    joins = reduce(and_, [same[c] for c in key]) & (F.row_number().over(before) > 1)
    starts = numbered.where("clash IS NOT NULL").withColumn("joins", joins)
    if proof:
        if not starts.withColumn("clash", F.col("clash") | (F.col("joins") & ~same[proof])).where("clash").isEmpty():
            return None
    ahead = F.coalesce(F.sum("local").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = starts.select("part", (ahead - F.sum(F.col("joins").cast("int")).over(before)).alias("offset"))
    return numbered.where("clash IS NULL").join(F.broadcast(starts), "part").select(*keep, (F.col("local") + F.col("offset")).alias("name"))


def text_identities(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """For each row of ``docs``: doc_id, n_bytes, text_sha256 and ``name``; (n_bytes, name) is equal for equal texts only.

    ``text_sha256`` is carried along for callers; it decides nothing.
    """
    rows = with_columns_of(docs, doc_id="bigint", text="string").withColumn("row", F.monotonically_increasing_id())
    bytes_ = F.encode(normalised(F.col("text")), "UTF-8")
    rows = rows.select("row", "doc_id", bytes_.alias("bytes")).withColumn("n_bytes", F.length("bytes").cast("long"))
    cuts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("n_bytes") / block_bytes).cast("int") - 1))
    blocks = rows.select("row", "doc_id", "n_bytes", F.sha2("bytes", 256).alias("text_sha256"), "bytes", F.explode(cuts).alias("pos"))
    blocks = blocks.select("row", "pos", "n_bytes", F.expr(f"substring(bytes, pos * {block_bytes} + 1, {block_bytes})").alias("block"), *[F.when(F.col("pos") == 0, F.col(c)).alias(c) for c in ("doc_id", "text_sha256")])
    kept = ["row", "pos", "n_bytes", "doc_id", "text_sha256"]
    level, seed = None, 0
    while level is None:
        keyed = blocks.withColumn("start", F.expr(f"substring(block, 1, {KEY_BYTES})")).withColumn("mark", F.xxhash64("block", F.lit(seed)))
        level, seed = _named(keyed, ["start", "mark"], kept, "block"), seed + 1
    level = level.withColumn("size", F.ceil(F.col("n_bytes") / block_bytes))
    done = level.where("size <= 1")
    more = level.where("size > 1")
    while not more.isEmpty():
        halves = more.groupBy("row", F.expr("cast(pos div 2 AS int)").alias("pos"), "n_bytes").agg(
            F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("left"),
            F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("right"),
            F.max("doc_id").alias("doc_id"), F.max("text_sha256").alias("text_sha256"), F.ceil(F.max("size") / 2).alias("size"))
        level = _named(halves, ["left", "right"], [*kept, "size"])
        done = done.unionByName(level.where("size <= 1"))
        more = level.where("size > 1")
    return done.select("doc_id", "n_bytes", "text_sha256", "name")


def exact_groups(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, n_bytes.

    Of equal texts (after lower-casing A-Z) the row with the largest doc_id stays.
    """
    named = text_identities(docs, block_bytes)
    # kept apart from the aggregate, so that adaptive execution may split the partition of a large group
    groups = cut(named.groupBy("n_bytes", "name").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")))
    out = named.join(groups, ["n_bytes", "name"])
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", "n_bytes")


def drop_exact(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs``, all columns, without those that an equal text with a larger doc_id replaces."""
    gone = exact_groups(docs, block_bytes).where("NOT kept").select(F.col("doc_id").alias("__gone"), F.col("text_sha256").alias("__sha"))
    same = docs["doc_id"].eqNullSafe(gone["__gone"]) & (F.sha2(F.encode(normalised(docs["text"]), "UTF-8"), 256) == gone["__sha"])
    return docs.join(gone, same, "left_anti")


def op3_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP3_SQL = """
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents
), g AS (SELECT x, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY x)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(x) AS text_sha256,
       CAST(octet_length(encode(x)) AS BIGINT) AS n_bytes
FROM t JOIN g USING (x)
"""
