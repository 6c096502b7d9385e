"""Mixing sources to target weights by weighted fair queueing, with DataFrame operations only.

Each source's documents are shuffled by a hash. A document's virtual finish time is the number of its source's words
up to and including it, divided by the source's weight; a source may be gone through ``max_repeats`` times, each pass
continuing its clock. All passes of all sources are sorted by finish time and cut where the words reach the total
budget, so each source has taken words in proportion to its weight until it is exhausted, and what an exhausted
source leaves goes to the others by weight: the split that ``targets`` computes directly.

Running sums are taken in two steps, so that no task holds a source: within small buckets of the shuffle order, and
over the sums of the buckets. Rows of one id, text and source are one group with a count, so that however many there are
they are one row there; its copies are dealt out again for the final sort, in blocks of COPIES. That sort is a range
shuffle whose partitions are summed up in the same way. The table of sources, one row each, is ordered in one task.

Defined cases: a null or empty text has size 0 and is taken 0 times; a very long text is one document, taken whole or
not; a null source is a source, last in order; rows with a null or repeated doc_id take part, ordered among themselves by
text; an empty table gives an empty result; other columns are ignored. Rows of size 0 carry no words, so a source of such
rows has target 0.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stages import cut, with_columns_of

WORD = r"[^\x20\x09-\x0D]+"
BUCKET_ROWS = 4096
#: Copies of one row that a task deals out.
COPIES = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = 3) -> DataFrame:
    """source, source_size, weight, target for each source of ``sizes`` (source, source_size).

    Every source gets its weight's share of all words, at most ``max_repeats`` times its own; the excess is shared
    again by weight. Sources in the order of their limit for each unit of weight: the first ``k`` stop at their limit
    for the smallest ``k`` at which the rest's common level does not pass the next limit.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sizes.withColumn("weight", F.element_at(cycle, (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int")))
    ranked = ranked.withColumn("most", (F.col("source_size") * max_repeats).cast("double"))
    by_limit = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = by_limit.rowsBetween(Window.unboundedPreceding, -1), by_limit.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    ranked = ranked.withColumn("level", F.when(F.col("most") / F.col("weight") >= level, level))
    ranked = ranked.withColumn("common", F.first("level", ignorenulls=True).over(by_limit.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return ranked.select("source", "source_size", "weight", F.least("most", F.coalesce(F.col("common") * F.col("weight"), "most")).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = 3, seed: int = 0) -> DataFrame:
    """One row for each row of ``docs``: doc_id, source, size, source_size, target, taken.

    ``taken`` are the words that the mix takes of the document, repeats counted; ``target`` is its source's.
    """
    return _mixed(docs, weights, max_repeats, seed).drop("key")


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = 3, seed: int = 0) -> DataFrame:
    """The rows of ``docs``, all columns, each as many times as the mix takes it; rows without words are never taken.

    Rows equal in id, text and source share what the mix takes of them as evenly as it goes.
    """
    mark = lambda key: F.md5(F.concat_ws("|", key, F.concat(F.lit("s"), F.col("source").cast("string"))))
    taken = _mixed(docs, weights, max_repeats, seed).where("size > 0")
    times = cut(taken.groupBy(mark(F.col("key")).alias("__mark")).agg(F.sum(F.expr("taken div size")).alias("__times"), F.count("*").alias("__n")).where("__times > 0"))
    marked = docs.withColumn("__mark", mark(order_key(docs["doc_id"].cast("bigint"), docs["text"], seed)))
    own = marked.join(times.where("__n = 1"), "__mark").withColumn("__own", F.col("__times"))
    if not times.where("__n > 1").isEmpty():
        # equal rows are numbered in parts, so that no task numbers them all
        equal = cut(marked.join(times.where("__n > 1"), "__mark").withColumn("__part", F.floor(F.rand(seed) * COPIES).cast("int")))
        earlier = Window.partitionBy("__mark").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
        parts = equal.groupBy("__mark", "__part").agg(F.count("*").alias("__rows")).withColumn("__ahead", F.coalesce(F.sum("__rows").over(earlier), F.lit(0))).drop("__rows")
        number = F.row_number().over(Window.partitionBy("__mark", "__part").orderBy("__mark")) + F.col("__ahead")
        share = F.expr("__times div __n") + (number <= F.col("__times") % F.col("__n")).cast("long")
        equal = equal.join(parts, ["__mark", "__part"]).withColumn("__own", share).where("__own > 0")
        own = own.unionByName(equal.select(*[F.col(f"`{c}`") for c in own.columns]))
    repeated = own.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__own"))))
    return repeated.select(*[F.col(f"`{c}`") for c in docs.columns])


def order_key(doc_id: Column, text: Column, seed: int) -> Column:
    """The shuffle order: md5 of id and text, so that it does not depend on where a row lies."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit("")))))


def _copies(groups: DataFrame) -> DataFrame:
    """``groups``, each row ``n`` times over, numbered by ``copy``; a row of many copies is dealt to many tasks."""
    deal = F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(COPIES).cast("long"), F.col("n") - F.col("block") * COPIES)))
    few = groups.where(F.col("n") <= COPIES).withColumn("block", F.lit(0).cast("long"))
    many = groups.where(F.col("n") > COPIES).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {COPIES}")))).repartition("row", "block")
    return few.unionByName(many).withColumn("at", deal).withColumn("copy", F.col("block") * COPIES + F.col("at")).drop("block", "at")


def _mixed(docs: DataFrame, weights: tuple[int, ...], max_repeats: int, seed: int) -> DataFrame:
    rows = with_columns_of(docs, doc_id="bigint", text="string", source="string")
    rows = rows.select("doc_id", "source", word_count(F.col("text")).alias("size"), order_key(F.col("doc_id"), F.col("text"), seed).alias("key"))
    groups = rows.groupBy("doc_id", "source", "size", "key").agg(F.count("*").alias("n"))
    groups = cut(groups.withColumn("row", F.monotonically_increasing_id()))
    whole = F.col("size") * F.col("n")
    plan = cut(targets(groups.groupBy("source").agg(F.sum(whole).alias("source_size")), weights, max_repeats))
    digits = max(0, math.ceil(math.log(max(1, groups.count()) / BUCKET_ROWS, 16)))

    # running sums within each source, in two steps: the uniform key's first digits make buckets of bounded size
    dealt = groups.where("size > 0").withColumn("bucket", F.substring("key", 1, digits) if digits else F.lit(""))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = dealt.groupBy("source", "bucket").agg(F.sum(whole).alias("bucket_size"))
    buckets = buckets.withColumn("ahead", F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0))).drop("bucket_size")
    within = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = dealt.withColumn("within", F.sum(whole).over(within) - whole)
    summed = _join_null_safe(_join_null_safe(summed, buckets, ["source", "bucket"]), plan, ["source"])

    passes = F.explode(F.sequence(F.lit(0), F.lit(max_repeats - 1)))
    finish = (F.col("pass") * F.col("source_size") + F.col("ahead") + F.col("within") + F.col("copy") * F.col("size")) / F.col("weight")
    copies = _copies(summed).withColumn("pass", passes).select("row", "copy", "doc_id", "source", "key", "size", "pass", finish.alias("finish"))
    order = [F.col("finish"), F.col("source").asc_nulls_last(), F.col("key"), F.col("doc_id"), F.col("row"), F.col("copy"), F.col("pass")]
    copies = cut(copies.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))

    # one sum for each range of the sort: as many rows as shuffle partitions
    parts = copies.groupBy("part").agg(F.sum("size").alias("part_size"))
    parts = parts.withColumn("ahead", F.coalesce(F.sum("part_size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    budget = groups.agg(F.sum(whole).alias("budget")).first()["budget"] or 0
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    taken = copies.withColumn("inside", F.sum("size").over(inside)).join(F.broadcast(parts), "part")
    taken = taken.where(F.col("inside") + F.col("ahead") <= budget).groupBy("row", "copy").agg(F.sum("size").alias("taken"))
    out = _copies(_join_null_safe(groups, plan, ["source"])).join(taken, ["row", "copy"], "left")
    return out.select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"), "key")


def _join_null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    right = right.withColumnsRenamed({k: f"__{k}" for k in keys})
    on = reduce(and_, [left[k].eqNullSafe(right[f"__{k}"]) for k in keys])
    return left.join(right, on).drop(*[f"__{k}" for k in keys])


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP9_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('0|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, ''))) AS key
  FROM documents
), s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight, CAST(3 * source_size AS DOUBLE) AS most FROM s),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(weight) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
p AS (SELECT source, source_size, weight, least(most, coalesce((SELECT level FROM l WHERE most / weight >= level ORDER BY most / weight, source NULLS LAST LIMIT 1) * weight, most)) AS target FROM l),
c AS (SELECT d.*, sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, row ROWS UNBOUNDED PRECEDING) AS cum FROM d),
v AS (SELECT c.row, c.doc_id, c.source, c.key, c.size, e.pass, CAST(e.pass * p.source_size + c.cum AS DOUBLE) / p.weight AS finish
      FROM c JOIN p ON c.source IS NOT DISTINCT FROM p.source CROSS JOIN (SELECT unnest([0, 1, 2]) AS pass) e WHERE c.size > 0),
t AS (SELECT *, sum(size) OVER (ORDER BY finish, source NULLS LAST, key, doc_id, row, pass ROWS UNBOUNDED PRECEDING) AS total FROM v),
k AS (SELECT row, sum(size) AS taken FROM t WHERE total <= (SELECT sum(size) FROM d) GROUP BY row)
SELECT d.doc_id, d.source, d.size, p.source_size, p.target, CAST(coalesce(k.taken, 0) AS BIGINT) AS taken
FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source LEFT JOIN k USING (row)
"""
