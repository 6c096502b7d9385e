"""Merkle manifest of a dataset: every row a leaf, a tree for each group, a tree over the groups, and a proof for each row.

The leaves are sorted by range over (group, order), so a group of any size lies over as many partitions as its rows fill. One count for
each group and partition gives the place of a partition's first leaf within its group. Each partition then builds all subtrees that lie
wholly within it and are aligned to the whole group; what is left over at its ragged ends, a few nodes for each level, is shuffled by
coordinate (group, level, place) and finished in strides of STRIDE levels, so a task never holds more than FAN ** STRIDE nodes of one
subtree. The subtrees' roots are the leaves of the tree over the groups, which is built in the same way. Last, the paths found for the
subtrees of a partition are sent to its leaves, by the partition's number.

A partition holds about LEAVES leaves as digests. Broadcast is one table: the groups that reach beyond their partition, two rows for
each partition at most.

Defined cases: a null value is hashed as ``-``, so it differs from every text; null groups form a group, first in order; null in the order
column comes first; rows equal in group and order are ordered by their leaf (equal leaves can change places without a trace);
an empty table gives an empty result; other columns are ignored. A table of one row has its leaf as root and an empty proof.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stages import cut, with_columns_of

FAN, STRIDE = 3, 6
LEAVES = 100_000
#: Rows of a batch that goes back to Spark, with a path of some kilobytes each.
BATCH = 2048
STEPS = "array<struct<before:string,after:string>>"
NODE = "gkey string, level int, place long, node string, total long"


def value(column: Column) -> Column:
    """``column`` as it is hashed: its UTF-8 byte count, ``:`` and itself; ``-`` for null."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*parts: Column) -> Column:
    """Lower-case hexadecimal SHA-256 of the parts, one after the other."""
    return F.sha2(F.concat(*parts) if len(parts) > 1 else parts[0], 256)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that ``leaf`` and the siblings of ``proof`` lead to."""
    return F.aggregate(proof, leaf, lambda node, step: digest(step["before"], node, step["after"]))


def siblings(proof: Column) -> Column:
    """The digests of ``proof``, level by level, left to right, as one text."""
    return F.array_join(F.transform(proof, lambda step: F.concat(step["before"], step["after"])), "")


def parent(children: list[str]) -> str:
    return hashlib.sha256("".join(children).encode()).hexdigest()


def height(total: int) -> int:
    levels = 0
    while total > 1:
        total, levels = -(-total // FAN), levels + 1
    return levels


def climb(leaves: list[str], first: int, total: int) -> tuple[list[tuple[int, list[str]]], list[tuple[int, int, str]]]:
    """All nodes over ``leaves``, from the ``first`` of ``total`` on: by level (first place, nodes), and those without a parent here: (level, place, node)."""
    levels, tops, level = [(first, leaves)], [], 0
    while total > 1:
        end, nodes = first + len(levels[-1][1]), levels[-1][1]
        low, high = -(-first // FAN), end // FAN if end < total else -(-total // FAN)
        if high <= low:
            return levels, tops + [(level, first + i, x) for i, x in enumerate(nodes)]
        inner, outer = FAN * low - first, min(FAN * high, end) - first
        tops += [(level, first + i, nodes[i]) for i in (*range(inner), *range(outer, len(nodes)))]
        first, total, level = low, -(-total // FAN), level + 1
        levels.append((low, [parent(nodes[i : min(i + FAN, outer)]) for i in range(inner, outer, FAN)]))
    return levels, tops + [(level, first + i, x) for i, x in enumerate(levels[-1][1])]


def step(nodes: list[str], first: int, place: int) -> dict[str, str]:
    """The siblings of the node at ``place``, before and after it; ``nodes`` holds its whole run."""
    low, i = FAN * (place // FAN) - first, place - first
    return {"before": "".join(nodes[low:i]), "after": "".join(nodes[i + 1 : low + FAN])}


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, list]]:
    """Runs of rows of one (part, gkey), as lists; the rows come ordered by them."""
    now, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            key = (row["part"], row["gkey"])
            if key != now and held:
                yield held
                held = []
            now = key
            held.append(row)
    if held:
        yield held


def _placed(rows: DataFrame) -> tuple[DataFrame, DataFrame, int, int]:
    """``rows`` (group, order, leaf, ...) with gkey, ``at`` and ``part``, sorted by range; the groups that reach beyond a part; numbers of parts and levels."""
    rows = cut(rows.withColumn("gkey", value(F.col("group"))).withColumn("row", F.monotonically_increasing_id()))
    n = rows.count()
    parts = max(1, min(n, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), n // LEAVES + 1)
    by = [F.col("group").asc_nulls_first(), F.col("order").asc_nulls_first(), F.col("leaf"), F.col("row")]
    placed = rows.repartitionByRange(parts, *by).sortWithinPartitions(*by).drop("row").withColumn("at", F.monotonically_increasing_id())
    placed = cut(placed.withColumn("part", F.shiftright("at", 33).cast("int")))
    every = Window.partitionBy("gkey")
    counts = placed.groupBy("gkey", "part").agg(F.count("*").alias("n"))
    counts = counts.withColumn("total", F.sum("n").over(every)).withColumn("first", F.sum("n").over(every.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    counts = cut(counts.withColumn("first", F.coalesce("first", F.lit(0).cast("long"))))
    most = counts.agg(F.max("total").alias("total"), F.max("part").alias("part")).first()
    return placed, counts.where("total > n").select("gkey", "part", "first", "total"), (most["part"] or 0) + 1, height(most["total"] or 0)


def _within(placed: DataFrame, wide: DataFrame) -> DataFrame:
    return placed.join(F.broadcast(wide), ["gkey", "part"], "left")


def _tops(placed: DataFrame, wide: DataFrame) -> DataFrame:
    """The nodes that a part can build on its own and whose parent it can't: NODE and part."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for run in _grouped(batches):
            total = run[0]["total"] or len(run)
            _, tops = climb([r["leaf"].hex() for r in run], run[0]["first"] or 0, total)
            out += [{"gkey": run[0]["gkey"], "level": lv, "place": p, "node": x, "total": total, "part": run[0]["part"]} for lv, p, x in tops]
            if len(out) >= BATCH:
                yield pa.RecordBatch.from_pylist(out, schema=kind)
                out = []
        yield pa.RecordBatch.from_pylist(out, schema=kind)

    kind = pa.schema([("gkey", pa.string()), ("level", pa.int32()), ("place", pa.int64()), ("node", pa.string()), ("total", pa.int64()), ("part", pa.int32())])
    return cut(_within(placed, wide).select("part", "gkey", "first", "total", "leaf").mapInArrow(build, f"{NODE}, part int"))


def _finished(nodes: DataFrame, level: int) -> DataFrame:
    """Each of ``nodes`` (below ``level``) with its ``proof`` up to that level, or up to the root, and the node there (up_level, up_place, up_node); ``lead`` is one row of those."""
    columns = ["gkey", "level", "place", "node", "total", "part", "proof", "up_level", "up_place", "up_node", "lead"]

    def finish(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["level", "place"], ignore_index=True)
        total, gkey = int(rows["total"][0]), rows["gkey"][0]
        given: dict[int, dict[int, str]] = {}
        for lv, p, x in zip(rows["level"], rows["place"], rows["node"], strict=True):
            given.setdefault(int(lv), {})[int(p)] = x
        top, count, lv, built = min(level, height(total)), total, 0, {}
        for lv in range(top):
            built[lv] = built.get(lv, {}) | given.get(lv, {})
            for p in sorted({p // FAN for p in built[lv]}):
                built.setdefault(lv + 1, {})[p] = parent([built[lv][c] for c in range(FAN * p, min(FAN * p + FAN, count))])
            count = -(-count // FAN)
        (up, node), proofs = next(iter(built[top].items())), {(top, next(iter(built[top]))): []}
        for lv in reversed(range(top)):
            for p in built[lv]:
                run = [built[lv].get(c, "") for c in range(FAN * (p // FAN), FAN * (p // FAN) + FAN)]
                proofs[lv, p] = [step(run, FAN * (p // FAN), p), *proofs[lv + 1, p // FAN]]
        out = [(gkey, lv, p, x, total, part, proofs[lv, p], top, up, node, i == 0) for i, (lv, p, x, part) in enumerate(zip(rows["level"], rows["place"], rows["node"], rows["part"], strict=True))]
        return pd.DataFrame(out, columns=columns)

    span = F.lit(FAN**level).cast("long")
    bucket = F.floor(F.col("place") * F.pow(F.lit(FAN), F.col("level")).cast("long") / span) if level < 30 else F.lit(0)
    schema = f"{NODE}, part int, proof {STEPS}, up_level int, up_place long, up_node string, lead boolean"
    return nodes.withColumn("bucket", bucket).groupBy("gkey", "bucket").applyInPandas(finish, schema)


def _paths(tops: DataFrame, levels: int) -> tuple[DataFrame, DataFrame]:
    """gkey, part, level, place, proof, subroot for each of ``tops``; and gkey, subroot for each group."""
    done = tops.where(tops["level"] == _height(F.col("total")))
    nodes, rounds = tops.where(tops["level"] < _height(F.col("total"))), []
    for level in range(STRIDE, levels + STRIDE, STRIDE):
        links = cut(_finished(nodes.where(F.col("level") < level), level))
        rounds.append(links)
        made = links.where(F.col("lead") & (F.col("up_level") < _height(F.col("total"))))
        made = made.select("gkey", F.col("up_level").alias("level"), F.col("up_place").alias("place"), F.col("up_node").alias("node"), "total", F.lit(-1).alias("part"))
        nodes = nodes.where(F.col("level") >= level).unionByName(made)
    empty = F.array().cast(STEPS)
    paths = done.select("gkey", "part", "level", "place", empty.alias("proof"), F.col("node").alias("subroot"))
    roots, above = done.select("gkey", F.col("node").alias("subroot")), None
    for links in reversed(rounds):
        ends = links.where(F.col("up_level") == _height(F.col("total")))
        roots = roots.unionByName(ends.where("lead").select("gkey", F.col("up_node").alias("subroot")))
        found = ends.select("gkey", "part", "level", "place", "proof", F.col("up_node").alias("subroot"))
        if above is not None:
            upper = above.select("gkey", F.col("level").alias("up_level"), F.col("place").alias("up_place"), F.col("proof").alias("upper"), "subroot")
            inner = links.where(F.col("up_level") < _height(F.col("total"))).join(upper, ["gkey", "up_level", "up_place"])
            found = found.unionByName(inner.select("gkey", "part", "level", "place", F.concat("proof", "upper").alias("proof"), "subroot"))
        above = cut(found)
        paths = paths.unionByName(above.where("part >= 0"))
    return cut(paths), cut(roots)


def _height(total: Column) -> Column:
    """Levels over ``total`` leaves."""
    powers = F.array(*[F.lit(FAN**k).cast("long") for k in range(40)])
    return F.size(F.filter(powers, lambda p: p < total))


def _proofs(placed: DataFrame, wide: DataFrame, paths: DataFrame, parts: int, keep: list[str]) -> DataFrame:
    """``keep`` columns, leaf, proof, subroot, root of each row of ``placed``; ``paths`` has them for the tops of each part."""
    leaves = _within(placed, wide).select("part", F.lit(1).alias("kind"), "at", "gkey", "first", "total", "leaf", F.struct(*keep).alias("kept"))
    tops = paths.select("part", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("at"), "gkey", F.struct("level", "place", "proof", "subroot", "root").alias("top"))
    both = leaves.unionByName(tops, allowMissingColumns=True).repartitionById(parts, F.col("part"))
    both = both.sortWithinPartitions("part", "gkey", "kind", "at")
    kinds = dict(placed.dtypes)
    schema = f"kept struct<{','.join(f'{c}:{kinds[c]}' for c in keep)}>, leaf string, proof {STEPS}, subroot string, root string"

    def attach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _grouped(batches):
            tops = {(r["top"]["level"], r["top"]["place"]): r["top"] for r in run if r["kind"] == 0}
            rows = [r for r in run if r["kind"] == 1]
            first = rows[0]["first"] or 0
            levels, _ = climb([r["leaf"].hex() for r in rows], first, rows[0]["total"] or len(rows))
            known: dict[tuple[int, int], tuple[list, dict]] = {}

            def path(level: int, place: int, tops=tops, levels=levels, known=known) -> tuple[list, dict]:
                if (level, place) in tops:
                    return tops[level, place]["proof"], tops[level, place]
                if (level, place) not in known:
                    steps, top = path(level + 1, place // FAN)
                    known[level, place] = [step(levels[level][1], levels[level][0], place), *steps], top
                return known[level, place]

            for begin in range(0, len(rows), BATCH):
                out = []
                for i, r in enumerate(rows[begin : begin + BATCH], first + begin):
                    steps, top = path(0, i)
                    known.pop((0, i), None)
                    out.append((r["kept"], r["leaf"].hex(), steps, top["subroot"], top["root"]))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out, strict=True), types, strict=True)], names=names)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    found = to_arrow_schema(_parse_datatype_string(schema))
    names, types = found.names, found.types
    return both.mapInArrow(attach, schema).select("kept.*", "leaf", "proof", "subroot", "root")


def manifest(rows: DataFrame, group: str, order: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """group, order, the ``keep`` columns, leaf, proof, subroot and root for each of ``rows``, which hold their digest as ``leaf``.

    ``proof`` is the way from the leaf to the root: for each level the siblings before and after the node, as one text each;
    ``folded(leaf, proof)`` is the root. ``group`` is a text column; leaves of a group ascend by ``order``.
    """
    rows = rows.select(F.col(f"`{group}`").cast("string").alias("group"), F.col(f"`{order}`").alias("order"), F.unhex("leaf").alias("leaf"), *[F.col(f"`{c}`").alias(f"keep_{i}") for i, c in enumerate(keep)])
    placed, wide, parts, levels = _placed(rows)
    paths, roots = _paths(_tops(placed, wide), levels)
    names = placed.select("group", "gkey").distinct()
    over = roots.join(names, "gkey").select(F.lit("").alias("group"), F.col("group").alias("order"), F.unhex("subroot").alias("leaf"), F.col("gkey").alias("of"))
    top_placed, top_wide, top_parts, top_levels = _placed(over)
    top_paths, top_roots = _paths(_tops(top_placed, top_wide), top_levels)
    top_paths = top_paths.withColumn("root", F.col("subroot"))
    upper = cut(_proofs(top_placed, top_wide, top_paths, top_parts, ["of"]).select(F.col("of").alias("gkey"), F.col("proof").alias("upper"), "root"))
    paths = paths.join(upper, "gkey").withColumn("proof", F.concat("proof", "upper")).drop("upper")
    found = _proofs(placed, wide, paths, parts, ["group", "order", *[f"keep_{i}" for i in range(len(keep))]])
    return found.withColumnsRenamed({"group": group, "order": order} | {f"keep_{i}": c for i, c in enumerate(keep)})


def document_leaf(text: Column) -> Column:
    return digest(*[value(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")], value(text))


def op12_merkle(spark, sf_dir: str) -> DataFrame:
    docs = with_columns_of(spark.read.parquet(f"{sf_dir}/documents.parquet"), doc_id="bigint", text="string", lang="string", source="string", n_chars="bigint")
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False)) & F.contains("text", F.lit("\n"))
    leaf = document_leaf(F.col("text"))
    altered = F.when(hit, F.unhex(document_leaf(F.replace(F.col("text"), F.lit("\n"), F.lit("")))))
    found = manifest(docs.select("doc_id", "source", leaf.alias("leaf"), altered.alias("altered")), "source", "doc_id", ("altered",))
    now = F.coalesce(F.lower(F.hex("altered")), F.col("leaf"))
    found = found.select("doc_id", "leaf", "subroot", "root", digest(siblings(F.col("proof"))).alias("proof_sha256"), folded(now, F.col("proof")).alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


OP12_SQL = r"""
WITH RECURSIVE crc_table AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)) AS c
    FROM (SELECT CAST(range AS BIGINT) AS i FROM range(256)))
), values_of AS (
  SELECT row_number() OVER () AS row, doc_id, source, text,
         coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
         || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head,
         list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
                     lambda c, b: xor(c >> 8, t[CAST(xor(c, b) & 255 AS INTEGER) + 1])) AS crc
  FROM documents CROSS JOIN crc_table
), leaves AS (
  SELECT row, doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         CASE WHEN xor(crc, 4294967295) % 2 = 0 AND text IS NOT NULL
              THEN sha256(head || strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), '')) END AS altered
  FROM values_of
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY source) AS total FROM leaves
), nodes AS (
  SELECT source, 0 AS level, place, leaf AS node, total FROM placed
  UNION ALL
  SELECT source, level + 1, place // 3, sha256(string_agg(node, '' ORDER BY place)), (total + 2) // 3
  FROM (SELECT * FROM nodes WHERE total > 1) GROUP BY source, level, place // 3, total
), subroots AS (SELECT source, level AS height, node AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place, count(*) OVER () AS total FROM nodes WHERE total = 1),
upper AS (
  SELECT 0 AS level, place, subroot AS node, total FROM subroots
  UNION ALL
  SELECT level + 1, place // 3, sha256(string_agg(node, '' ORDER BY place)), (total + 2) // 3 FROM (SELECT * FROM upper WHERE total > 1) GROUP BY level, place // 3, total
), ways AS (
  SELECT p.row, n.level, coalesce(string_agg(n.node, '' ORDER BY n.place) FILTER (WHERE n.place < p.place // CAST(pow(3, n.level) AS BIGINT)), '') AS before,
         coalesce(string_agg(n.node, '' ORDER BY n.place) FILTER (WHERE n.place > p.place // CAST(pow(3, n.level) AS BIGINT)), '') AS after
  FROM placed p JOIN nodes n ON n.source IS NOT DISTINCT FROM p.source AND n.total > 1 AND n.place // 3 = p.place // CAST(pow(3, n.level + 1) AS BIGINT)
  GROUP BY p.row, n.level
  UNION ALL
  SELECT p.row, s.height + n.level, coalesce(string_agg(n.node, '' ORDER BY n.place) FILTER (WHERE n.place < s.place // CAST(pow(3, n.level) AS BIGINT)), ''),
         coalesce(string_agg(n.node, '' ORDER BY n.place) FILTER (WHERE n.place > s.place // CAST(pow(3, n.level) AS BIGINT)), '')
  FROM placed p JOIN subroots s ON s.source IS NOT DISTINCT FROM p.source JOIN upper n ON n.total > 1 AND n.place // 3 = s.place // CAST(pow(3, n.level + 1) AS BIGINT)
  GROUP BY p.row, s.height, n.level
), proofs AS (
  SELECT row, list({b: before, a: after} ORDER BY level) AS way, string_agg(before || after, '' ORDER BY level) AS siblings FROM ways GROUP BY row
), folds AS (
  SELECT p.row, 0 AS level, coalesce(altered, leaf) AS node, coalesce(way, []) AS way, coalesce(siblings, '') AS siblings FROM placed p LEFT JOIN proofs USING (row)
  UNION ALL
  SELECT row, level + 1, sha256(way[level + 1].b || node || way[level + 1].a), way, siblings FROM folds WHERE level < len(way)
), ends AS (SELECT row, node, siblings FROM folds WHERE level = len(way)),
root AS (SELECT node FROM upper WHERE total = 1)
SELECT p.doc_id, p.leaf, s.subroot, r.node AS root, sha256(e.siblings) AS proof_sha256, e.node AS folded_root, e.node = r.node AS verified
FROM placed p JOIN subroots s ON s.source IS NOT DISTINCT FROM p.source JOIN ends e USING (row) CROSS JOIN root r
"""
