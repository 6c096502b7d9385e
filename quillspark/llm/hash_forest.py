"""Approximate nearest neighbours by a hash-prefix forest (LSH forest on sorted arrays).

Each of TREES trees gives every vector a hash string of BITS signs of its products with random directions, orthogonal within a tree as
far as the width allows. The products are those of the vector's direction less the mean of all directions (of its length), an aggregate over all rows: about the
origin, vectors that have much in common would nearly all get one string, while distances, and with them the order of cosines, don't change with the centre. A tree is the sorted array of these strings. A query descends in every array to the rows that share its longest
prefix, and ascends in all trees at once: it shortens the prefix until the trees together hold enough rows. Besides its own prefix it
looks at those that differ in the bits whose products were nearest to 0, the likeliest ones of near vectors, up to PROBES of them in a tree.

How many rows a query looks at follows from the number N of rows, SOUGHT x N**POWER, and from nothing that depends on one size: the share
of the table falls as the table grows (one of fewer rows than that is looked at whole), and where a query's prefixes are crowded it goes deeper, not wider. There is no limit at which rows
are left out: a prefix that is looked at is looked at whole.

As Spark jobs: strings are dealt by tree and the first bits of the prefix to blocks of about BLOCK rows; a block that holds more (a tight
cluster) is salted. Queries, not rows, are copied to the blocks that their prefixes touch. In a first pass, over strings alone, blocks
count how many rows share each query's prefix at each depth; a small group for each query picks the depth. In the second, blocks score the
rows of the queries' prefixes and return the few that lead. Pairs of a query and a row never leave a task, but for those. The leaders are
scored again in double precision on the original numbers.

Vectors of one direction are one node with its smallest ids, as many as an answer can use, so a vector that a third of all rows share is
searched once. Nothing but the means is fitted; every row is indexed. Vectors of lengths beyond the WIDTHS most frequent ones are hashed about the origin. Recall is measured against brute force in the tests and the README.

Defined cases: vectors that are null, empty or zero, or hold null or non-finite components, and rows with a null id take no part; vectors
of another length than the query's are never near it; rows that repeat an id and its direction count once; candidates with the query's own
id never appear; ties go to the smaller id; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stages import cut, with_columns_of

TREES, BITS = 16, 60
#: Rows looked at over all trees: SOUGHT x N**POWER, at least LEAST_SOUGHT.
SOUGHT, POWER, LEAST_SOUGHT = 6.5, 0.7, 4000
#: Prefixes looked at in a tree, a power of two: flips of the log2(4 x PROBES) bits nearest to 0, cheapest first.
PROBES = 256
BLOCK = 4096
#: Pairs of a query and a row that are scored at once.
PAIRS = 100_000
QUERY_STEP, NEAREST = 50, 5
#: Lengths of vectors that have a centre of their own.
WIDTHS = 16
SEED = 7


def directions(tree: int, width: int, bits: int = BITS) -> np.ndarray:
    """width x bits: unit vectors of one tree."""
    rng = np.random.Generator(np.random.PCG64([SEED, tree, width]))
    found = [np.linalg.qr(rng.standard_normal((width, width)))[0] for _ in range(-(-bits // width))]
    return np.concatenate(found, axis=1)[:, :bits]


def sought_rows(n: int) -> int:
    return max(LEAST_SOUGHT, round(SOUGHT * n**POWER))


def distinct_directions(rows: DataFrame, nearest: int, query_step: int) -> DataFrame:
    """node, vector (scaled to a largest component of 1), ids (the smallest of its rows' ids, one more than an answer needs), asked: whether a query has it."""
    asked = rows.groupBy("vector").agg(F.max((F.pmod(F.col("vec_id"), F.lit(query_step)) == 0).cast("int")).alias("asked"))
    # ranks up to a constant are cut in the map tasks, so a common vector sends a few rows from each
    first = rows.withColumn("n", F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))).where(F.col("n") <= nearest + 1)
    ids = first.groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    return ids.join(asked, "vector").select(F.monotonically_increasing_id().alias("node"), "vector", "ids", (F.col("asked") == 1).alias("asked"))


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and ``vector``, its direction (scaled to a largest component of 1), of the rows that take part."""

    def scale(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pc.and_(batch.column(0).is_valid(), batch.column(1).is_valid()))
            for at, matrix in _by_width(batch.column(1)):
                if not matrix.shape[1]:
                    continue
                largest = np.abs(matrix).max(axis=1)
                fine = np.flatnonzero(np.isfinite(matrix).all(axis=1) & (largest > 0))
                matrix = matrix[fine] / largest[fine, None] + 0.0  # no negative zeros
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at[fine])), _lists(matrix)], ["vec_id", "vector"])

    rows = with_columns_of(vectors, vec_id="bigint", embedding="array<double>")
    return rows.mapInArrow(scale, "vec_id long, vector array<double>").dropDuplicates(["vec_id", "vector"])


def _by_width(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) for each length of vectors in a column without nulls; null components are NaN."""
    lengths = np.diff(column.offsets.to_numpy())
    for w in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == w)
        yield at, column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), w)


def _unit(matrix: np.ndarray) -> np.ndarray:
    return matrix / np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))


def _lists(matrix: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(matrix) + 1, dtype=np.int32) * matrix.shape[1]), pa.array(matrix.reshape(-1)))


def centres_of(nodes: DataFrame) -> dict[int, np.ndarray]:
    """The mean direction of the vectors of each of the WIDTHS most frequent lengths, in steps of 1e-6, so that the order of summing doesn't show."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, matrix in _by_width(batch.column(0)):
                w = matrix.shape[1]
                total[w] = total.get(w, np.zeros(w + 1)) + np.r_[len(matrix), _unit(matrix).sum(axis=0)]
        for w, x in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(w + 1, w, np.int32)), pa.array(np.arange(-1, w, dtype=np.int32)), pa.array(x)], names=["width", "pos", "x"])

    each = cut(nodes.select("vector").mapInArrow(sums, "width int, pos int, x double").groupBy("width", "pos").agg(F.sum("x").alias("x")))
    often = [r["width"] for r in each.where("pos = -1").orderBy(F.desc("x"), "width").limit(WIDTHS).collect()]
    rows = each.where(F.col("width").isin(often)).collect() if often else []
    found = {w: np.zeros(w + 1) for w in often}
    for r in rows:
        found[r["width"]][r["pos"] + 1] = r["x"]
    return {w: np.round(x[1:] / x[0], 6) for w, x in found.items()}


class Projections:
    """Products with the directions of every tree, about the centre, for many vectors at once."""

    def __init__(self, trees: int, centres: dict[int, np.ndarray]) -> None:
        self.trees, self.centres, self.known = trees, centres, {}

    def __call__(self, matrix: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(tree, products, codes) of the unit rows of ``matrix``; a code's first bit is the highest."""
        width = matrix.shape[1]
        if width in self.centres:
            matrix = matrix - self.centres[width]
        for t in range(self.trees):
            if (t, width) not in self.known:
                self.known[t, width] = directions(t, width)
            products = matrix @ self.known[t, width]
            yield t, products, (products > 0) @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))


def hash_strings(nodes: DataFrame, trees: int, centres: dict[int, np.ndarray], units: bool = False) -> DataFrame:
    """width, tree, code, node, asked and, if wanted, unit: one row for each node and tree."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        project = Projections(trees, centres)
        for batch in batches:
            for at, matrix in _by_width(batch.column(1)):
                matrix = _unit(matrix)
                own, unit = batch.take(pa.array(at)), [_lists(matrix.astype(np.float32))] if units else []
                for t, _, codes in project(matrix):
                    constant = [pa.array(np.full(len(at), x, np.int32)) for x in (matrix.shape[1], t)]
                    yield pa.RecordBatch.from_arrays([*constant, pa.array(codes), own.column(0), own.column(2), *unit], names=["width", "tree", "code", "node", "asked", "unit"][: 5 + units])

    return nodes.select("node", "vector", "asked").mapInArrow(hashed, "width int, tree int, code long, node long, asked boolean" + ", unit array<float>" * units)


def _prefix(code: Column | str, depth: int) -> Column:
    return F.shiftright(code, BITS - depth)


KEY = ["width", "tree", "block"]


def own_counts(strings: DataFrame, sizes: DataFrame, head: int) -> DataFrame:
    """node, tree and ``counts``, one row for each query, tree and salt: rows that share the first d bits, for every d of ``head`` or more."""
    salted = strings.join(sizes, KEY).select(*KEY, F.pmod(F.xxhash64("node"), "salts").alias("salt"), "code", "node", F.lit(False).alias("is_query"))
    asks = strings.where("asked").join(sizes, KEY).select(*KEY, F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), "code", "node", F.lit(True).alias("is_query"))

    def count(table: pa.Table) -> pa.Table:
        is_query = table["is_query"].to_numpy()
        code, node = table["code"].to_numpy(), table["node"].to_numpy()[is_query]
        rows, asked = np.sort(code[~is_query]), code[is_query]
        out = np.zeros((len(asked), BITS + 1), np.int64)
        for d in range(head, BITS + 1):
            low = asked >> (BITS - d) << (BITS - d)
            out[:, d] = np.searchsorted(rows, low + (1 << (BITS - d))) - np.searchsorted(rows, low)
        counts = pa.ListArray.from_arrays(pa.array(np.arange(len(asked) + 1, dtype=np.int32) * (BITS + 1)), pa.array(out.reshape(-1)))
        return pa.Table.from_arrays([pa.array(node), table["tree"].filter(table["is_query"]), counts], ["node", "tree", "counts"])

    return salted.union(asks).groupBy(*KEY, "salt").applyInArrow(count, "node long, tree int, counts array<long>")


def ascents(strings: DataFrame, sizes: DataFrame, head: int, sought: int, trees: int) -> DataFrame:
    """node, depth, probes for each query: the longest prefix whose rows, PROBES times over, are ``sought``, and how many prefixes it takes.

    A tree counts for four times its share at most, so that a crowd which one tree happens to put beside the query doesn't end the ascent.
    """
    deep = own_counts(strings, sizes, head).select("node", "tree", F.posexplode("counts").alias("depth", "n")).where(F.col("depth") >= head)
    asked = strings.where("asked").select("node", "width", "tree", "code")
    # shorter prefixes than the blocks': from the blocks' sizes, some thousandth of the rows
    levels = F.explode(F.sequence(F.lit(0), F.lit(head - 1))).alias("depth") if head else F.explode(F.array().cast("array<int>")).alias("depth")
    short = sizes.select("width", "tree", "block", "n", levels).groupBy("width", "tree", "depth", F.expr(f"shiftright(block, {head} - depth)").alias("prefix")).agg(F.sum("n").alias("n"))
    wanted = asked.select("node", "width", "tree", "code", levels).withColumn("prefix", F.expr(f"shiftright(code, {BITS} - depth)"))
    shallow = wanted.join(short, ["width", "tree", "depth", "prefix"]).select("node", "tree", "depth", "n")
    most_probes = F.least(F.lit(float(PROBES)), F.pow(F.lit(2.0), "depth"))
    of_tree = deep.union(shallow).groupBy("node", "depth", "tree").agg((F.sum("n") - 1).alias("n"))  # but for the query itself
    sums = of_tree.groupBy("node", "depth").agg(F.sum(F.least(F.col("n").cast("double"), F.lit(4.0 * sought / trees) / most_probes)).alias("n"))
    enough = F.when(F.col("n") * most_probes >= sought, F.struct("depth", "n"))
    chosen = sums.groupBy("node").agg(F.coalesce(F.max(enough), F.struct(F.lit(0).alias("depth"), F.lit(1.0).alias("n"))).alias("x"))
    many = F.least(F.lit(PROBES), F.pow(F.lit(2.0), "x.depth"), F.greatest(F.lit(1), F.ceil(F.lit(sought) / F.col("x.n"))))
    return chosen.select("node", "x.depth", many.cast("int").alias("probes"))


def likely_prefixes(products: np.ndarray, code: np.ndarray, depth: int, probes: int) -> np.ndarray:
    """For each row its ``probes`` likeliest prefixes of ``depth`` bits: flips of the bits nearest to 0, by the sum of their squared products."""
    own = code >> (BITS - depth) if depth else np.zeros_like(code)
    n_bits = min(depth, (4 * PROBES).bit_length() - 1, max(0, (4 * probes - 1).bit_length()))
    margin = products[:, :depth] ** 2
    bits = np.argsort(margin, axis=1, kind="stable")[:, :n_bits]
    cost, flip = np.zeros((len(code), 1)), np.zeros((len(code), 1), np.int64)
    for i in range(n_bits):
        b = bits[:, i]
        cost = np.concatenate([cost, cost + margin[np.arange(len(b)), b][:, None]], axis=1)
        flip = np.concatenate([flip, flip ^ (1 << (depth - 1 - b))[:, None]], axis=1)
    best = np.argsort(cost, axis=1, kind="stable")[:, :probes]
    return own[:, None] ^ np.take_along_axis(flip, best, axis=1)


def probes_of(queries: DataFrame, head: int, trees: int, centres: dict[int, np.ndarray]) -> DataFrame:
    """width, tree, block, depth, prefixes, node, unit: for each query (node, vector, depth, probes) the blocks it asks and its prefixes there."""
    schema = "width int, tree int, block long, depth int, prefixes array<long>, node long, unit array<float>"
    kind = pa.schema([("width", pa.int32()), ("tree", pa.int32()), ("block", pa.int64()), ("depth", pa.int32()), ("prefixes", pa.list_(pa.int64())), ("node", pa.int64()), ("unit", pa.list_(pa.float32()))])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        project = Projections(trees, centres)
        for batch in batches:
            depth, count = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            for at, matrix in _by_width(batch.column(1)):
                matrix = _unit(matrix)
                node, unit, width = batch.column(0).take(pa.array(at)), _lists(matrix.astype(np.float32)), matrix.shape[1]
                for t, products, code in project(matrix):
                    for d, n in sorted(set(zip(depth[at].tolist(), count[at].tolist(), strict=True))):
                        mine = np.flatnonzero((depth[at] == d) & (count[at] == n))
                        for some in np.array_split(mine, -(-len(mine) // 256)):
                            prefixes = likely_prefixes(products[some], code[some], d, n)
                            if d < head:  # a short prefix spans several blocks
                                prefixes = ((prefixes << (head - d))[:, :, None] + np.arange(1 << (head - d))).reshape(len(some), -1)
                            flat, owner = prefixes.reshape(-1), np.repeat(np.arange(len(some)), prefixes.shape[1])
                            block = flat >> max(0, d - head)
                            order = np.lexsort((flat, block, owner))
                            flat, owner, block = flat[order], owner[order], block[order]
                            first = np.flatnonzero(np.r_[True, (block[1:] != block[:-1]) | (owner[1:] != owner[:-1])])
                            lists = pa.ListArray.from_arrays(pa.array(np.r_[first, len(flat)].astype(np.int32)), pa.array(flat))
                            who = pa.array(some[owner[first]])
                            constant = [pa.array(np.full(len(first), x, np.int32)) for x in (width, t)]
                            yield pa.RecordBatch.from_arrays([*constant, pa.array(block[first]), pa.array(np.full(len(first), max(d, head), np.int32)), lists, node.take(who), unit.take(who)], schema=kind)

    return queries.select("node", "vector", "depth", "probes").mapInArrow(probe, schema)


def scored(strings: DataFrame, sizes: DataFrame, probes: DataFrame, leaders: int) -> DataFrame:
    """query, node, score: the rows of each block that lead among those of a query's prefixes there; ``places``, on one row of each, counts what was looked at."""
    rows = strings.join(sizes, KEY).select(*KEY, F.pmod(F.xxhash64("node"), "salts").alias("salt"), "code", "node", "unit", F.lit(None).cast("int").alias("depth"), F.lit(None).cast("array<long>").alias("prefixes"))
    asks = probes.join(sizes, KEY).select(*KEY, F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), F.lit(0).cast("long").alias("code"), "node", "unit", "depth", "prefixes")
    kind = pa.schema([("query", pa.int64()), ("node", pa.int64()), ("score", pa.float32()), ("places", pa.int64())])

    def matrix(column: pa.ChunkedArray) -> np.ndarray:
        flat = column.combine_chunks()
        return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)

    def score(table: pa.Table) -> pa.Table:
        is_row = pc.is_null(table["depth"])
        base, asked = table.filter(is_row), table.filter(pc.invert(is_row))
        if not len(base) or not len(asked):
            return kind.empty_table()
        base = base.sort_by("code")
        codes, nodes, units, wanted = base["code"].to_numpy(), base["node"].to_numpy(), matrix(base["unit"]), matrix(asked["unit"])
        lists = asked["prefixes"].combine_chunks()
        owner = np.repeat(np.arange(len(asked)), np.diff(lists.offsets.to_numpy()))
        shift = BITS - asked["depth"].to_numpy().astype(np.int64)[owner]
        prefix = lists.flatten().to_numpy()
        low, high = np.searchsorted(codes, prefix << shift), np.searchsorted(codes, (prefix + 1) << shift)
        full = np.flatnonzero(high > low)
        owner, low, length = owner[full], low[full], (high - low)[full]
        total = np.bincount(owner, length, minlength=len(asked)).astype(np.int64)
        queries, out = asked["node"].to_numpy(), []
        # whole queries at a time, by the pairs they bring
        ends, at = np.cumsum(total), 0
        while at < len(asked):
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
            a, b = np.searchsorted(owner, at), np.searchsorted(owner, stop)
            n = length[a:b]
            who = np.repeat(owner[a:b], n)
            row = np.repeat(low[a:b] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            found = np.concatenate([np.einsum("ij,ij->i", units[row[i : i + PAIRS]], wanted[who[i : i + PAIRS]]) for i in range(0, len(row), PAIRS)] or [np.zeros(0, np.float32)])
            order = np.lexsort((nodes[row], -found, who))
            rank = np.arange(len(order)) - np.searchsorted(who, who)  # ``who`` is in order
            kept = rank < leaders
            order, rank = order[kept], rank[kept]
            out.append((queries[who[order]], nodes[row[order]], found[order], np.where(rank == 0, total[who[order]], 0)))
            at = stop
        return pa.Table.from_arrays([pa.array(np.concatenate([x[i] for x in out]), f.type) for i, f in enumerate(kind)], schema=kind)

    return rows.union(asks).groupBy(*KEY, "salt").applyInArrow(score, "query long, node long, score float, places long")


def looked_at(nodes: DataFrame, nearest: int = NEAREST, trees: int = TREES, sought: int | None = None, block: int = BLOCK) -> DataFrame:
    """What ``scored`` returns for the queries among ``nodes`` (node, vector, asked)."""
    n = nodes.count()
    sought = sought or sought_rows(n)
    whole = sought >= n  # one tree, looked at from its root, holds every row
    trees = 1 if whole else trees
    head = max(0, math.ceil(math.log2(max(1, n) / block)))
    centres = centres_of(nodes)
    strings = cut(hash_strings(nodes, trees, centres).withColumn("block", _prefix("code", head)))
    sizes = cut(strings.groupBy(*KEY).agg(F.count("*").alias("n")).withColumn("salts", F.ceil(F.col("n") / (4 * block))))
    if whole:
        plans = strings.where("asked").select("node", F.lit(0).alias("depth"), F.lit(1).alias("probes"))
    else:
        plans = cut(ascents(strings, sizes.select(*KEY, "n", "salts"), head, sought, trees))
    queries = nodes.join(plans, "node")
    with_units = hash_strings(nodes, trees, centres, units=True).withColumn("block", _prefix("code", head))  # made again: kept once for each tree, they would be the most of what is stored
    return scored(with_units, sizes.select(*KEY, "salts"), probes_of(queries, head, trees, centres), 2 * (nearest + 1))


def _cosine(a: str, b: str) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda s, t: s * t), F.lit(0.0), lambda s, t: s + t)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def nearest_neighbours(vectors: DataFrame, query_step: int = QUERY_STEP, nearest: int = NEAREST, trees: int = TREES, sought: int | None = None, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the ``nearest`` found of every row whose vec_id ``query_step`` divides.

    ``sought`` rows are looked at for a query, over all trees; None: as many as ``sought_rows`` says.
    """
    rows = usable(vectors)
    nodes = cut(distinct_directions(rows, nearest, query_step))
    found = looked_at(nodes, nearest, trees, sought, block).groupBy("query", "node").agg(F.max("score").alias("score"))
    # four times as many as are needed, for what single precision cannot tell apart
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), "node")
    few = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= 4 * (nearest + 1)).select("query", "node")
    few = few.join(nodes.where("asked").select(F.col("node").alias("query"), F.col("vector").alias("wanted")), "query").join(nodes.select("node", "vector", "ids"), "node")
    hits = few.select("query", "ids", _cosine("wanted", "vector").alias("score")).select("query", "score", F.explode("ids").alias("vec_id"))
    listed = F.transform(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("far"), "vec_id"))), lambda x: F.struct(x["vec_id"].alias("vec_id"), (-x["far"]).alias("score")))
    best = cut(hits.groupBy("query").agg(F.slice(listed, 1, nearest + 1).alias("best")))  # at most 4 x (nearest + 1)**2 of a query
    # queries by their vector: those that share one are many rows of one node, so the join may be split
    own = rows.where(F.pmod(F.col("vec_id"), F.lit(query_step)) == 0).join(nodes.where("asked").select("vector", "node"), "vector").select("vec_id", "node")
    answers = own.join(best, own["node"] == best["query"]).select(F.col("vec_id").alias("query_id"), F.filter("best", lambda x: x["vec_id"] != F.col("vec_id")).alias("best"))
    ranked = answers.select("query_id", F.posexplode(F.slice("best", 1, nearest)).alias("pos", "hit"))
    return ranked.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score"))


def op4_hash_forest(spark, sf_dir: str) -> DataFrame:
    return nearest_neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
