"""Near-duplicate documents by improved consistent weighted sampling over TF-IDF shingles.

A shingle is a run of five words; its weight in a document is its count times its idf, the mean idf of its words.
Document frequencies are counted over all documents, by word, in a table of fixed size (words share entries by hash):
it is small enough to broadcast at any size of the corpus, and a large group of copies can't weigh its own shared
shingles down against the few that its members differ in, as frequencies by shingle would.

Ioffe's improved consistent weighted sampling draws, for each of BANDS x ROWS hash functions, a (shingle, level) pair
with the property that two documents draw the same with a probability of their weighted Jaccard similarity. Rows make
band keys; documents that share one are candidates.

Equal word sequences are one node, so copies never meet as candidates. In each bucket all nodes are compared with its
centre (a star): the node that shares most bands with others, so that of a text and its variants the text is the centre. The
pairs are verified by the weighted Jaccard similarity of the whole texts. Verified links are joined into classes by
contraction. Where a bucket's nodes then are in one class it is done. In the others every node outside its centre's class is
compared, block by block, with all others of the bucket but those it is joined to and those that bounds prove less similar:
one minus the similarity is a metric, so two nodes whose distances from the centre differ by more than that of two similar
ones can't be similar, nor can nodes whose total weights differ too much. So a group of variants around a text takes linear work, no
candidate is given up, and the classes are those of all candidate pairs; a group of many texts that share buckets without
being similar costs comparisons as the square of its size.

Defined cases: null counts as empty; texts of fewer than five words have one shingle, of all their words; texts
without words are one class; a row with a null doc_id is a class by itself with a null class_id; repeated rows fall
in one class; an id that has several texts belongs, row by row, to the classes of those texts; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stages import cut, spread, with_columns_of, written
from .words import Words, by_bytes, mix, words_of

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 16, 5
BLOCK, BLOCK_BYTES = 256, 4 << 20
#: Room for the rounding of similarities where their bounds leave a pair out.
SLACK = 1e-6
DF_BITS = 18
TABLE_BITS = 16
_OFFSET = np.float32(128)


def document_frequencies(docs: DataFrame) -> np.ndarray:
    """How many texts have a word of each of 2**DF_BITS hash values; the last entry is the number of texts."""
    rows = with_columns_of(docs, text="string")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((1 << DF_BITS) + 1, np.int64)
        for batch in batches:
            for a, b in by_bytes(batch.column(0)):
                _, _, words = words_of(batch.column(0)[a:b])
                both = np.unique((words.doc.astype(np.int64) << DF_BITS) | (words.hash >> np.uint64(64 - DF_BITS)).astype(np.int64))
                total += np.bincount(both & ((1 << DF_BITS) - 1), minlength=len(total))
                total[-1] += b - a
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["entry", "n"])

    table = rows.mapInArrow(count, "entry int, n long").groupBy("entry").agg(F.sum("n").alias("n")).toArrow()  # 2**DF_BITS + 1 rows at most
    out = np.zeros((1 << DF_BITS) + 1, np.int64)
    out[table.column("entry").to_numpy()] = table.column("n").to_numpy()
    return out


def idf_table(frequencies: np.ndarray) -> np.ndarray:
    return (np.log((1.0 + frequencies[-1]) / (1.0 + frequencies[:-1])) + 1).astype(np.float32)


def weighted_shingles(words: Words, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles in order, their weights, and where each text's begin (with the end)."""
    n_docs, h = len(words.first) - 1, words.hash
    each = idf[(h >> np.uint64(64 - DF_BITS)).astype(np.int64)]
    per_doc = np.diff(words.first)
    m = max(0, len(h) - SHINGLE + 1)
    code, weight = np.zeros(m, np.uint64), np.zeros(m, np.float32)
    for i in range(SHINGLE):
        code = code * np.uint64(0xD6E8FEB86659FD93) + h[i : i + m]
        weight += each[i : i + m]
    doc = words.doc
    inside = doc[:m] == doc[SHINGLE - 1 : SHINGLE - 1 + m]
    code, weight, owner = mix(code[inside]), weight[inside] / SHINGLE, doc[:m][inside]
    short = np.flatnonzero((per_doc > 0) & (per_doc < SHINGLE))
    if len(short):
        extra = []
        for d in short:
            a, b, c = words.first[d], words.first[d + 1], np.uint64(0)
            with np.errstate(over="ignore"):
                for x in h[a:b]:
                    c = c * np.uint64(0xD6E8FEB86659FD93) + x
            extra.append((c, each[a:b].mean()))
        code = np.r_[code, mix(np.array([c for c, _ in extra], np.uint64))]
        weight, owner = np.r_[weight, np.array([w for _, w in extra], np.float32)], np.r_[owner, short]
    order = np.lexsort((code, owner))
    code, weight, owner = code[order], weight[order], owner[order]
    new = np.r_[True, (code[1:] != code[:-1]) | (owner[1:] != owner[:-1])] if len(code) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    times = np.diff(np.r_[at, len(code)])
    return code[at], weight[at].astype(np.float64) * times, np.searchsorted(owner[at], np.arange(n_docs + 1))


@lru_cache(maxsize=1)
def _variates() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Variates of the sampling by hash value (r, 1/r, beta, ln c), and odd multipliers for each hash function."""
    rng = np.random.Generator(np.random.PCG64(20))
    r, c = rng.gamma(2.0, 1.0, 1 << TABLE_BITS), rng.gamma(2.0, 1.0, 1 << TABLE_BITS)
    table = np.stack([r, 1 / r, rng.random(1 << TABLE_BITS), np.log(c)]).astype(np.float32)
    odd = rng.integers(0, 1 << 63, (2, BANDS * ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return table, odd[0], odd[1]


def samples(code: np.ndarray, weight: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 32-bit name of the drawn (shingle, level) for each text with shingles and each hash function."""
    (r, r_inverse, beta, log_c), odd, odd_2 = _variates()
    log_w = np.log(weight).astype(np.float32)
    out = np.empty((len(first) - 1, BANDS * ROWS), np.uint32)
    for k in range(BANDS * ROWS):
        m = code * odd[k]
        i = (m >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
        shift = beta[i]
        level = np.floor(log_w * r_inverse[i] + shift)
        log_a = log_c[i] - r[i] * (level - shift + np.float32(1))
        # the order of positive floats is that of their bits; the name below decides between equals, alike everywhere
        key = np.maximum(log_a + _OFFSET, np.float32(0)).view(np.uint32).astype(np.uint64)
        name = ((m ^ (level.astype(np.int64).view(np.uint64) * np.uint64(0x9FB21C651E98DF25))) * odd_2[k]) >> np.uint64(32)
        out[:, k] = np.minimum.reduceat((key << np.uint64(32)) | name, first[:-1]).astype(np.uint32)
    return out


def band_keys(names: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of each text."""
    grouped = names.reshape(len(names), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(names), BANDS)).copy()
    for i in range(ROWS):
        key = mix(key * np.uint64(0xA0761D6478BD642F) + grouped[:, :, i])
    return key.view(np.int64)


def same_words(words: Words) -> list[bytes]:
    import xxhash

    data = memoryview(np.ascontiguousarray(words.hash)).cast("B")
    return [xxhash.xxh3_128_digest(data[8 * a : 8 * b]) for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True)]


def signatures(docs: DataFrame, idf: Broadcast) -> DataFrame:
    """doc_id, same (a name of the word sequence) and bands, empty for texts without words."""
    rows = with_columns_of(docs, doc_id="bigint", text="string")

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in by_bytes(batch.column(1)):
                _, _, words = words_of(batch.column(1)[a:b])
                code, weight, first = weighted_shingles(words, idf.value)
                has = np.flatnonzero(np.diff(first))
                counts = np.zeros(b - a + 1, np.int32)
                keys = np.zeros(0, np.int64)
                if len(has):
                    keys = band_keys(samples(code, weight, np.r_[first[has], first[-1]])).reshape(-1)
                    counts[has + 1] = BANDS
                bands = pa.ListArray.from_arrays(pa.array(np.cumsum(counts, dtype=np.int32)), pa.array(keys))
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(same_words(words), pa.binary()), bands], ["doc_id", "same", "bands"])

    return rows.mapInArrow(sign, "doc_id long, same binary, bands array<long>")


def weighted_jaccard(code_a: np.ndarray, weight_a: np.ndarray, code_b: np.ndarray, weight_b: np.ndarray) -> float:
    """Sum of the smaller weights over the sum of the larger; both codes distinct and in order."""
    at = np.minimum(np.searchsorted(code_b, code_a), max(0, len(code_b) - 1))
    met = code_b[at] == code_a if len(code_b) else np.zeros(len(code_a), bool)
    common = np.minimum(weight_a[met], weight_b[at[met]]).sum()
    total = weight_a.sum() + weight_b.sum() - common
    return float(common / total) if total else 0.0


def _texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node and text for each row of ``wanted`` (node, same, doc_id)."""
    rows = with_columns_of(docs, doc_id="bigint", text="string")

    def only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in by_bytes(batch.column(2)):
                part = batch.slice(a, b - a)
                right = pa.array([x == y for x, y in zip(same_words(words_of(part.column(2))[2]), part.column(1).to_pylist(), strict=True)])
                yield pa.RecordBatch.from_arrays([part.column(0).filter(right), part.column(2).filter(right)], ["node", "text"])

    found = wanted.join(spread(rows), "doc_id").select("node", "same", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(only, "node long, text string")
    return cut(found.dropDuplicates(["node"]))


def verified(links: DataFrame, texts: DataFrame, idf: Broadcast) -> DataFrame:
    """``links`` (a, b) with their weighted Jaccard similarity."""
    left, right = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y in by_bytes(batch.column(2)):
                part, scores = batch.slice(x, y - x), []
                sides = [weighted_shingles(words_of(part.column(i))[2], idf.value) for i in (2, 3)]
                for i in range(y - x):
                    (ca, wa, fa), (cb, wb, fb) = sides
                    scores.append(weighted_jaccard(ca[fa[i] : fa[i + 1]], wa[fa[i] : fa[i + 1]], cb[fb[i] : fb[i + 1]], wb[fb[i] : fb[i + 1]]))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(scores, pa.float64())], ["a", "b", "similarity"])

    joined = links.join(spread(left), "a").join(spread(right), "b").select("a", "b", "text_a", "text_b")
    return joined.mapInArrow(compare, "a long, b long, similarity double")


def components(edges: DataFrame) -> DataFrame:
    """node and root, a node of its component, for every node of ``edges`` (a, b).

    Every node hooks to its smallest neighbour, hooks are followed once, and the edges contracted; smallest by number in one round, which
    ends stars, and by a hash of it in the next, which shrinks chains by a constant factor whatever their numbers.
    """
    left = written(edges.select("a", "b").where("a <> b").distinct())
    roots, turn = None, 0
    while not left.isEmpty():
        rank = lambda c: F.struct((F.xxhash64(c, F.lit(turn)) if turn % 2 else F.lit(0).cast("long")).alias("order"), F.col(c).alias("node"))  # noqa: B023, E731
        both = left.union(left.select("b", "a"))
        hooks = both.groupBy(F.col("a").alias("node")).agg(F.min(rank("b")).alias("next")).select("node", F.least("next", rank("node"))["node"].alias("root"))
        step = hooks.select(F.col("node").alias("root"), F.col("root").alias("next"))
        to = written(hooks.join(spread(step), "root", "left").select("node", F.coalesce("next", "root").alias("root")))
        a = to.select(F.col("node").alias("a"), F.col("root").alias("root_a"))
        b = to.select(F.col("node").alias("b"), F.col("root").alias("root_b"))
        left = left.join(spread(a), "a").join(spread(b), "b").where("root_a <> root_b").select(F.least("root_a", "root_b").alias("a"), F.greatest("root_a", "root_b").alias("b"))
        left, turn = written(left.distinct()), turn + 1
        if roots is None:
            roots = to
        else:
            step = to.select(F.col("node").alias("root"), F.col("root").alias("next"))
            roots = written(roots.join(spread(step), "root", "left").select("node", F.coalesce("next", "root").alias("root")))
    return roots if roots is not None else left.select(F.col("a").alias("node"), F.col("b").alias("root"))


def starred(rows: DataFrame, texts: DataFrame, idf: Broadcast) -> DataFrame:
    """``rows`` (key, node, weight) with the pair (a, b) of each node and its bucket's centre and ``similarity``; the centre itself has 1."""
    # kept apart from the join, so that adaptive execution may split the partition of a large bucket
    centres = cut(rows.groupBy("key").agg(F.max_by("node", F.struct("weight", "node")).alias("centre")))
    pairs = cut(rows.join(spread(centres), "key").select("key", "node", "centre", F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")))
    known = verified(pairs.select("a", "b").where("a <> b").distinct(), texts, idf)
    return cut(pairs.join(spread(known), ["a", "b"], "left").withColumn("similarity", F.when(F.col("a") == F.col("b"), 1.0).otherwise(F.col("similarity"))))


def unsettled(known: DataFrame, roots: DataFrame, similarity: float) -> DataFrame:
    """The rows of ``known`` (see ``starred``) that must be compared further: key, node, root, far, apart (the distance from the centre).

    A row is far if the links so far don't join it to its centre. Two rows that aren't far are joined already; a row that isn't
    far is left out where no far row of its bucket can be similar to it, as their distances from the centre differ by too much.
    """
    named = roots.select("node", "root")
    of_centre = roots.select(F.col("node").alias("centre"), F.col("root").alias("home"))
    rows = known.join(spread(named), "node", "left").join(spread(of_centre), "centre", "left")
    root, home = F.coalesce("root", "node"), F.coalesce("home", "centre")
    rows = cut(rows.select("key", "node", root.alias("root"), (root != home).alias("far"), (1 - F.col("similarity")).alias("apart"), (F.col("node") == F.col("centre")).alias("is_centre")))
    reach = 1 - similarity + SLACK
    bounds = rows.where("far").groupBy("key").agg((F.min("apart") - reach).alias("least"), (F.max("apart") + reach).alias("most"))
    # the centre has been compared with all others
    rows = cut(rows.join(spread(cut(bounds)), "key").where("NOT is_centre AND (far OR apart BETWEEN least AND most)").select("key", "node", "root", "far", "apart"))
    # of buckets with the same rows one is enough
    name = [F.count("*").alias("n"), F.sum(F.xxhash64("node").cast("decimal(20, 0)")).alias("x"), F.sum(F.xxhash64("node", F.lit(1)).cast("decimal(20, 0)")).alias("y")]
    same = rows.groupBy("key").agg(*name, F.sum(F.col("far").cast("long")).alias("z")).join(spread(rows.groupBy("key").agg(F.min("root").alias("first"), F.max("root").alias("last"))), "key")
    keys = same.where("first <> last").groupBy("n", "x", "y", "z").agg(F.min("key").alias("key")).select("key")
    return cut(rows.join(spread(cut(keys)), "key"))


def compared(rows: DataFrame, texts: DataFrame, idf: Broadcast, similarity: float) -> DataFrame:
    """Links (a, b, similarity) that join all similar rows of a bucket of ``rows`` (see ``unsettled``) of which one is far.

    Rows of a bucket are dealt to blocks of about BLOCK rows and BLOCK_BYTES bytes, and every block of far rows meets every other block, so
    that a large bucket is spread over many tasks. Within a task rows that are joined already aren't compared again.
    """
    sized = cut(rows.join(spread(texts.select("node", F.octet_length("text").alias("bytes"))), "node"))
    blocks = lambda side: F.greatest(F.lit(1), F.ceil(F.count_if(side) / BLOCK), F.ceil(F.sum(F.when(side, F.col("bytes")).otherwise(0)) / BLOCK_BYTES)).cast("long")
    counts = cut(sized.groupBy("key").agg(blocks(F.col("far")).alias("fars"), blocks(~F.col("far")).alias("homes")))
    dealt = sized.join(spread(counts), "key").withColumn("block", F.pmod(F.xxhash64("node"), F.when(F.col("far"), F.col("fars")).otherwise(F.col("homes"))))
    # group (i, j): block i of far rows with block j of them, the first one also with the first block of the others, or with a further block of the others
    parts = """CASE WHEN far THEN concat(transform(sequence(0L, fars - 1), x -> struct(least(x, block) AS i, greatest(x, block) AS j, x >= block AS pivot)),
        transform(filter(sequence(1L, homes), h -> h < homes), h -> struct(block AS i, fars + h - 1 AS j, true AS pivot)))
        ELSE transform(sequence(0L, fars - 1), x -> struct(x AS i, CASE WHEN block = 0 THEN x ELSE fars + block - 1 END AS j, false AS pivot)) END"""
    groups = dealt.select("key", "node", "root", "apart", F.explode(F.expr(parts)).alias("part")).select("key", "part.i", "part.j", "part.pivot", "node", "root", "apart")

    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        node, pivot, apart, label = (table.column(c).to_numpy() for c in ("node", "pivot", "apart", "root"))
        within = table.column("i")[0].as_py() == table.column("j")[0].as_py()
        code, weight, first = weighted_shingles(words_of(table.column("text").combine_chunks())[2], idf.value)
        label, total = label.copy(), np.add.reduceat(weight, first[:-1])
        distinct, at = np.unique(code, return_inverse=True)
        one, places, out = np.zeros(len(distinct)), np.arange(len(node)), []
        for p in np.flatnonzero(pivot).tolist():
            open_ = (label != label[p]) & (np.abs(apart - apart[p]) <= 1 - similarity + SLACK)
            open_ &= np.minimum(total, total[p]) >= (similarity - SLACK) * np.maximum(total, total[p])
            open_ &= ~pivot | (places > p) if within else ~pivot
            if not open_.any():
                continue
            own = slice(first[p], first[p + 1])
            one[at[own]] = weight[own]
            common = np.add.reduceat(np.minimum(one[at], weight), first[:-1])
            one[at[own]] = 0
            either = total + total[p] - common
            met = np.flatnonzero(open_ & (common >= similarity * either))
            if len(met):
                out.extend((min(node[p], node[m]), max(node[p], node[m]), common[m] / either[m]) for m in met.tolist())
                label[np.isin(label, label[met])] = label[p]
        return pa.table({c: pa.array([x[i] for x in out], kind) for i, (c, kind) in enumerate((("a", pa.int64()), ("b", pa.int64()), ("similarity", pa.float64())))})

    joined = groups.join(spread(texts), "node").select("key", "i", "j", "pivot", "node", "root", "apart", "text")
    return cut(joined.groupBy("key", "i", "j").applyInArrow(compare, "a long, b long, similarity double"))


def linked(docs: DataFrame, nodes: DataFrame, idf: Broadcast, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """The verified links (a, b, similarity) between nodes (node, same, doc_id, bands), each once, and edges (a, b) that join the same nodes in fewer steps.

    Links are those between a node and a bucket's centre, and what joins the nodes that these leave apart.
    """
    buckets = nodes.select("node", F.explode("bands").alias("key"))
    sizes = cut(buckets.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    shared = cut(buckets.join(spread(sizes), "key"))
    # a text from which many differ a little shares more bands with them than they do with each other
    weight = cut(shared.groupBy("node").agg(F.sum("n").alias("weight")))
    texts = _texts_of(docs, nodes.select("node", "same", "doc_id").join(spread(weight.select("node")), "node"))
    known = starred(shared.select("key", "node").join(spread(weight), "node"), texts, idf)
    links = cut(known.where((F.col("similarity") >= similarity) & (F.col("a") < F.col("b"))).groupBy("a", "b").agg(F.max("similarity").alias("similarity")))
    roots = components(links)
    # a pair may meet in several buckets; a link to a centre joins its nodes, so it isn't found again
    further = compared(unsettled(known, roots, similarity), texts, idf, similarity).groupBy("a", "b").agg(F.max("similarity").alias("similarity"))
    return links.union(further), roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(further.select("a", "b"))


def near_links(docs: DataFrame, nodes: DataFrame, idf: Broadcast, similarity: float = SIMILARITY) -> DataFrame:
    """Edges (a, b) that join all nodes (node, same, doc_id, bands) which share a band and are similar: between a node and the root of its
    class by verified links, and verified ones beyond these."""
    return linked(docs, nodes, idf, similarity)[1]


def _nodes(docs: DataFrame) -> tuple[DataFrame, DataFrame, Broadcast]:
    """The rows (doc_id, same, bands), their distinct word sequences (node, same, doc_id, bands) and the idf."""
    idf = docs.sparkSession.sparkContext.broadcast(idf_table(document_frequencies(docs)))  # 2**DF_BITS numbers
    signed = cut(signatures(docs, idf))
    nodes = signed.where("doc_id IS NOT NULL").groupBy("same").agg(F.min("doc_id").alias("doc_id"), F.any_value("bands").alias("bands"))
    return signed, cut(nodes.withColumn("node", F.monotonically_increasing_id())), idf


def near_classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row for each row of ``docs``: doc_id, class_id (the smallest doc_id of its class), class_size, kept, text_id, links.

    ``text_id`` is the smallest doc_id with the same words, which stands for it in ``near_pairs``; ``links`` is the number of pairs there with it.
    """
    signed, nodes, idf = _nodes(docs)
    links, edges = linked(docs, nodes, idf, similarity)
    ends = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("links"))
    named = nodes.select("same", "node", F.col("doc_id").alias("text_id")).join(spread(components(edges)), "node", "left").join(spread(cut(ends)), "node", "left")
    named = cut(named.select("same", "text_id", F.coalesce("root", "node").alias("root"), F.coalesce("links", F.lit(0).cast("long")).alias("links")))
    rows = cut(signed.where("doc_id IS NOT NULL").select("doc_id", "same").join(spread(named), "same").drop("same"))
    classes = cut(rows.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size")))
    out = rows.join(spread(classes), "root").select("doc_id", "class_id", "class_size", (F.col("doc_id") == F.col("class_id")).alias("kept"), "text_id", "links")
    none, one = F.lit(None).cast("long"), F.lit(1).cast("long")
    alone = signed.where("doc_id IS NULL").select("doc_id", none.alias("class_id"), one.alias("class_size"), F.lit(True).alias("kept"), none.alias("text_id"), (one - 1).alias("links"))
    return out.union(alone)


def near_pairs(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """a, b, similarity: the verified links between different texts, each once, a text by the ``text_id`` that ``near_classes`` gives its rows.

    They join all that is similar among candidates; a pair that other links join already need not be among them, so a group of
    many variants has about as many links as texts. Where an id has several texts, its pairs are those of them all.
    """
    _, nodes, idf = _nodes(docs)
    links = linked(docs, nodes, idf, similarity)[0]
    a, b = (nodes.select(F.col("node").alias(side), F.col("doc_id").alias(f"{side}_id")) for side in "ab")
    both = links.join(spread(a), "a").join(spread(b), "b")
    return both.select(F.least("a_id", "b_id").alias("a"), F.greatest("a_id", "b_id").alias("b"), "similarity")


def drop_near(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs``, all columns, without those for which a near duplicate with a smaller doc_id stays.

    Rows that share an id stay or go together; they stay if one of them does.
    """
    gone = near_classes(docs, similarity).groupBy(F.col("doc_id").alias("__gone")).agg(F.max("kept").alias("stays")).where("NOT stays")
    return docs.join(spread(gone), docs["doc_id"] == gone["__gone"], "left_anti")


def op1_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
