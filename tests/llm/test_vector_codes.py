import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from compare import assert_agrees
from pyspark.sql import functions as F

from quillspark.llm import vector_codes as vc

SCHEMA = "vec_id long, embedding array<float>, label int, v string, now binary, n int"


def table(spark, tmp_path, rows):
    path = str(tmp_path / str(random.random()))
    spark.createDataFrame([(i, e, lb, "x", b"y", 1) for i, e, lb in rows], SCHEMA).repartition(3).write.parquet(f"{path}/embeddings.parquet")
    return path


def brute(rows, entries=64, rounds=2):
    kept = [(i, [math.floor(256 * x) for x in e], lb) for i, e, lb in rows if e is not None and all(x is not None and math.isfinite(x) for x in e)]
    if not kept:
        return []
    size = max(Counter(len(v) for _, v, _ in kept).items(), key=lambda x: (x[1], x[0]))[0]
    kept = sorted((r for r in kept if len(r[1]) == size), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    w = size // 16
    cut = [[tuple(v[p * w : p * w + w]) for p in range(16)] for _, v, _ in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(16)]

    def assign():
        return [[min((sum((a - b) ** 2 for a, b in zip(x[p], y, strict=True)), e) for e, y in enumerate(books[p])) for p in range(16)] for x in cut]

    for _ in range(rounds):
        hits = assign()
        for p in range(16):
            for e in range(len(books[p])):
                own = [x[p] for x, h in zip(cut, hits, strict=True) if h[p][1] == e]
                if own:
                    books[p][e] = tuple(sum(c) // len(own) for c in zip(*own, strict=True))
    hits = assign()
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    errors, by_label = [sum(h[0] for h in hit) for hit in hits], Counter()
    for (_, _, lb), error in zip(kept, errors, strict=True):
        by_label[lb] += error
    return sorted(((i, "".join(f"{h[1]:02x}" for h in hit), error, by_label[lb], digest) for (i, _, lb), hit, error in zip(kept, hits, errors, strict=True)), key=repr)


def got(spark, path):
    return sorted((tuple(r) for r in vc.op11_vector_codes(spark, path).collect()), key=repr)


def test_query_agrees_with_sql(spark, sf_dir):
    assert_agrees(vc.op11_vector_codes(spark, sf_dir), vc.OP11_SQL, sf_dir)


def test_agrees_with_brute_force(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i * 3, [rng.gauss(0, 1) for _ in range(32)], rng.choice([0, 1, None])) for i in range(300)]
    rows += [(None, [0.5] * 32, 1), (5, [0.1] * 32, 2), (5, [-0.1] * 32, 2), (5, [-0.1] * 32, 2)] + [(1000 + i, [0.25] * 32, 7) for i in range(200)]
    rows += [(2000, None, 1), (2001, [], 1), (2002, [None] * 32, 1), (2003, [float("nan")] + [0.0] * 31, 1), (2004, [float("-inf")] + [0.0] * 31, 1), (2005, [1.0] * 16, 3)]
    assert got(spark, table(spark, tmp_path, rows)) == brute(rows)


@pytest.mark.parametrize("n", [0, 1, 5])
def test_fewer_vectors_than_entries(spark, tmp_path, n):
    rows = [(i, [float(i % 3)] * 16, None) for i in range(n)]
    assert got(spark, table(spark, tmp_path, rows)) == brute(rows)


def test_sums_by_differences_are_the_sums(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    state, books = vc.fitted(rows, rounds=4)
    x, now = (state.selectExpr("v").collect(), [list(r[0]) for r in state.select("now").collect()])
    for p in (0, 7, 15):
        for e in range(64):
            own = [r[0][p * 4 : p * 4 + 4] for r, c in zip(x, now, strict=True) if c[p] == e]
            if own:
                assert books[p, e].tolist() == [sum(c) // len(own) for c in zip(*own, strict=True)]


def test_only_changed_parts_are_moved(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    state, books = vc.fitted(rows, rounds=1)
    assert vc.changes(vc.assigned(state.drop("before"), books).select("v", F.col("now").alias("before"), "now"), books).count() == 0


def test_codes_stand_for_vectors_near_their_own(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    state, books = vc.fitted(rows)
    back = vc.decoded(vc.coded(state, books), books).join(state.select("vec_id", "v"), "vec_id")
    off = F.aggregate(F.zip_with("approximate", "v", lambda a, b: F.pow(a * 256 - b, F.lit(2))), F.lit(0.0), lambda s, d: s + d)
    assert back.where(off != F.col("error")).count() == 0


def test_parts_that_do_not_divide_and_large_components_raise(spark, tmp_path):
    with pytest.raises(ValueError, match="equal parts"):
        got(spark, table(spark, tmp_path, [(1, [1.0] * 17, 1)]))
    with pytest.raises(Exception, match="not exact"):
        got(spark, table(spark, tmp_path, [(1, [1e9] * 16, 1)]))
    far = np.array([[2**22, 0]])
    assert vc.nearest(far, -far.reshape(1, 1, 2))[1].tolist() == [[2**46]]
