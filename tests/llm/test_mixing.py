from cases import AWKWARD, documents
from compare import assert_agrees

from quillspark.llm import mixing


def test_query_agrees_with_sql(spark, sf_dir):
    assert_agrees(mixing.op9_mixing(spark, sf_dir), mixing.OP9_SQL, sf_dir)


def shares(rows):
    taken, target, size = {}, {}, {}
    for r in rows:
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source], size[r.source] = r.target, r.source_size
    return taken, target, size


def test_taken_words_come_near_the_targets(spark):
    rows = [(i, "w " * (1 + i % 50), "abcde"[i % 5] if i % 3 else "a") for i in range(3000)] + [(9000 + i, "v " * 3, None) for i in range(5)]
    got = mixing.mix(documents(spark, rows)).collect()
    taken, target, size = shares(got)
    assert all(r.taken <= 3 * r.size and r.taken % max(1, r.size) == 0 for r in got)
    assert sum(taken.values()) <= sum(size.values()) < sum(taken.values()) + 51
    assert all(abs(taken[s] - target[s]) <= 100 for s in taken) and target[None] == 3 * size[None] == taken[None]


def test_targets_stop_at_the_limit_and_share_the_excess(spark):
    sizes = spark.createDataFrame([("a", 1000), ("b", 10), ("c", 500), (None, 1)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(sizes).collect()}
    assert got["b"] == 30 and got[None] == 3 and abs(sum(got.values()) - 1511) < 1e-6 and abs(got["c"] / got["a"] - 3) < 1e-9


def test_awkward_rows_and_reruns(spark):
    docs = documents(spark, [*AWKWARD, (60, "one two", None), (61, "three", None)])
    a, b = ([sorted(map(tuple, mixing.mix(d).collect()), key=repr) for d in (docs, docs.repartition(3))])
    assert a == b and len(a) == len(AWKWARD) + 2
    assert mixing.mix(documents(spark, [])).count() == 0


def test_documents_of_the_mix(spark):
    rows = [(i, "w " * (1 + i % 7), "ab"[i % 2]) for i in range(200)] + [(500, "same text", "a"), (500, "same text", "a"), (501, None, "a"), (None, "x y", None)]
    docs = documents(spark, rows)
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    count = {}
    for r in out.collect():
        count[r.doc_id] = count.get(r.doc_id, 0) + 1
    wanted = {}
    for r in mixing.mix(docs).collect():
        if r.taken:
            wanted[r.doc_id] = wanted.get(r.doc_id, 0) + r.taken // r.size
    assert count == wanted


def test_very_many_equal_rows(spark):
    from pyspark.sql import functions as F

    equal = spark.range(0, 100_000, 1, 8).select(F.lit(7).cast("long").alias("doc_id"), F.lit("some equal words").alias("text"), F.lit("a").alias("source"))
    empty = spark.range(0, 50_000, 1, 8).select(F.lit(None).cast("long").alias("doc_id"), F.lit("").alias("text"), F.lit("a").alias("source"))
    other = spark.range(0, 3000, 1, 2).select((F.col("id") + 100).alias("doc_id"), F.lit("w w w w").alias("text"), F.lit("b").alias("source"))
    docs = equal.union(empty).union(other)
    sums = {r.source: (r.n, r.size, r.taken, r.target) for r in mixing.mix(docs).groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("size"), F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()}
    assert sums["a"][:2] == (150_000, 300_000) and sums["b"][:2] == (3000, 12_000) and sums["b"][2] == sums["b"][3] == 36_000
    assert abs(sums["a"][2] - sums["a"][3]) <= 3 and sums["a"][3] == 276_000
    got = {r.source: r.n for r in mixing.mixed_documents(docs).groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert got == {"a": 92_000, "b": 9000}


def test_no_python_on_the_main_path(spark, sf_dir):
    plan = mixing.op9_mixing(spark, sf_dir)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
