import hashlib
import random
import zlib

import pytest
from cases import AWKWARD, documents
from compare import assert_agrees
from pyspark.sql import functions as F

from quillspark.llm import merkle


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def enc(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def levels_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha(*out[-1][i : i + 3]) for i in range(0, len(out[-1]), 3)])
    return out


def way(levels, i):
    for nodes in levels[:-1]:
        low = i // 3 * 3
        yield "".join(nodes[low:i]), "".join(nodes[i + 1 : low + 3])
        i //= 3


def brute(rows):
    """Of (doc_id, source, lang, n_chars, text): (doc_id, leaf, subroot, root, proof_sha256, folded_root, verified)."""
    leaf = lambda r, text: sha(*map(enc, (*r[:4], text)))
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, leaf(r, r[4]), r))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels_of([x[2] for x in sorted(groups[s], key=lambda x: x[:3])]) for s in order}
    top = levels_of([trees[s][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for i, (_, _, own, r) in enumerate(sorted(groups[s], key=lambda x: x[:3])):
            steps = [*way(trees[s], i), *way(top, k)]
            node = leaf(r, r[4].replace("\n", "")) if r[4] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 else own
            for b, a in steps:
                node = sha(b, node, a)
            out.append((r[0], own, trees[s][-1][0], top[-1][0], sha(*[b + a for b, a in steps]), node, node == top[-1][0]))
    return sorted(out, key=repr)


def query(spark, tmp_path, rows):
    path = str(tmp_path / str(random.random()))
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, part int, gkey string")
    docs.repartition(3).write.parquet(f"{path}/documents.parquet")
    return sorted((tuple(r) for r in merkle.op12_merkle(spark, path).collect()), key=repr)


def test_query_agrees_with_sql(spark, sf_dir):
    assert_agrees(merkle.op12_merkle(spark, sf_dir), merkle.OP12_SQL, sf_dir)


def test_agrees_with_brute_force(spark, tmp_path):
    rng = random.Random(7)
    sources = ["a"] * 12 + ["b", "é", "", None, "solo"]
    rows = [(rng.randrange(4000), rng.choice(sources), rng.choice(["en", None]), rng.choice([None, 5]), rng.choice([None, "", "x\ny", "one\n\ntwo", "plain"])) for _ in range(3000)]
    rows += [(None, "a", None, None, None), (None, None, "en", 1, "x\n"), (9, "a", "en", 1, "same"), (9, "a", "en", 1, "same")]
    assert query(spark, tmp_path, rows) == brute(rows)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 9, 10, 28])
def test_small_trees(spark, tmp_path, n):
    rows = [(i, "s", "en", 1, f"t\n{i}") for i in range(n)]
    assert query(spark, tmp_path, rows) == brute(rows)


def test_every_document_its_own_source(spark, tmp_path):
    rows = [(i, f"s{i}", "en", 1, f"t{i}") for i in range(300)]
    assert query(spark, tmp_path, rows) == brute(rows)


def test_ragged_ends_over_many_rounds(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(merkle, "STRIDE", 2)
    rows = [(i, "ab"[i % 7 == 0], "en", i, f"t\n{i}") for i in range(2500)]
    assert query(spark, tmp_path, rows) == brute(rows)


def test_climb_leaves_exactly_what_has_no_parent():
    for total in (1, 2, 3, 7, 27, 28, 100):
        leaves = [str(i) for i in range(total)]
        whole = levels_of(leaves)
        for first in range(0, total, 5):
            for end in range(first + 1, total + 1, 4):
                levels, tops = merkle.climb(leaves[first:end], first, total)
                assert all(nodes == whole[lv][at : at + len(nodes)] for lv, (at, nodes) in enumerate(levels))
                covered = sorted(i for lv, p, _ in tops for i in range(p * 3**lv, min(total, (p + 1) * 3**lv)))
                assert covered == list(range(first, end))


def test_awkward_documents(spark):
    docs = documents(spark, AWKWARD)
    rows = docs.select("doc_id", "source", merkle.document_leaf(F.col("text")).alias("leaf"), "text")
    got = merkle.manifest(rows, "source", "doc_id", ("text",))
    assert got.count() == len(AWKWARD) and got.where(merkle.folded(F.col("leaf"), F.col("proof")) != F.col("root")).count() == 0
    assert got.columns == ["source", "doc_id", "text", "leaf", "proof", "subroot", "root"]
