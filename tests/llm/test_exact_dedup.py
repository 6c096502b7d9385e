import hashlib

import pytest
from cases import AWKWARD, documents
from compare import assert_agrees

from quillspark.llm import exact_dedup


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def brute(rows):
    groups = {}
    for doc_id, text, *_ in rows:
        groups.setdefault(lowered(text), []).append(doc_id)
    out = []
    for doc_id, text, *_ in rows:
        ids = groups[lowered(text)]
        keep = max((i for i in ids if i is not None), default=None)
        out.append((doc_id, keep, len(ids), doc_id == keep, hashlib.sha256(lowered(text).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_query_agrees_with_sql(spark, sf_dir):
    assert_agrees(exact_dedup.op3_exact_dedup(spark, sf_dir), exact_dedup.OP3_SQL, sf_dir)


@pytest.mark.parametrize("block_bytes", [4, 64, exact_dedup.BLOCK_BYTES])
def test_awkward_rows_at_any_block_size(spark, block_bytes):
    rows = AWKWARD + [(20 + i, "abcdabcd" * i) for i in range(6)] + [(30 + i, "ABCDabcd" * i) for i in range(6)]
    got = exact_dedup.exact_groups(documents(spark, rows), block_bytes)
    assert sorted((tuple(r)[:5] for r in got.collect()), key=repr) == brute(rows)


def test_empty_table(spark):
    assert exact_dedup.exact_groups(documents(spark, [])).count() == 0


def test_dropping_keeps_all_columns(spark):
    docs = documents(spark, AWKWARD)
    kept = exact_dedup.drop_exact(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [2, 3, 5, 7, 8, 9]
