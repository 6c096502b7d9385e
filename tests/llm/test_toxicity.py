import zlib

import duckdb
import numpy as np
from cases import AWKWARD, documents

from quillspark.llm import toxicity as tx

LABELS = "doc_id long, toxic int, quality int, text string"


def trained(spark, n=600):
    rng = np.random.default_rng(5)
    plain = [f"word{i}" for i in range(200)]
    rows, labels = [], []
    for d in range(n):
        sentences = [" ".join(rng.choice(plain, 8)) for _ in range(rng.integers(1, 9))]
        toxic = int(rng.random() < 0.3)
        if toxic:
            sentences[rng.integers(len(sentences))] += f" vile{['', 'st', 'ness'][rng.integers(3)]}"
        rows.append((d, ". ".join(sentences) + "."))
        labels.append((d, toxic, 0, "clash"))
    return documents(spark, rows), spark.createDataFrame(labels, LABELS), dict((d, t) for d, t, *_ in labels), dict(rows)


def test_held_out_rows_are_told_apart_and_sentences_located(spark):
    docs, labels, toxic, texts = trained(spark)
    model = tx.fit(docs, labels)
    got = {r.doc_id: r for r in tx.score(docs, model).collect()}
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) for d, r in got.items())
    held = [d for d, r in got.items() if r.held_out]
    assert np.mean([got[d].predicted == toxic[d] for d in held]) > 0.97
    for r in tx.offending_sentences(docs, model).collect():
        assert texts[r.doc_id][r.start : r.stop] == r.sentence
        assert "vile" in r.sentence or not toxic[r.doc_id]
    assert {r.doc_id for r in tx.drop_toxic(docs, model).collect()} == {d for d, r in got.items() if not r.predicted}


def test_held_out_labels_are_never_read(spark):
    docs, labels, *_ = trained(spark)
    from pyspark.sql import functions as F

    flipped = labels.withColumn("toxic", F.when(tx.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert np.array_equal(tx.fit(docs, labels).weights, tx.fit(docs, flipped).weights)


def test_accuracy_of_the_query(spark):
    sf_dir = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in tx.op5_toxicity(spark, sf_dir).collect()}
    toxic = dict(duckdb.sql(f"SELECT doc_id, max(toxic) FROM '{sf_dir}/labels.parquet' GROUP BY 1").fetchall())
    assert np.mean([got[d].predicted == t for d, t in toxic.items()]) > 0.9 and len(got) == 1000


def test_awkward_rows(spark):
    docs = documents(spark, AWKWARD)
    for labels in ([], [(1, 1, 0, "x"), (None, 1, 0, "x"), (2, None, 0, "x")], [(i, i % 2, 0, "x") for i in range(1, 10)] + [(1, 0, 0, "x")]):
        got = tx.score(docs, tx.fit(docs, spark.createDataFrame(labels, LABELS))).collect()
        assert len(got) == len(AWKWARD) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
        assert not any(r.held_out for r in got if r.doc_id is None)
    assert tx.score(documents(spark, []), tx.fit(docs, spark.createDataFrame([], LABELS))).count() == 0


def test_scores_are_those_of_a_loop_over_sentences():
    import math
    import re

    model = tx.Model(np.random.default_rng(3).normal(0, 0.7, 1 << tx.BITS), -2.0)
    for text in ("", "One two two three. Four five! six\nseven? Eight", "... !!", "a b c " * 50 + ". vile words here.", "Ünïcode wörds. Ünïcode again!"):
        clean = 1.0
        for sentence in re.findall(r"[^.!?\n]+[.!?]*", text.lower()) or [""]:
            z = model.bias + sum(model.weights[b] for w in set(re.findall(r"[^\W\d_]+", sentence)) for b in tx.buckets(w))
            clean *= 1 - 1 / (1 + math.exp(-z))
        assert abs(tx.Scorer(model).document(text) - (1 - clean)) < 1e-12


def test_fitting_holds_pieces_of_the_words_and_not_all_of_them_at_once(monkeypatch):
    """Beside its input the fit keeps the words' columns and sentences, 8 bytes a word, and what a piece needs; pieces of any length give one model."""
    import tracemalloc

    rng = np.random.default_rng(3)
    docs, sentences, n = 400, 2000, 2_000_000
    sentence_of, doc_of = np.sort(rng.integers(0, sentences, n)).astype(np.int32), np.repeat(np.arange(docs, dtype=np.int32), sentences // docs)
    words, toxic = (rng.zipf(1.4, n) % 5000).astype(np.int32), (rng.random(docs) < 0.2).astype(np.int32)
    monkeypatch.setattr(tx, "PIECE", 1 << 16)
    tracemalloc.start()
    model = tx.noisy_or_fit(words, sentence_of, doc_of, toxic, rounds=3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 * n + (14 << 20)
    monkeypatch.setattr(tx, "PIECE", 777_777)
    other = tx.noisy_or_fit(words, sentence_of, doc_of, toxic, rounds=3)
    assert np.abs(other.weights - model.weights).max() < 1e-9 and abs(other.bias - model.bias) < 1e-9 and np.abs(model.weights).max() > 0.1
