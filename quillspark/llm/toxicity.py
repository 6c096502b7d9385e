"""Toxicity by multiple-instance learning: a document is toxic if at least one of its sentences is.

A sentence's probability is logistic in its distinct words, each by itself and by its first letters, so that forms of a
word not seen in training count (all hashed); a document's is the noisy-or of its sentences,
1 - prod(1 - p). Only document labels are known, so the loss is taken on documents and its gradient falls on the
sentences that explain them. The same sentence scores then say where a document offends.

Fitting uses a bounded sample: of the labelled rows outside the held-out fold, the ``fit_docs`` with the smallest hash
of their id, and of these the texts of up to ``fit_words`` words. Scoring covers every whole text.

Defined cases: a null text counts as empty and, like any text without words, has the score of one sentence without
known words; a row with a null doc_id is scored, is not held out and never trains; if labels of an id differ, the
largest counts; without labelled rows, or with one class only, all weights stay 0; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stages import with_columns_of

FIT_DOCS, FIT_WORDS = 6000, 5000
FOLDS = 5
BITS = 18
#: Letters of the beginnings of words that are features.
PREFIXES = (4, 5)
#: Features in fewer documents of the sample get no weight.
LEAST_DOCS = 8
#: Weight of a toxic document: the classes' ratio to this power. With the decay, chosen on a fold of the training rows.
RARE_POWER = 1.25
REMEMBERED = 400_000
#: Words that a step of fitting holds at once.
PIECE = 1 << 19
SENTENCE = re.compile(r"[^.!?\n]+[.!?]*")
WORD = re.compile(r"[^\W\d_]+")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def buckets(word: str) -> list[int]:
    """The word's features: itself, and its beginnings."""
    forms = [word, *[f"{word[:n]}-" for n in PREFIXES if len(word) >= n]]
    return [zlib.crc32(x.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1) for x in forms]


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float


def noisy_or_fit(words: np.ndarray, sentence_of: np.ndarray, doc_of: np.ndarray, toxic: np.ndarray, rounds: int = 250, rate: float = 0.15, decay: float = 1e-3) -> Model:
    """Fits by Adam on all documents: ``words`` are features, each of sentence ``sentence_of``, that of ``doc_of``, both ascending."""
    weights = np.zeros(1 << BITS)
    n_docs = len(toxic)
    if n_docs == 0 or toxic.min() == toxic.max():
        return Model(weights, -4.0)
    # each step drops what it no longer needs: this runs in the driver
    docs_with = np.zeros(1 << BITS, np.int64)
    at = 0
    while at < len(words):
        # whole documents, PIECE words or one document
        end = min(len(words), at + PIECE)
        last = doc_of[sentence_of[end - 1]]
        begin = int(np.searchsorted(sentence_of, np.searchsorted(doc_of, last)))
        end = begin if end < len(words) and begin > at else int(np.searchsorted(sentence_of, np.searchsorted(doc_of, last, "right")))
        pairs = words[at:end].astype(np.int64) * n_docs
        pairs += doc_of[sentence_of[at:end]]
        pairs.sort()
        docs_with += np.bincount(pairs[np.r_[True, pairs[1:] != pairs[:-1]]] // n_docs, minlength=1 << BITS)
        at = end
    known = np.flatnonzero(docs_with >= LEAST_DOCS)
    number = np.full(1 << BITS, -1, np.int32)
    number[known] = np.arange(len(known))
    # words lie in the order of their sentences, so pieces of them are added up one by one: no step holds numbers for all words at once
    kept, rows, n = [], [], len(known)
    for at in range(0, len(words), PIECE):
        column = number[words[at : at + PIECE]]
        use = column >= 0
        kept.append(column[use])
        rows.append(sentence_of[at : at + PIECE][use])
    del words, sentence_of
    pieces = [(c, r) for c, r in zip(kept, rows, strict=True) if len(c)]
    theta = np.r_[np.zeros(n), -4.0]
    # the rarer toxic documents count more
    rare = ((toxic == 0).sum() / (toxic == 1).sum()) ** RARE_POWER
    first, second = np.zeros(n + 1), np.zeros(n + 1)
    for step in range(1, rounds + 1):
        z, grad = np.full(len(doc_of), theta[n]), np.zeros(n + 1)
        for column, row in pieces:
            z[row[0] : row[-1] + 1] += np.bincount(row - row[0], theta[column])
        clean = np.exp(-np.bincount(doc_of, np.logaddexp(0, z), minlength=n_docs))
        pull = np.where(toxic == 1, -rare * clean / np.maximum(1 - clean, 1e-9), 1.0)
        slope = pull[doc_of] / (1 + np.exp(-z))
        for column, row in pieces:
            grad[:n] += np.bincount(column, slope[row], minlength=n)
        grad[n] = slope.sum()
        grad /= n_docs
        grad[:n] += decay * theta[:n]
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad**2
        theta -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    weights[known] = theta[:n]
    return Model(weights, float(theta[n]))


def fit(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS, fit_words: int = FIT_WORDS) -> Model:
    """The model of ``labels`` (doc_id, toxic) outside the held-out fold, from at most ``fit_docs`` texts."""
    known = with_columns_of(labels, doc_id="bigint", toxic="int").where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out(F.col("doc_id")))
    sample = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_docs)
    rows = with_columns_of(docs, doc_id="bigint", text="string").join(F.broadcast(sample), "doc_id").select("doc_id", "toxic", F.coalesce("text", F.lit("")).alias("text"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, toxic, out = [], [], []
            for doc_id, label, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                sentences = [sorted(b for w in set(WORD.findall(s)) for b in buckets(w)) for s in SENTENCE.findall(text.lower())] or [[]]
                if len(WORD.findall(text)) <= fit_words:
                    ids.append(doc_id)
                    toxic.append(label)
                    out.append(sentences)
            kind = pa.list_(pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(toxic, pa.int32()), pa.array(out, kind)], ["doc_id", "toxic", "sentences"])

    # bounded by fit_docs x fit_words numbers; doc_ids that repeat in docs bring their rows each, cut to the bound
    taken = rows.mapInArrow(features, "doc_id long, toxic int, sentences array<array<int>>").limit(fit_docs).toArrow().sort_by("doc_id")
    if len(taken) == 0:
        return Model(np.zeros(1 << BITS), -4.0)
    sentences, toxic_of = taken.column("sentences").combine_chunks(), taken.column("toxic").to_numpy()
    del taken
    per_doc = np.diff(sentences.offsets.to_numpy())
    inner = sentences.flatten()
    per_sentence = np.diff(inner.offsets.to_numpy())
    doc_of = np.repeat(np.arange(len(per_doc), dtype=np.int32), per_doc)
    sentence_of = np.repeat(np.arange(len(per_sentence), dtype=np.int32), per_sentence)
    model = noisy_or_fit(inner.flatten().to_numpy(), sentence_of, doc_of, toxic_of)
    del sentences, inner, sentence_of, doc_of
    pa.default_memory_pool().release_unused()  # the driver lives on
    return model


class Scorer(dict):
    """Weights of words, remembered up to a bound; ``sentences`` scores every sentence of a text."""

    def __init__(self, model: Model) -> None:
        super().__init__()
        self.weights, self.bias = model.weights, model.bias

    def __missing__(self, word: str) -> float:
        if len(self) >= REMEMBERED:
            self.clear()
        found = self[word] = float(self.weights[buckets(word)].sum())
        return found

    def logits(self, text: str) -> list[float]:
        get, bias = self.__getitem__, self.bias
        return [bias + math.fsum(map(get, set(WORD.findall(s)))) for s in SENTENCE.findall(text.lower())] or [bias]

    def document(self, text: str) -> float:
        """1 - prod(1 - p) over the sentences."""
        clean = -math.fsum(max(z, 0.0) + math.log1p(math.exp(-abs(z))) for z in self.logits(text))
        return -math.expm1(clean)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """One row for each row of ``docs``: doc_id, held_out, score, predicted."""
    rows = with_columns_of(docs, doc_id="bigint", text="string")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([scorer.document(x.as_py() or "") for x in batch.column(1)], pa.float64())], ["doc_id", "score"])

    out = rows.mapInArrow(scored, "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def offending_sentences(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """doc_id, start, stop (characters), score and text of the sentences that reach ``least``."""
    rows = with_columns_of(docs, doc_id="bigint", text="string")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = "doc_id long, start int, stop int, score double, sentence string"

    def located(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        kind = pa.schema([("doc_id", pa.int64()), ("start", pa.int32()), ("stop", pa.int32()), ("score", pa.float64()), ("sentence", pa.string())])
        for batch in batches:
            out = []
            for doc_id, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                for m in SENTENCE.finditer(text or ""):
                    p = scorer.document(m[0])
                    if p >= least:
                        out.append((doc_id, m.start(), m.end(), p, m[0]))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(kind)], schema=kind)

    return rows.mapInArrow(located, schema)


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is below 0.5."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            yield batch.filter(pa.array([scorer.document(x.as_py() or "") < 0.5 for x in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(clean, docs.schema)


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
