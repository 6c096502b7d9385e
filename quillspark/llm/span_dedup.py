"""Substring deduplication by sliding sentence spans.

From every sentence on, the shortest run of at least SPAN consecutive sentences and LEAST_WORDS words is hashed (96 bits), and so is the
shortest such run that ends with it, so that the last sentences of a repeated passage are covered too. Hashes that occur more than once are
found by one aggregate over all documents, which also keeps each hash's first occurrence (smallest doc_id, then text, then position); it
combines in the map tasks, so a span that a third of all documents share sends one row from each task. Joined back, every other occurrence
marks its sentences, and marked sentences are removed.

A sentence ends at a full stop, an exclamation or question mark before white space, at the full-width ones, or at a line break; it is
compared by its words, A-Z in lower case, white space as one space. Runs go on until they hold LEAST_WORDS words (of text without spaces
each Chinese or Japanese character is one), so that a few short sentences alike by chance, or one common line, remove nothing.

Defined cases: null counts as empty; texts of fewer than SPAN sentences or LEAST_WORDS words hold no span and stay; a row with a null
doc_id takes no part; a document is an id with a text: repeated rows (same id, same text) are one document and remove nothing from each
other, several texts of one id are told apart by 32 bits of a hash and marked each for itself; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stages import cut, marked_documents

SPAN, LEAST_WORDS = 2, 25
END = re.compile(r"[.!?]+(?=\s|$)|[。！？]+|\n")
#: Characters that are words by themselves.
IDEOGRAPH = re.compile("[\u3040-\u9fff]")
#: Bits of ``place`` that hold the number of a run's sentences.
N_BITS = 20
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sentences(text: str) -> list[tuple[int, int]]:
    """(start, stop) of the sentences of a text that hold a word."""
    out, at = [], 0
    for m in END.finditer(text):
        stop = m.start() if m[0] == "\n" else m.end()
        if text[at:stop].strip():
            out.append((at, stop))
        at = m.end()
    if text[at:].strip():
        out.append((at, len(text)))
    return out


def word_count(part: str) -> int:
    """Words of a sentence whose white space is single spaces."""
    spaced = part.count(" ") + 1
    return spaced if part.isascii() else spaced + len(IDEOGRAPH.findall(part))


def _from_each(counts: list[int], span: int, least_words: int) -> Iterator[tuple[int, int]]:
    """(first, end) of the shortest run from each sentence on, given the sentences' words, that is long enough."""
    end = words = 0
    for first, n in enumerate(counts):
        while end < len(counts) and (end - first < span or words < least_words):
            words += counts[end]
            end += 1
        if end - first < span or words < least_words:
            return
        yield first, end
        words -= n


def runs(counts: list[int], span: int, least_words: int) -> list[tuple[int, int]]:
    """(first, end) of the shortest long enough runs that start, and of those that end, with each sentence."""
    ending = {(len(counts) - end, len(counts) - first) for first, end in _from_each(counts[::-1], span, least_words)}
    return sorted(ending.union(_from_each(counts, span, least_words)))


def spans(documents: DataFrame, span: int = SPAN, least_words: int = LEAST_WORDS) -> DataFrame:
    """doc_id, mark (of the text), place (first sentence and number of sentences), h1, h2 for every span of every text of ``marked_documents``."""
    kind = pa.schema([("doc_id", pa.int64()), ("mark", pa.int32()), ("place", pa.int64()), ("h1", pa.int64()), ("h2", pa.int32())])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        digest = xxhash.xxh3_128_intdigest
        for batch in batches:
            out: list[list[int]] = [[], [], [], [], []]
            ids, marks, places, highs, lows = out
            for doc_id, mark, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                text = text.as_py().translate(_LOWER)
                parts = [" ".join(text[a:b].split()) for a, b in sentences(text)]
                packed = [p.encode("utf-8", "surrogatepass") for p in parts]
                at = [0]
                for p in packed:
                    at.append(at[-1] + len(p) + 1)
                data = memoryview(b"\n".join(packed))
                for i, end in runs(list(map(word_count, parts)), span, least_words):
                    h = digest(data[at[i] : at[end] - 1])
                    ids.append(doc_id)
                    marks.append(mark)
                    places.append(i << N_BITS | end - i)
                    highs.append((h >> 64) - (1 << 63))
                    lows.append((h & 0xFFFFFFFF) - (1 << 31))
                if len(ids) > 100_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, kind, strict=True)], schema=kind)
                    for c in out:
                        c.clear()
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, kind, strict=True)], schema=kind)

    return documents.mapInArrow(hashed, "doc_id long, mark int, place long, h1 long, h2 int")


def repeated_spans(documents: DataFrame, span: int = SPAN, least_words: int = LEAST_WORDS) -> DataFrame:
    """doc_id, mark, place, source_id: each span of a document that occurs earlier, with the document of its first occurrence.

    Earlier means in a document of smaller id, in another text of the id, or before in the same text.
    """
    found = spans(documents, span, least_words)
    here = F.struct("doc_id", "mark", "place")
    firsts = found.groupBy("h1", "h2").agg(F.min(here).alias("origin"), F.count("*").alias("n"))
    firsts = cut(firsts.where("n > 1").select("h1", "h2", "origin"))
    return found.join(firsts, ["h1", "h2"]).where(here != F.col("origin")).select("doc_id", "mark", "place", F.col("origin.doc_id").alias("source_id"))


def removed_sentences(documents: DataFrame, span: int = SPAN, least_words: int = LEAST_WORDS) -> DataFrame:
    """One row for each document that loses sentences: doc_id, mark, source_ids (sorted), places (of its repeated spans)."""
    later = repeated_spans(documents, span, least_words)
    return later.groupBy("doc_id", "mark").agg(F.sort_array(F.collect_set("source_id")).alias("source_ids"), F.sort_array(F.collect_set("place")).alias("places"))


def without_repeats(docs: DataFrame, span: int = SPAN, least_words: int = LEAST_WORDS) -> DataFrame:
    """The documents that lose sentences: doc_id, source_ids, n_sentences, n_removed, cuts (start, stop), text (the rest)."""
    documents = marked_documents(docs)
    marks = cut(removed_sentences(documents, span, least_words))
    schema = "doc_id long, source_ids array<long>, n_sentences int, n_removed int, cuts array<struct<start: int, stop: int>>, text string"
    kind = pa.schema([("doc_id", pa.int64()), ("source_ids", pa.list_(pa.int64())), ("n_sentences", pa.int32()), ("n_removed", pa.int32()), ("cuts", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))), ("text", pa.string())])

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in range(batch.num_rows):
                doc_id, sources, runs_of, text = (batch.column(i)[row].as_py() for i in range(4))
                places = sentences(text)
                gone = sorted({k for p in runs_of for k in range(p >> N_BITS, (p >> N_BITS) + (p & (1 << N_BITS) - 1))})
                cuts: list[dict] = []
                for n, i in enumerate(gone):
                    if n and gone[n - 1] == i - 1:
                        cuts[-1]["stop"] = places[i][1]
                    else:
                        cuts.append({"start": places[i][0], "stop": places[i][1]})
                kept, at = [], 0
                for c in cuts:
                    kept.append(text[at : c["start"]])
                    at = c["stop"]
                kept.append(text[at:])
                out.append({"doc_id": doc_id, "source_ids": sources, "n_sentences": len(places), "n_removed": len(gone), "cuts": cuts, "text": "".join(kept)})
            yield pa.RecordBatch.from_pylist(out, kind)

    joined = documents.join(marks, ["doc_id", "mark"]).select("doc_id", "source_ids", "places", "text")
    return joined.mapInArrow(remove, schema)


def op6_span_dedup(spark, sf_dir: str) -> DataFrame:
    return without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
