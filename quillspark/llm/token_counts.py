"""Exact token counts of a sentencepiece BPE vocabulary at every prefix of a text, by dynamic programming.

A sequence of tokens is what BPE makes of its text exactly when every two adjacent tokens are what BPE makes of theirs.
So each prefix has one possible last token: one that ends there and stands well after the last token of the prefix
before it. The table of last tokens is filled from left to right, and with it

    count[i] = count[i - len(last)] + 1

holds the token count of *every* prefix. ``prefix_counts`` stores it; truncation to a token budget and the check whether a
text fits (``within_budget``) are lookups in that table; nothing is encoded again. Where only the whole's count is wanted,
the last entries of the chunks' tables are added up.

The vocabulary has no piece in which something else than a space precedes a space, and none with a line break or tab
and another character, so a text falls into chunks (spaces and the word after them) whose tables are independent;
their counts add up. Tables of chunks are remembered, up to a fixed number for each Python worker.

The vocabulary comes from a ``.model`` file (its path is a parameter) that every executor can open.
Defined cases: a null text counts as empty and has no tokens; a very long text, or word, takes time and memory in
proportion to its length (a table has four bytes for each character); columns other than id and text are ignored;
repeated rows give repeated results; a prefix of a negative budget is empty; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stages import with_columns_of

TOKEN_LIMIT = 4096
REMEMBERED = 400_000
#: Characters of the longest chunk whose count is remembered.
REMEMBERED_CHARS = 64
SPACE = "▁"


class PrefixTable:
    """The table for one vocabulary: ``chunk(text)`` fills it for a text without inner spaces."""

    def __init__(self, model: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        skip = lambda i: sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)
        self.score = {sp.id_to_piece(i): sp.get_score(i) for i in range(sp.get_piece_size()) if not skip(i)}
        inner = next((p for p in self.score if SPACE in p.lstrip(SPACE) or (len(p) > 1 and re.search(r"[\n\t]", p))), None)
        if inner is not None:
            raise ValueError(f"not a vocabulary whose words are independent: {inner!r}")
        self.longest = max(map(len, self.score))
        self.space_run = max(len(p) for p in self.score if not p.strip(SPACE))
        self.stands: dict[tuple[str, str], bool] = {}
        self.alone: dict[str, bool] = {}
        self.counts: dict[str, int] = {}

    def merged(self, text: str) -> list[str]:
        """BPE of a short string: the adjacent pair with the best merged piece first, the leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.score.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def follows(self, left: str, right: str) -> bool:
        """Whether BPE makes exactly these two tokens of their joined text."""
        if len(self.stands) >= REMEMBERED:
            self.stands.clear()
        found = self.stands[left, right] = self.merged(left + right) == [left, right]
        return found

    def whole(self, piece: str) -> bool:
        """Whether BPE makes one token of the piece; remembered for the pieces of the vocabulary only."""
        if piece not in self.score:
            return len(piece) == 1
        found = self.alone.get(piece)
        if found is None:
            found = self.alone[piece] = self.merged(piece) == [piece]
        return found

    def lasts(self, text: str) -> list[str]:
        """The last token of every prefix of ``text``, which has a space at its start at most."""
        last, score, alone, stands = [""], self.score, self.alone, self.stands
        for end in range(1, len(text) + 1):
            for start in range(end - 1, max(-1, end - 1 - self.longest), -1):
                piece = text[start:end]
                if (alone.get(piece) if piece in score and piece in alone else self.whole(piece)) and start:
                    left = last[start]
                    found = stands.get((left, piece))
                    if found or (found is None and self.follows(left, piece)):
                        last.append(piece)
                        break
                elif not start and self.whole(piece):
                    last.append(piece)
                    break
            else:
                raise AssertionError(f"no last token for {text[:end]!r}")
        return last

    def price(self, piece: str) -> int:
        """Tokens of a piece: one, or its UTF-8 bytes where the vocabulary lacks the character."""
        return 1 if piece in self.score else len(piece.encode("utf-8", "surrogatepass"))

    def chunk(self, text: str) -> list[int]:
        """count[i] for every prefix of ``text``."""
        count = [0]
        for end, piece in enumerate(self.lasts(text)[1:], 1):
            count.append(count[end - len(piece)] + (1 if piece in self.score else self.price(piece)))
        return count

    def of_chunk(self, text: str) -> int:
        found = self.counts.get(text)
        if found is None:
            found = self.chunk(text)[-1]
            if len(text) <= REMEMBERED_CHARS:
                if len(self.counts) >= 2 * REMEMBERED:
                    self.counts.clear()
                self.counts[text] = found
        return found

    def _spaces(self, n: int) -> int:
        return -(-n // self.space_run)

    def of_run(self, n: int, word: str) -> list[int]:
        """count[i] for every prefix of ``n`` spaces and a word; the last space goes with the word if its first token takes it."""
        if n == 0:
            return self.chunk(word)
        out = [self._spaces(i) for i in range(n + 1)]
        if not word:
            return out
        last = self.lasts(SPACE + word)
        count, alone = [0, self.price(SPACE)], [False, True]  # alone: the path to here leaves the space a token of its own
        for end in range(2, len(last)):
            start = end - len(last[end])
            count.append(count[start] + self.price(last[end]))
            alone.append(alone[start])
            out.append(count[end] - 1 + out[n] if alone[end] else count[end] + out[n - 1])
        return out

    def _run(self, n: int, word: str) -> int:
        """Tokens of ``n`` spaces and a word."""
        if not word:
            return self._spaces(n)
        return self.of_chunk(SPACE * min(n, 1) + word) if n < 2 else self.of_run(n, word)[-1]

    def prefixes(self, text: str) -> Iterator[int]:
        """The tokens of every prefix of the text, from the empty one to the whole."""
        if not text:
            yield 0
            return
        tokens, first = 0, True
        for n, word, mark in self._chunks(text):
            counts = [0, 1] if mark else self.of_run(n, word)
            # the space that is put before a text is not one of its characters: of its own prefixes the empty one has no token
            for at, count in enumerate(counts[1:], 1):
                if not first or at > 1:
                    yield tokens + count
                else:
                    yield 0
            tokens, first = tokens + counts[-1], False

    def _chunks(self, text: str) -> Iterator[tuple[int, str, str]]:
        for found in re.finditer(rf"({SPACE}*)([^{SPACE}\n\t]+)|({SPACE}+)|([\n\t])", SPACE + text.replace(" ", SPACE) if text else ""):
            spaces, word, only, mark = found.groups()
            yield len(spaces or only or ""), word or "", mark or ""

    def count(self, text: str) -> int:
        """Tokens of the whole text."""
        if not text:
            return 0
        text, total, known = text.replace(SPACE, " "), 0, self.counts
        if "\t" in text or "  " in text or "\n " in text or " \n" in text or text[0] == " " or text[-1] in " \n":
            return sum(1 if mark else self._run(n, word) for n, word, mark in self._chunks(text))
        lines = (SPACE + text.replace(" ", " " + SPACE)).split("\n")
        total = len(lines) - 1
        for line in lines:
            for word in line.split(" "):
                n = known.get(word)
                total += self.of_chunk(word) if n is None else n
        return total


@lru_cache(maxsize=4)
def prefix_table(model: str) -> PrefixTable:
    return PrefixTable(model)


def count_tokens(docs: DataFrame, model: str, limit: int = TOKEN_LIMIT) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, n_bytes, n_tokens, over_limit."""
    rows = with_columns_of(docs, doc_id="bigint", text="string")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = prefix_table(model)
        for batch in batches:
            counts = [table.count(x.as_py() or "") for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    rows = rows.withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    out = rows.mapInArrow(counted, "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def prefix_counts(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, text and ``counts``: the tokens of every prefix of the text, by its characters, from the empty prefix on."""
    rows = with_columns_of(docs, doc_id="bigint", text="string")

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = prefix_table(model)
        for batch in batches:
            for i in range(batch.num_rows):  # a table has four bytes for each character: one at a time
                counts = np.fromiter(table.prefixes((batch.column(1)[i].as_py() or "").replace(SPACE, " ")), np.int32)
                lists = pa.ListArray.from_arrays(pa.array([0, len(counts)], pa.int32()), pa.array(counts))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), batch.column(1).slice(i, 1), lists], ["doc_id", "text", "counts"])

    return rows.mapInArrow(tables, "doc_id long, text string, counts array<int>")


def within_budget(tables: DataFrame, budget: int) -> DataFrame:
    """doc_id, n_tokens, fits, n_chars and ``text`` (its longest prefix of at most ``budget`` tokens), looked up in ``prefix_counts``."""
    n_tokens = F.element_at("counts", -1)
    after = F.array_position(F.transform(F.reverse("counts"), lambda c: c <= budget), True)
    rows = tables.select("doc_id", n_tokens.cast("long").alias("n_tokens"), (n_tokens <= budget).alias("fits"), (F.size("counts") - after).cast("int").alias("n_chars"), "text")
    return rows.withColumn("text", F.expr("substring(coalesce(text, ''), 1, n_chars)"))


def op7_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), str(public_tokenizers.path("piece_bpe_32k.model")))
