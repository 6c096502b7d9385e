"""BPE encoding as a streaming transducer with bounded lookahead, and decoding as an incremental state machine.

How far can later input change earlier tokens? A merge (u, v) that later input enables or prevents can next disturb a
merge of a larger rank whose right part is u or uv, and so on to the left. Each step needs a larger rank, so the chains
are finite; ``sufficient_lookahead`` is the length of the longest one, taken over the merge list from its end. Tokens
with that many symbols read behind them are final. The transducer keeps no more than that many symbols and the
longest token; what comes out is what encoding the whole would give.

The input is cut into the words of the tokenizer's own pre-tokenizer, at whose ends all tokens are final. Every word goes
through the transducer's window; what came out for words of ordinary length is remembered, up to a fixed number for each
Python worker. Text is read in pieces of READ_CHARS characters that end where neither a composed character nor a special
string can go on; a word that goes on beyond its piece stays open, so a text without white space, or one word of any
length, takes constant memory too.

The file is a ``tokenizers`` JSON file of the kind: NFC, white space, lower case; words by pattern; byte-level BPE with
a word-end suffix. Its path is a parameter and must be readable on every executor.
Defined cases: a null text counts as empty, has no tokens and decodes to the empty text; repeated rows give repeated
results; a very long text or word takes constant memory beside itself (a run of combining marks alone is held until it
ends); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import struct
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .stages import with_columns_of

REMEMBERED = 400_000
NO_MERGE = 1 << 60
#: Characters in which a long text is handed to the transducer.
READ_CHARS = 1 << 16
#: The white space of the tokenizer's patterns.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


@lru_cache(maxsize=1)
def later_letters() -> str:
    """Letters and digits of ``regex`` that the tokenizer's older Unicode tables lack, as ranges of a pattern's set."""
    from tokenizers import Regex, pre_tokenizers

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    new = "".join(c for c in regex.findall(r"[\p{L}\p{N}]", every) if unicodedata.category(c) == "Cn")
    unknown = {c for part, _ in pre_tokenizers.Split(Regex(r"[\p{L}\p{N}]"), "removed").pre_tokenize_str(new) for c in part}
    runs = regex.finditer(r"\S+", "".join(c if c in unknown else " " for c in every))
    return "".join(rf"\U{ord(m[0][0]):08x}-\U{ord(m[0][-1]):08x}" for m in runs)


def sufficient_lookahead(merges: list[tuple[str, str]], size: dict[str, int]) -> int:
    """Symbols behind a token after which no later input can change it; ``size``: symbols of each token."""
    reach: dict[str, int] = {}
    most = 0
    for left, right in reversed(merges):
        chain = max(reach.get(left, 0), reach.get(left + right, 0))
        most = max(most, size[right] + size[left] + chain)
        reach[right] = max(reach.get(right, 0), size[left] + chain)
    return most


class Window:
    """The symbols of one word, given piece by piece: ``push`` returns the tokens that are final, ``end`` the rest."""

    def __init__(self, model: BytePairs) -> None:
        self.model, self.symbols = model, []

    def push(self, symbols: list[str]) -> list[str]:
        model, out, at = self.model, [], 0
        while at < len(symbols):
            take = model.window - len(self.symbols)
            self.symbols += symbols[at : at + take]
            at += take
            if len(self.symbols) >= model.window:
                used = 0
                for token in model.merged(self.symbols[:]):
                    n = model.symbols.get(token, 1)
                    if used + n + model.lookahead > model.window:
                        break
                    out.append(token)
                    used += n
                self.symbols = self.symbols[used:]
        return out

    def end(self) -> list[str]:
        return self.model.merged(self.symbols)


class Transducer:
    """Encodes text given piece by piece: ``feed`` returns packed ids that are final, ``end`` the rest."""

    def __init__(self, model: BytePairs) -> None:
        self.model, self.pending = model, ""
        #: The normalised end of what was read, which later text may change.
        self.head = ""
        #: A word longer than a piece: what it goes on with, its window, and its last symbol.
        self.open: tuple[regex.Pattern, Window, str] | None = None

    def feed(self, text: str) -> bytes:
        self.pending += text
        at = self.model.safe_end(self.pending) if len(self.pending) >= READ_CHARS else 0
        ready, self.pending = self.pending[:at], self.pending[at:]
        return b"".join(self._read(ready, True)) if ready else b""

    def end(self) -> bytes:
        ready, self.pending = self.pending, ""
        return b"".join(self._read(ready, False))

    def _read(self, text: str, more: bool) -> Iterator[bytes]:
        model = self.model
        parts = model.split.split(text) if model.split else [text]
        for n, part in enumerate(parts):
            if n % 2:
                yield struct.pack("<I", model.special[part])
            else:
                yield from self._words(model.normalised(part), more and n == len(parts) - 1)

    def _words(self, part: str, more: bool) -> Iterator[bytes]:
        """Ids of the words of ``part``; with ``more`` to come what may still change is kept."""
        model, known, at = self.model, self.model.known, 0
        if self.head:
            part, self.head = self.head + part, ""
        if self.open is not None:
            found = self.open[0].match(part)
            at = found.end() if found else 0
            yield self._pushed(part[:at])
            if at == len(part) and more:
                return
            yield self._closed()
        pattern = model.pattern_for(part)
        if not more:
            for word in pattern.findall(part, at):
                ids = known.get(word)
                yield model.ids(word) if ids is None else ids
            return
        held: list[regex.Match] = []
        for m in pattern.finditer(part, at):
            if len(held) == 2:
                yield model.ids(held.pop(0)[0])
            held.append(m)
        if held and held[-1].end() == len(part):
            last = held.pop()
            if len(last[0]) >= READ_CHARS:
                opened = last[0]
            else:
                opened = ""
                # few letters may yet make another word with a mark before them
                joined = held and len(last[0]) < 4 and held[-1].end() == last.start()
                self.head = part[held.pop().start() if joined else last.start() :]
        else:
            opened = ""
        for m in held:
            yield model.ids(m[0])
        if opened:
            self.open = (model.letters if model.letters.match(opened) else model.marks, Window(model), "")
            yield self._pushed(opened)

    def _pushed(self, text: str) -> bytes:
        kind, window, last = self.open
        symbols = self.model.symbols_of(text)
        if not symbols:
            return b""
        self.open = (kind, window, symbols.pop())
        return self.model.packed(window.push([last, *symbols] if last else symbols))

    def _closed(self) -> bytes:
        (_, window, last), self.open = self.open, None
        return self.model.packed(window.push([last + self.model.suffix]) + window.end())


class BytePairs:
    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        merges = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]]
        self.rank = {m: i for i, m in enumerate(merges)}
        self.symbols = {t: len(t) - len(self.suffix) * t.endswith(self.suffix) if t != self.suffix else 1 for t in self.vocab}
        self.lookahead = sufficient_lookahead(merges, self.symbols)
        self.longest = max(self.symbols.values())
        self.window = 2 * (self.lookahead + self.longest)
        pattern = next(x["pattern"]["Regex"] for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        self.word = regex.compile(pattern.replace(r"[^\s", f"[^{WHITE}"))
        # for texts with letters that only ``regex`` knows: to the tokenizer they are neither letters nor digits
        later = later_letters()
        self.later = regex.compile(f"[{later}]") if later else None
        known = pattern.replace(r"[^\s\p{L}\p{N}]", rf"[[^{WHITE}\p{{L}}\p{{N}}]||[{later}]]")
        self.word_later = regex.compile("(?V1)" + known.replace(r"[\p{L}]", rf"[\p{{L}}--[{later}]]").replace(r"[\p{N}]", rf"[\p{{N}}--[{later}]]")) if later else self.word
        # what a word of letters, or of neither letters, digits nor white space, goes on with
        self.letters = regex.compile(rf"(?V1)[\p{{L}}--[{later}]]+" if later else r"\p{L}+")
        self.marks = regex.compile(rf"(?V1)[[^{WHITE}\p{{L}}\p{{N}}]||[{later}]]+" if later else rf"[^{WHITE}\p{{L}}\p{{N}}]+")
        self.longest_special = max(map(len, self.special), default=1)
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.alphabet = str.maketrans({chr(b): c for b, c in enumerate(byte_alphabet())})
        self.text = {i: t for t, i in [*self.vocab.items(), *self.special.items()]}
        self.bytes = {c: bytes([b]) for b, c in enumerate(byte_alphabet())}
        self.known: dict[str, bytes] = {}

    def normalised(self, text: str) -> str:
        # lower case character by character: no final sigma
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def safe_end(self, text: str) -> int:
        """The last place at which ``text`` may be cut whatever follows: within no special string, before no character that can combine with what is before it."""
        at = len(text) - self.longest_special
        while at > 0 and text[at] >= "\u0300" and (unicodedata.category(text[at])[0] == "M" or "\u1160" <= text[at] <= "\u11ff" or "\ud7b0" <= text[at] <= "\ud7ff"):
            at -= 1
        for m in self.split.finditer(text, max(0, at - self.longest_special), at + self.longest_special) if self.split else ():
            if m.start() < at < m.end():
                at = m.start()
        return max(0, at)

    def pattern_for(self, text: str) -> regex.Pattern:
        rare = self.later is not None and not text.isascii() and self.later.search(text)
        return self.word_later if rare else self.word

    def merged(self, parts: list[str]) -> list[str]:
        """Merges in place: the adjacent pair of the smallest rank first, the leftmost of equals."""
        get = self.rank.get
        ranks = [get(pair, NO_MERGE) for pair in zip(parts, parts[1:])]
        while ranks:
            best = min(ranks)
            if best == NO_MERGE:
                break
            i = ranks.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = get((parts[i - 1], parts[i]), NO_MERGE)
            if i < len(ranks):
                ranks[i] = get((parts[i], parts[i + 1]), NO_MERGE)
        return parts

    def symbols_of(self, text: str) -> list[str]:
        return list(text.encode("utf-8").decode("latin-1").translate(self.alphabet))

    def packed(self, tokens: list[str]) -> bytes:
        ids = [self.vocab[t] for t in tokens if t in self.vocab]
        return struct.pack(f"<{len(ids)}I", *ids)

    def tokens(self, word: str) -> list[str]:
        """Tokens of one word of the pre-tokenizer, through the transducer's window."""
        symbols, window = self.symbols_of(word), Window(self)
        symbols[-1] += self.suffix
        return window.push(symbols) + window.end()

    def ids(self, word: str) -> bytes:
        """Packed ids of one word of the pre-tokenizer."""
        found = self.known.get(word)
        if found is None:
            found = self.packed(self.tokens(word))
            if len(word) <= self.longest * 4:
                if len(self.known) >= REMEMBERED:
                    self.known.clear()
                self.known[word] = found
        return found

    def pieces(self, text: str) -> Iterator[bytes]:
        """The ids of a text as little-endian unsigned 32-bit integers, in pieces."""
        machine = Transducer(self)
        for at in range(0, len(text), READ_CHARS):
            yield machine.feed(text[at : at + READ_CHARS])
        yield machine.end()

    def encode(self, text: str) -> bytes:
        return b"".join(self.pieces(text))


class Decoder:
    """Turns packed ids into text piece by piece; bytes of an unfinished character or id wait for the next piece.

    Without a decoder in the tokenizer's file the text is that of the tokens with a space between them. ``plain``
    gives the text that they spell instead: bytes for the byte alphabet, a space for each word end.
    """

    def __init__(self, model: BytePairs, plain: bool = False) -> None:
        self.model, self.plain, self.started, self.rest = model, plain, False, b""
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, packed: bytes) -> str:
        packed = self.rest + packed
        whole = len(packed) // 4 * 4
        self.rest = packed[whole:]
        tokens = list(map(self.model.text.__getitem__, memoryview(packed[:whole]).cast("I")))
        if not self.plain:
            out = (" " if self.started and tokens else "") + " ".join(tokens)
            self.started = self.started or bool(tokens)
            return out
        return "".join(self._spelled(t) for t in tokens)

    def _spelled(self, token: str) -> str:
        ends = token.endswith(self.model.suffix) and token not in self.model.special
        body = token[: len(token) - len(self.model.suffix)] if ends else token
        data = body.encode() if token in self.model.special else b"".join(self.model.bytes[c] for c in body)
        return self.state.decode(data) + (" " if ends else "")

    def end(self) -> str:
        return self.state.decode(b"", True)


@lru_cache(maxsize=4)
def byte_pairs(path: str) -> BytePairs:
    return BytePairs(path)


def _mapped(docs: DataFrame, path: str, schema: str, of_text) -> DataFrame:
    rows = with_columns_of(docs, doc_id="bigint", text="string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = byte_pairs(path)
        for batch in batches:
            columns = list(zip(*[of_text(model, x.as_py() or "") for x in batch.column(1)], strict=True))
            if columns:
                yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns)], ["doc_id", *[x.split()[0] for x in schema.split(", ")]])

    return rows.mapInArrow(run, f"doc_id long, {schema}")


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids: the packed ids of every whole text of ``docs``."""
    return _mapped(docs, path, "n_tokens long, ids binary", lambda model, text: (len(ids := model.encode(text)) // 4, ids))


def decode(encoded: DataFrame, path: str, plain: bool = False) -> DataFrame:
    """doc_id and text of packed ids (doc_id, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = byte_pairs(path)
        for batch in batches:
            texts = []
            for ids in batch.column(1):
                machine = Decoder(model, plain)
                texts.append(machine.feed(ids.as_py() or b"") + machine.end())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return with_columns_of(encoded, doc_id="bigint", ids="binary").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for each row of ``docs``: encoded, and decoded from the ids."""

    def digests(model: BytePairs, text: str) -> tuple[int, str, str]:
        n, machine, of_ids, of_text = 0, Decoder(model), hashlib.sha256(), hashlib.sha256()
        for ids in model.pieces(text):
            n += len(ids) // 4
            of_ids.update(ids)
            of_text.update(machine.feed(ids).encode())
        of_text.update(machine.end().encode())
        return n, of_ids.hexdigest(), of_text.hexdigest()

    return _mapped(docs, path, "n_tokens long, ids_sha256 string, decoded_sha256 string", digests)


def op10_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), str(public_tokenizers.path("word_bpe_49k.json")))
