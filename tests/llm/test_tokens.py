"""Token counts and BPE against the libraries that define them."""

import hashlib
import random
import struct
import time
from functools import lru_cache

import public_tokenizers
import pytest
from cases import AWKWARD, documents
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.llm import bpe_stream as bs
from quillspark.llm import token_counts as tc

PIECE, WORD = str(public_tokenizers.path("piece_bpe_32k.model")), str(public_tokenizers.path("word_bpe_49k.json"))
TEXT = st.text(st.one_of(st.sampled_from(list("abcdethe  \n\t.,!'0129éßçñ▁ΣİΩ日本語😀’")), st.characters(exclude_categories=["Cs"])), max_size=120)
ODD = ["", " ", "  a  b ", "\n\n", "a\nb\n", "\t tab", " lead", "trail ", "▁▁x", "<s> </s> <unk>", "İ ΑΣ Σ ΣΑΣ.", "'s it's 'LL", "1234 56", "é é", "<|endoftext|>a<|startoftext|>", "x" * 3000, "😀" * 100]


@lru_cache
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORD)


@lru_cache
def pieces():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PIECE)


@pytest.fixture(scope="module")
def piece():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PIECE)


@pytest.fixture(scope="module")
def word():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORD)
    t.no_truncation()
    t.no_padding()
    return t


def ids_of(packed):
    return list(struct.unpack(f"<{len(packed) // 4}I", packed))


def texts(spark, sf_dir):
    return [r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]


def test_counts_are_the_librarys(spark, sf_dir, piece):
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in tc.op7_token_counts(spark, sf_dir).collect()}
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    wanted = {r.doc_id: (len((r.text or "").encode()), len(piece.encode(r.text or "")), len(piece.encode(r.text or "")) > 4096) for r in rows}
    assert got == wanted


@pytest.mark.parametrize("text", ODD)
def test_counts_of_odd_texts(piece, text):
    assert tc.prefix_table(PIECE).count(text) == len(piece.encode(text))


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_counts_of_any_text(text):
    assert tc.prefix_table(PIECE).count(text) == len(pieces().encode(text))


def test_prefixes_answer_budgets_without_encoding_again(spark, piece):
    rng = random.Random(2)
    rows = [(i, " ".join("".join(rng.choice("theaninor") for _ in range(rng.randint(1, 9))) for _ in range(40))) for i in range(10)]
    rows += [(100 + i, t) for i, t in enumerate(ODD) if "▁" not in t and len(t) < 200] + [(200, None), (201, "日本語 🙂 ok")]
    tables = tc.prefix_counts(documents(spark, rows), PIECE)
    for r in tables.collect():
        text = dict(rows)[r.doc_id] or ""
        assert [len(piece.encode(text[:n])) for n in range(len(text) + 1)] == r.counts, text
    for budget in (0, 25):
        for r in tc.within_budget(tables, budget).collect():
            text = dict(rows)[r.doc_id] or ""
            assert (r.n_tokens, r.fits) == (len(piece.encode(text)), len(piece.encode(text)) <= budget)
            assert text.startswith(r.text) and len(r.text) == r.n_chars and len(piece.encode(r.text)) <= budget
            assert all(len(piece.encode(text[:n])) > budget for n in range(len(r.text) + 1, len(text) + 1))


def test_times_grow_in_proportion_to_a_words_length():
    table, model, rng = tc.prefix_table(PIECE), bs.byte_pairs(WORD), random.Random(4)
    word = "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/") for _ in range(200_000))

    def seconds(f):
        began = time.process_time()
        f()
        return time.process_time() - began

    for f in (lambda n: list(table.prefixes(word[:n])), lambda n: model.encode(word[:n]), lambda n: model.encode(word[:n].translate(LETTERS))):
        f(2000)
        assert seconds(lambda: f(200_000)) < 30 * max(0.05, seconds(lambda: f(20_000)))  # noqa: B023


LETTERS = str.maketrans("0123456789+/", "zyxwvutsrqpo")


def test_a_text_without_white_space_takes_constant_memory():
    """Fed a piece at a time, the machine holds no more than a piece, and gives what the library gives."""
    rng, model = random.Random(5), bs.byte_pairs(WORD)
    for alphabet in ("abcdefghij", "ab1'-<|>.s", "?!-.", "e\u0301a\u0300\u1100\u1161\u11a8Σ", "日本語ab"):
        text = "".join(rng.choice(alphabet) for _ in range(300_000)) + "<|endoftext|>" + "".join(rng.choice(alphabet) for _ in range(200_000))
        machine, out = bs.Transducer(model), []
        for at in range(0, len(text), 50_000):
            out.append(machine.feed(text[at : at + 50_000]))
            assert len(machine.pending) + len(machine.head) < 4 * bs.READ_CHARS
            assert machine.open is None or len(machine.open[1].symbols) <= model.window
        out.append(machine.end())
        assert ids_of(b"".join(out)) == library().encode(text, add_special_tokens=False).ids


def test_awkward_rows(spark, piece, word):
    docs = documents(spark, AWKWARD)
    key = lambda r: (r[0] is not None, r[0], r[1:])
    assert sorted((tuple(r)[:3] for r in tc.count_tokens(docs, PIECE).collect()), key=key) == sorted(((d, len((t or "").encode()), len(piece.encode(t or ""))) for d, t in AWKWARD), key=key)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    wanted = []
    for d, t in AWKWARD:
        ids = word.encode(t or "", add_special_tokens=False).ids
        wanted.append((d, len(ids), sha(struct.pack(f"<{len(ids)}I", *ids)), sha(word.decode(ids, skip_special_tokens=False).encode())))
    assert sorted(map(tuple, bs.round_trip(docs, WORD).collect()), key=key) == sorted(wanted, key=key)
    for f in (lambda d: tc.count_tokens(d, PIECE), lambda d: bs.round_trip(d, WORD)):
        assert f(documents(spark, [])).count() == 0


def test_bpe_is_the_librarys(spark, sf_dir, word):
    model = bs.byte_pairs(WORD)
    for text in [*texts(spark, sf_dir), *ODD]:
        assert ids_of(model.encode(text)) == word.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_bpe_of_any_text(text):
    model, t = bs.byte_pairs(WORD), library()
    ids = t.encode(text, add_special_tokens=False).ids
    machine = bs.Decoder(model)
    assert ids_of(model.encode(text)) == ids and machine.feed(model.encode(text)) + machine.end() == t.decode(ids, skip_special_tokens=False)


def test_tokens_of_a_long_word_are_final_once_emitted():
    """The transducer in its small window gives what merging the whole word gives."""
    rng, model = random.Random(7), bs.byte_pairs(WORD)
    for alphabet in ("ab", "theinorst", "xyzq"):
        word = "".join(rng.choice(alphabet) for _ in range(4000))
        symbols = model.symbols_of(word)
        symbols[-1] += model.suffix
        assert model.tokens(word) == model.merged(symbols)


def test_feeding_in_pieces_changes_nothing():
    rng, model = random.Random(3), bs.byte_pairs(WORD)
    text = "".join(rng.choice("the in or\n é 12 ") for _ in range(300_000))
    machine, out = bs.Transducer(model), []
    for at in range(0, len(text), 7777):
        out.append(machine.feed(text[at : at + 7777]))
    assert b"".join([*out, machine.end()]) == model.encode(text) == b"".join(bs.Transducer(model)._read(text, False))


def test_decoding_in_pieces_and_to_the_spelled_text(spark):
    model, text = bs.byte_pairs(WORD), "naïve 😀 日本 test"
    packed, machine = model.encode(text), bs.Decoder(model, plain=True)
    got = "".join(machine.feed(packed[i : i + 3]) for i in range(0, len(packed), 3)) + machine.end()
    assert got.strip() == text
    docs = documents(spark, [(1, text)])
    assert bs.decode(bs.encode(docs, WORD), WORD, plain=True).first().text.strip() == text
