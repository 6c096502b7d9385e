"""Both kinds of substring deduplication against brute force."""

import random
import re

from cases import AWKWARD, LONG, documents

from quillspark.llm import span_dedup, suffix_dedup


def word(rng):
    return "".join(rng.choice("abcdefghij") for _ in range(6))


def corpus(seed=9):
    """Texts of sentences; passages of several lengths, planted at any place of several documents."""
    rng = random.Random(seed)
    sentence = lambda: " ".join(word(rng) for _ in range(rng.randint(8, 14))).capitalize() + "."
    passages = [" ".join(sentence() for _ in range(n)) for n in (2, 3, 5, 6, 8, 30)]
    rows = []
    for d in range(60):
        parts = [sentence() for _ in range(rng.randint(3, 12))]
        for p in rng.sample(passages, rng.randint(0, 2)):
            parts.insert(rng.randint(0, len(parts)), p)
        rows.append((d, " ".join(parts)))
    return rows


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute_words(rows, n):
    """For each document the places of words in runs of ``n`` that occurred before."""
    seen, out = set(), {}
    for doc_id, text in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        w = words(text)
        for i in range(len(w) - n + 1):
            run = tuple(w[i : i + n])
            if run in seen:
                out.setdefault(doc_id, set()).update(range(i, i + n))
            seen.add(run)
    return out


def test_suffixes_find_what_brute_force_finds(spark):
    rows = corpus()
    wanted = brute_words(rows, suffix_dedup.PASSAGE)
    got = {r.doc_id: {i for c in r.cuts for i in range(c.start, c.stop)} for r in suffix_dedup.without_passages(documents(spark, rows)).collect()}
    assert set(got) == set(wanted)
    assert got == wanted


def test_suffixes_keep_the_first_and_the_rest_of_the_text(spark):
    passage = " ".join(f"p{i}" for i in range(70))
    rows = [(5, f"Alpha {passage} omega"), (3, f"beta {passage}"), (9, f"{passage.upper()} gamma delta")]
    got = {r.doc_id: r for r in suffix_dedup.without_passages(documents(spark, rows)).collect()}
    assert {d: (r.source_ids, r.n_removed, r.text.split()) for d, r in got.items()} == {5: ([3], 70, ["Alpha", "omega"]), 9: ([3], 70, ["gamma", "delta"])}


def test_suffixes_within_a_text_and_a_passage_that_all_share(spark):
    common = " ".join(f"c{i}" for i in range(60))
    rows = [(d, f"own{d} {common} tail{d} {' '.join(f'u{d}x{i}' for i in range(30))}") for d in range(40)] + [(100, f"{' '.join(f'q{i}' for i in range(55))} gap {' '.join(f'q{i}' for i in range(55))}")]
    got = {r.doc_id: (r.source_ids, r.n_removed) for r in suffix_dedup.without_passages(documents(spark, rows)).collect()}
    assert got == {d: ([0], 60) for d in range(1, 40)} | {100: ([100], 55)}


def test_suffixes_that_never_stand_side_by_side(spark):
    """Passages of 50 words whose last 31 many others share: neither neighbour in the sorted array has the whole."""
    rng, rows, d = random.Random(3), [], 0
    for g in range(12):
        passage = [f"p{g}x{i}" for i in range(50)]
        for k in range(6):
            shared = passage if k in (0, 3) else passage[19:]
            rows.append((d, " ".join([*(word(rng) for _ in range(12)), *shared, *(word(rng) for _ in range(12))])))
            d += 1
    wanted = brute_words(rows, suffix_dedup.PASSAGE)
    got = {r.doc_id: {i for c in r.cuts for i in range(c.start, c.stop)} for r in suffix_dedup.without_passages(documents(spark, rows)).collect()}
    assert set(wanted) == {6 * g + 3 for g in range(12)} and got == wanted


def test_suffixes_of_a_hot_line_with_many_contexts(spark):
    rng = random.Random(8)
    line = [f"l{i}" for i in range(40)]
    sides = [[word(rng) for _ in range(25)] for _ in range(6)]
    rows = [(d, " ".join([*(word(rng) for _ in range(20)), *rng.choice(sides)[rng.randint(0, 24) :], *line, *rng.choice(sides)[: rng.randint(0, 24)], *(word(rng) for _ in range(20))])) for d in range(150)]
    wanted = brute_words(rows, suffix_dedup.PASSAGE)
    got = {r.doc_id: {i for c in r.cuts for i in range(c.start, c.stop)} for r in suffix_dedup.without_passages(documents(spark, rows)).collect()}
    assert got == wanted


def test_suffixes_of_several_texts_of_one_id(spark):
    passage, other = " ".join(f"p{i}" for i in range(70)), " ".join(f"o{i}" for i in range(90))
    got = suffix_dedup.without_passages(documents(spark, [(1, passage), (2, f"start {passage}"), (2, other), (2, other)])).collect()
    assert [(r.doc_id, r.source_ids, r.n_removed, r.text.strip()) for r in got] == [(2, [1], 70, "start")]


def test_suffixes_of_awkward_rows(spark):
    got = {r.doc_id: r.source_ids for r in suffix_dedup.without_passages(documents(spark, AWKWARD + [(6, LONG), (40, "la " * 400)])).collect()}
    # the long text twice over, once in capitals; a word said over and over repeats itself
    assert got[7] == [6] and got[40] == [40] and set(got) == {7, 40}
    assert suffix_dedup.without_passages(documents(spark, [])).count() == 0


def brute_sentences(rows, span, least):
    """For each document the numbers of sentences in minimal runs that occurred before; a run is minimal if it can lose its first or its last sentence to nothing."""
    seen, out = set(), {}
    for doc_id, text in sorted((r for r in rows if r[0] is not None and r[1]), key=lambda r: r[0]):
        parts = [" ".join(words(text[a:b])) for a, b in span_dedup.sentences(text)]
        enough = lambda i, end: end - i >= span and sum(len(p.split()) for p in parts[i:end]) >= least
        for i in range(len(parts)):
            for end in range(i + 1, min(len(parts), i + least) + 1):
                if enough(i, end) and (not enough(i, end - 1) or not enough(i + 1, end)):
                    run = tuple(parts[i:end])
                    if run in seen:
                        out.setdefault(doc_id, set()).update(range(i, end))
                    seen.add(run)
    return out


def test_spans_find_what_brute_force_finds(spark):
    rows = corpus(11)
    wanted = brute_sentences(rows, span_dedup.SPAN, span_dedup.LEAST_WORDS)
    texts = dict(rows)
    got = {r.doc_id: r for r in span_dedup.without_repeats(documents(spark, rows)).collect()}
    assert {d: r.n_removed for d, r in got.items()} == {d: len(s) for d, s in wanted.items()}
    for d, r in got.items():
        kept = "".join(x for x in _outside(texts[d], r.cuts))
        assert r.text == kept and min(r.source_ids) < d


def _outside(text, cuts):
    at = 0
    for c in cuts:
        yield text[at : c.start]
        at = c.stop
    yield text[at:]


def test_the_last_short_sentences_of_a_passage_go(spark):
    sentence = lambda n, k: " ".join(f"w{k}x{i}" for i in range(n)) + "."
    passage = " ".join(sentence(n, k) for k, n in enumerate((14, 14, 14, 10)))
    rows = [(d, f"{sentence(9, f'a{d}')} {passage} {sentence(9, f'b{d}')}") for d in range(3)]
    assert {r.doc_id: r.n_removed for r in span_dedup.without_repeats(documents(spark, rows)).collect()} == {1: 4, 2: 4}


def test_spans_of_several_texts_of_one_id(spark):
    prose = " ".join(f"Sentence number {i} has some words in it." for i in range(6))
    other = " ".join(f"Quite another line {i} stands here instead." for i in range(6))
    got = span_dedup.without_repeats(documents(spark, [(1, prose), (2, f"Start of it. {prose}"), (2, other)])).collect()
    assert [(r.doc_id, r.source_ids, r.text.strip()) for r in got] == [(2, [1], "Start of it.")]


def test_spans_of_text_without_spaces(spark):
    passage = "今日の会議では予算について話しました。来週までに資料を準備することになりました。担当は田中さんです。"
    rows = [(1, passage), (2, f"これは別の文です。{passage}最後の一文はここにあります！"), (3, "全く違う内容の文章がここに書かれています。")]
    assert [(r.doc_id, r.n_removed, r.text) for r in span_dedup.without_repeats(documents(spark, rows)).collect()] == [(2, 3, "これは別の文です。最後の一文はここにあります！")]


def test_spans_of_awkward_rows(spark):
    prose = " ".join(f"Sentence number {i} has some words in it." for i in range(6))
    rows = AWKWARD + [(50, prose), (50, prose), (51, f"Other start. {prose}"), (52, "Yes! No! Yes! No!"), (53, "Yes! No! Yes! No!")]
    got = {r.doc_id: r.source_ids for r in span_dedup.without_repeats(documents(spark, rows)).collect()}
    assert got == {51: [50]}
    assert span_dedup.without_repeats(documents(spark, [])).count() == 0
