import random

import numpy as np
import pyarrow as pa
from cases import AWKWARD, documents

from quillspark.llm import near_dedup as nd
from quillspark.llm.words import words_of


def texts_with_variants(n_groups=12, seed=4):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(4000)]
    rows, doc_id = [], 100
    for _ in range(n_groups):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(80, 300))]
        for k in range(rng.randint(1, 7)):
            words = list(base)
            for _ in range(k * len(words) // 200):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append((doc_id, " ".join(words)))
            doc_id += 1
    return rows


def brute_pairs(rows):
    """Weighted Jaccard of all pairs, by dictionaries."""
    words = words_of(pa.array([t or "" for _, t in rows]))[2]
    frequency = {}
    per_doc = [[int(h) >> (64 - nd.DF_BITS) for h in words.hash[a:b]] for a, b in zip(words.first, words.first[1:])]
    for entries in per_doc:
        for e in set(entries):
            frequency[e] = frequency.get(e, 0) + 1
    tokens = [tuple(int(h) for h in words.hash[a:b]) for a, b in zip(words.first, words.first[1:])]
    idf = lambda h: np.float32(np.log((1 + len(rows)) / (1 + frequency[h >> (64 - nd.DF_BITS)])) + 1)
    weights = []
    for t in tokens:
        runs = [t[i : i + 5] for i in range(len(t) - 4)] or ([t] if t else [])
        w = {}
        for r in runs:
            w[r] = w.get(r, 0) + float(np.mean([idf(h) for h in r]))
        weights.append(w)
    sims = {}
    for i in range(len(rows)):
        for j in range(i):
            a, b = weights[i], weights[j]
            top = sum(min(a[k], b[k]) for k in a.keys() & b.keys())
            total = sum(a.values()) + sum(b.values()) - top
            sims[i, j] = top / total if total else float(tokens[i] == tokens[j])
    return sims


def test_classes_are_those_of_all_pairs(spark):
    rows = texts_with_variants()
    sims = brute_pairs(rows)
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for (i, j), s in sims.items():
        if s >= nd.SIMILARITY:
            root[max(find(i), find(j))] = min(find(i), find(j))
    wanted = {rows[i][0]: rows[find(i)][0] for i in range(len(rows))}
    got = {r.doc_id: r.class_id for r in nd.near_classes(documents(spark, rows)).collect()}
    near_the_limit = {rows[k][0] for (i, j), s in sims.items() if abs(s - nd.SIMILARITY) < 0.02 for k in (i, j)}
    assert {d: c for d, c in got.items() if d not in near_the_limit} == {d: c for d, c in wanted.items() if d not in near_the_limit}


def classes_of_all_pairs(rows):
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for (i, j), s in brute_pairs(rows).items():
        if s >= nd.SIMILARITY:
            root[max(find(i), find(j))] = min(find(i), find(j))
    return {rows[i][0]: rows[find(i)][0] for i in range(len(rows))}


def linked_in_one_bucket(spark, rows):
    """The class of each of ``rows`` by the links found where all of them share one band and no other."""
    docs = documents(spark, rows)
    idf = spark.sparkContext.broadcast(nd.idf_table(nd.document_frequencies(docs)))
    nodes = nd.signatures(docs, idf).selectExpr("doc_id AS node", "same", "doc_id", "array(7L) AS bands")
    roots = {r.node: r.root for r in nd.components(nd.near_links(docs, nodes, idf)).collect()}
    least = {}
    for d, _ in rows:
        least[roots.get(d, d)] = min(d, least.get(roots.get(d, d), d))
    return {d: least[roots.get(d, d)] for d, _ in rows}


def test_loose_variants_without_a_hub_are_joined_as_by_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(nd, "BLOCK", 100, raising=False)
    rng = random.Random(3)
    rows = []
    for d, chosen in enumerate(rng.sample(range(1 << 11), 400)):
        rows.append((d, " ".join(f"e{i // 9}" if i % 9 == 4 and chosen >> (i // 9) & 1 else f"b{i}" for i in range(100))))
    assert linked_in_one_bucket(spark, rows) == classes_of_all_pairs(rows)


def test_chains_of_edits_are_one_class_each(spark):
    rows = []
    for chain in range(5):
        words = [f"c{chain}x{i}" for i in range(80)]
        for step in range(7):
            rows.append((7 * chain + step, " ".join(words)))
            words[4 + 31 * step % 72] = f"c{chain}s{step}"
    wanted = classes_of_all_pairs(rows)
    assert sorted(set(wanted.values())) == [0, 7, 14, 21, 28]
    assert linked_in_one_bucket(spark, rows) == wanted


def test_draws_agree_as_often_as_texts_are_similar():
    rng = np.random.default_rng(0)
    code = np.sort(rng.integers(0, 1 << 63, 600, dtype=np.uint64))
    a, b = rng.uniform(1, 3, 600), rng.uniform(1, 3, 600)
    sim = nd.weighted_jaccard(code, a, code, b)
    names = nd.samples(np.concatenate([code, code]), np.concatenate([a, b]), np.array([0, 600, 1200]))
    assert abs((names[0] == names[1]).mean() - sim) < 4 * (sim * (1 - sim) / names.shape[1]) ** 0.5


def test_a_large_group_of_variants_is_one_class(spark):
    rng = random.Random(1)
    base = [f"b{i}" for i in range(400)]
    rows = []
    for d in range(300):
        words = list(base)
        for _ in range(4):
            words[rng.randrange(400)] = f"r{d}x{rng.random()}"
        rows.append((d, " ".join(words)))
    rows.append((999, " ".join(base)))
    classes = [r.class_id for r in nd.near_classes(documents(spark, rows)).collect()]
    assert max(classes.count(c) for c in set(classes)) >= 0.98 * len(rows)


def test_links_are_similar_pairs_and_join_the_classes(spark):
    rows = texts_with_variants(8, seed=9)
    rows += [(900 + i, t.upper()) for i, (_, t) in enumerate(rows[:5])]  # the same words
    docs, sims, at = documents(spark, rows), brute_pairs(rows), {d: i for i, (d, _) in enumerate(rows)}
    classes = {r.doc_id: r for r in nd.near_classes(docs).collect()}
    pairs = [(r.a, r.b, r.similarity) for r in nd.near_pairs(docs).collect()]
    assert len({p[:2] for p in pairs}) == len(pairs) > 0
    root, ends = {d: classes[d].text_id for d in classes}, []
    for a, b, s in pairs:
        assert a < b and s >= nd.SIMILARITY and abs(s - sims[max(at[a], at[b]), min(at[a], at[b])]) < 1e-4
        ends += [a, b]
        old, new = root[b], root[a]
        root = {d: new if r == old else r for d, r in root.items()}
    assert all((root[a] == root[b]) == (classes[a].class_id == classes[b].class_id) for a in root for b in root)
    assert {d: r.links for d, r in classes.items()} == {d: ends.count(r.text_id) for d, r in classes.items()}
    least = {}
    for d, t in rows:
        least[t.lower()] = min(d, least.get(t.lower(), d))
    assert {d: r.text_id for d, r in classes.items()} == {d: least[t.lower()] for d, t in rows}


def test_awkward_rows(spark):
    rows = AWKWARD + [(50, "one two three"), (51, "ONE two  three"), (52, "one two four")]
    got = nd.near_classes(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    by_id = {}
    for r in got:
        by_id.setdefault(r.doc_id, set()).add((r.class_id, r.class_size))
    assert by_id[1] == by_id[2] == by_id[3] == {(1, 3)} and by_id[4] == by_id[5] == {(4, 3)} and by_id[6] == by_id[7] == {(6, 2)}
    assert by_id[None] == {(None, 1)} and by_id[50] == by_id[51] == {(50, 2)} and by_id[52] == {(52, 1)}
    assert {r.links for r in got if r.doc_id in (None, 1, 4, 50, 52)} == {0} and {r.text_id for r in got if r.doc_id in (50, 51)} == {50}
    assert nd.near_classes(documents(spark, [])).count() == nd.near_pairs(documents(spark, [])).count() == 0


def test_dropping_keeps_one_of_each_class(spark):
    docs = documents(spark, AWKWARD)
    kept = nd.drop_near(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 4, 4, 6, 8, 9]


def test_long_chains_and_stars_contract(spark):
    chain = [(i, i + 1) for i in range(200)] + [(1000 + i, 1000 + i * 7 % 101) for i in range(101)] + [(5000, 4000 + i) for i in range(300)]
    roots = {r.node: r.root for r in nd.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert len({roots[i] for i in range(201)}) == 1 and len({roots[4000 + i] for i in range(300)} | {roots[5000]}) == 1
    assert not {roots[i] for i in range(201)} & {roots[4000 + i] for i in range(300)}
