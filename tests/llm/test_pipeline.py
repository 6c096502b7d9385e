"""The pipeline against its stages done by plain Python, each on what the stage before kept."""

import hashlib
import struct

import public_tokenizers

import corpus_pipeline
from quillspark.llm import mixing, near_dedup, toxicity


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def test_stages_keep_the_columns_and_the_right_documents(spark, sf_dir, tmp_path):
    from tokenizers import Tokenizer

    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept, docs = {}, documents
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        if name != "bpe":
            assert out.columns == documents.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = docs.collect()
    before = {r.doc_id: r.text for r in documents.collect()}
    scores = {r.doc_id: r.predicted for r in toxicity.op5_toxicity(spark, sf_dir).collect()}
    assert {r.doc_id for r in kept["toxicity"]} == {d for d, p in scores.items() if not p}

    groups = {}
    for r in kept["toxicity"]:
        groups.setdefault(lowered(r.text), []).append(r.doc_id)
    assert sorted(r.doc_id for r in kept["exact_dedup"]) == sorted(max(ids) for ids in groups.values())

    exact = spark.read.parquet(str(tmp_path / "exact_dedup"))
    assert {r.doc_id for r in kept["near_dedup"]} == {r.doc_id for r in near_dedup.near_classes(exact).collect() if r.kept}

    near = spark.read.parquet(str(tmp_path / "near_dedup"))
    wanted = sorted(r.doc_id for r in mixing.mix(near).collect() if r.size for _ in range(r.taken // r.size))
    assert sorted(r.doc_id for r in kept["mixing"]) == wanted

    tokenizer = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    for r in kept["bpe"]:
        ids = tokenizer.encode(before[r.doc_id] or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest())
    assert sorted(r.doc_id for r in kept["bpe"]) == wanted


def test_run_gives_the_last_stage(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir)
    assert rows.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and rows.count() > 0


def small(spark, tmp_path, rows, labels):
    from cases import documents

    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return sorted((tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()), key=repr)


def test_no_documents(spark, tmp_path):
    assert small(spark, tmp_path, [], [(1, 1, 0)]) == []


def test_no_labels_and_awkward_rows(spark, tmp_path):
    from cases import AWKWARD

    got = small(spark, tmp_path, AWKWARD, [])
    # of the equal texts the largest id stays; rows without words are never taken
    assert {5, 7, 8, 9} <= {r[0] for r in got} <= {r[0] for r in AWKWARD} and not {1, 2, 3, 4, 6} & {r[0] for r in got}


def test_all_documents_toxic(spark, tmp_path):
    rows = [(i, f"you awful vile idiot number {i % 7}. hateful vile words again.") for i in range(60)]
    clean = [(100 + i, f"the garden is lovely today in part {i % 7}. we planted trees.") for i in range(60)]
    labels = [(i, 0, 1) for i in range(60)] + [(100 + i, 1, 0) for i in range(60)]
    both = small(spark, tmp_path, rows + clean, labels)
    assert both and all(r[0] >= 100 for r in both)


def test_a_stage_that_keeps_nothing(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(corpus_pipeline, "STAGES", [("toxicity", lambda spark, docs, sf_dir: docs.where("false")), *corpus_pipeline.STAGES[1:]])
    assert small(spark, tmp_path, [(1, "some words here"), (2, None)], []) == []
