"""Runs of recordings and summaries by an injected model."""

from pyspark.sql import functions as F

from quillspark.operators import responses, runs, summaries


def test_ring_keeps_the_newest(spark):
    rows = spark.createDataFrame([(1, 0, 6, 0), (1, 1, 6, 2), (1, 2, 25, 100)], "stream long, seq long, written long, read long")
    assert tuple(runs.ring_overruns(rows, 10).first()) == (1, 22, 0, 3, 25 - 10 + 2 + 8)


def test_first_decoder_that_accepts_else_the_most_specific_reason(spark):
    rows = spark.createDataFrame([("a", "x", 0, False, "no"), ("a", "y", 1, True, None), ("b", "x", 0, False, "no"), ("b", "y", 1, False, "damaged head")], "path string, decoder string, priority int, accepts boolean, reason string")
    assert sorted(map(tuple, runs.chosen_decoders(rows).collect())) == [("a", "y", None), ("b", None, "damaged head")]


def test_no_devices_is_an_error_for_each_kind(spark):
    rows = spark.createDataFrame([], "kind string, name string, is_default boolean")
    assert [tuple(r) for r in runs.device_checks(rows, ["capture"]).collect()] == [("capture", "Error", "none")]


def test_audio_is_kept_unless_a_completed_run_was_to_delete_it(spark):
    rows = spark.createDataFrame([("Completed", True), ("Completed", False), ("Failed", True)], "o string, d boolean")
    assert [r[0] for r in rows.select(runs.keeps_recognition_audio(F.col("o"), F.col("d"))).collect()] == [False, True, True]


def lines(spark, n):
    return spark.createDataFrame([(1, i, f"[00:{i:02d}:00] x: {'y' * 30}\n") for i in range(n)], "response_id long, ord long, line string")


def test_topics_carry_the_time_of_their_own_block(spark):
    blocks = summaries.blocks_of(lines(spark, 12), 200)
    answers = summaries.inferred(blocks, lambda: lambda p: "なし" if "00:04:00" in p else "- point of " + p[1:9])
    got = [(r.block, r.time_range, r.points) for r in summaries.map_topics(blocks, answers).orderBy("block").collect()]
    assert got[0] == (0, "00:00:00 〜 00:03:00", ["point of 00:00:00"])
    assert [b for b, *_ in got] == [0, 2] and got[1][1].startswith("00:08:00")


def test_folding_ends_when_it_fits_or_after_three_rounds(spark):
    answers = spark.createDataFrame([(1, i, "z" * 90) for i in range(12)], "response_id long, block long, answer string")
    shrinking = summaries.folded(answers, lambda: lambda p: p[: len(p) // 4], 300)
    assert 0 < shrinking.agg(F.sum(F.length("answer"))).first()[0] <= 300
    stubborn = summaries.folded(answers, lambda: lambda p: p, 300)
    assert stubborn.count() >= 1 and stubborn.agg(F.max("block")).first()[0] < 12


def test_failure_of_the_model_falls_back(spark):
    def broken(prompt):
        raise RuntimeError("no model")

    blocks = summaries.blocks_of(lines(spark, 2), 500)
    answers = summaries.inferred(blocks, lambda: broken)
    extractive = spark.createDataFrame([(1, "# minutes")], "response_id long, markdown string")
    assert tuple(summaries.minutes_or_fallback(answers, extractive).first()) == (1, "# minutes", "extractive", "no answer of the model")
    assert responses.recognised(lines(spark, 1)).first().fell_back


def test_a_model_that_does_not_shorten_is_asked_no_further(spark, tmp_path):
    calls = tmp_path / "calls"
    answers = spark.createDataFrame([(1, i, "z" * 290) for i in range(4)] + [(2, 0, "short")], "response_id long, block long, answer string")

    def make():
        def model(prompt):
            with open(calls, "a") as file:
                file.write("x")
            return prompt

        return model

    kept = summaries.folded(answers, make, 300)
    assert calls.read_text() == "x" * 4  # one round of four blocks
    assert sorted((r.response_id, r.block, len(r.answer)) for r in kept.collect()) == [(1, 0, 290), (2, 0, 5)]
