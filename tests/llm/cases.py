"""Awkward rows that every operator must take: nulls, empty and very long texts, repeats, clashing extra columns, empty tables."""

from __future__ import annotations

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, name string, size long, part int, key string, node long, kept boolean"
LONG = " ".join(f"word{i % 977} and{i % 89}" for i in range(20000))


def documents(spark, rows):
    """``rows`` of (doc_id, text) or (doc_id, text, source) as documents with columns whose names clash with internal ones."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "web", 0, 7, "x", 1, 2, "k", 3, True) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


AWKWARD = [(1, None), (2, ""), (3, "   \n\t "), (4, "Hello. World."), (4, "Hello. World."), (5, "hello. world."), (None, "Hello. World."), (None, None), (6, LONG), (7, LONG.upper()), (8, "é ß 😀 \u0000 end."), (9, "x" * 5000)]
