"""The queries of this package, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from . import bpe_stream, exact_dedup, hash_forest, merkle, mixing, near_dedup, span_dedup, suffix_dedup, token_counts, toxicity, url_filters, vector_codes, warc


def queries() -> dict:
    return {
        "op1_near_dedup": near_dedup.op1_near_dedup,
        "op2_warc": warc.op2_warc,
        "op3_exact_dedup": exact_dedup.op3_exact_dedup,
        "op4_hash_forest": hash_forest.op4_hash_forest,
        "op5_toxicity": toxicity.op5_toxicity,
        "op6_span_dedup": span_dedup.op6_span_dedup,
        "op7_token_counts": token_counts.op7_token_counts,
        "op8_suffix_dedup": suffix_dedup.op8_suffix_dedup,
        "op9_mixing": mixing.op9_mixing,
        "op10_bpe": bpe_stream.op10_bpe,
        "op11_vector_codes": vector_codes.op11_vector_codes,
        "op12_merkle": merkle.op12_merkle,
        "op13_url_filters": url_filters.op13_url_filters,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_exact_dedup": exact_dedup.OP3_SQL, "op9_mixing": mixing.OP9_SQL, "op11_vector_codes": vector_codes.OP11_SQL, "op12_merkle": merkle.OP12_SQL}
