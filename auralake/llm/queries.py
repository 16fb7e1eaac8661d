"""The registered queries of the training-data operators and the SQL that states their results."""

from __future__ import annotations

from . import bpe, decontam, exact_dedup, licenses, lm, ngram_join, quality, shards, urls, warc

QUERIES = {
    "op1_attention_lm": lm.op1_attention_lm,
    "op2_url_trees": urls.op2_url_trees,
    "op3_grace_dedup": exact_dedup.op3_grace_dedup,
    "op4_zstd_quality": quality.op4_zstd_quality,
    "op5_license_scan": licenses.op5_license_scan,
    "op6_virtual_slots": shards.op6_virtual_slots,
    "op7_bm25_leaks": decontam.op7_bm25_leaks,
    "op8_warc_roundtrip": warc.op8_warc_roundtrip,
    "op9_prefix_bpe": bpe.op9_prefix_bpe,
    "op10_adaptive_prefix": ngram_join.op10_adaptive_prefix,
}

#: DuckDB SQL by query; a query without an entry is tested against brute force in tests/llm.
ORACLES = {
    "op3_grace_dedup": exact_dedup.OP3_SQL,
    "op5_license_scan": licenses.OP5_SQL,
    "op6_virtual_slots": shards.OP6_SQL,
    "op8_warc_roundtrip": warc.OP8_SQL,
    "op10_adaptive_prefix": ngram_join.OP10_SQL,
}
