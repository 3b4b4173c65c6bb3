"""The operators' queries, and SQL for those that SQL can express."""

from __future__ import annotations

from feira.llm import (
    decontaminate,
    fingerprints,
    line_dedup,
    merkle,
    mixing,
    near_join,
    packing,
    quality,
    secrets,
    tool_calls,
    toxicity,
    trie,
    url_filter,
)

QUERIES = {
    "op1_ngram_jaccard_join": near_join.query,
    "op2_source_mixing": mixing.query,
    "op3_secret_scan": secrets.query,
    "op4_url_filter": url_filter.query,
    "op5_document_fingerprints": fingerprints.query,
    "op6_line_dedup": line_dedup.query,
    "op7_toxicity": toxicity.query,
    "op8_chat_tool_calls": tool_calls.query,
    "op9_benchmark_decontamination": decontaminate.query,
    "op10_quality_classifier": quality.query,
    "op11_merkle_manifest": merkle.query,
    "op12_best_fit_packing": packing.query,
    "op13_conversation_trie": trie.query,
}

ORACLES = {
    "op2_source_mixing": mixing.ORACLE,
    "op6_line_dedup": line_dedup.ORACLE,
    "op11_merkle_manifest": merkle.ORACLE,
    "op13_conversation_trie": trie.ORACLE,
}
