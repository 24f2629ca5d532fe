"""The registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from sonority.llm import alignment, decontaminate, exact_dedup, html_extract, jaccard_join, mixing, pii, prefix_trie, quality, secrets, simhash, token_store, toxicity

QUERIES = {
    "op1_quality_classifier": quality.query,
    "op2_secret_scan": secrets.query,
    "op3_source_mixing": mixing.query,
    "op4_token_store": token_store.query,
    "op5_exact_dedup": exact_dedup.query,
    "op6_toxic_spans": toxicity.query,
    "op7_benchmark_decontamination": decontaminate.query,
    "op8_pii_bootstrap": pii.query,
    "op9_html_extraction": html_extract.query,
    "op10_simhash_near_dedup": simhash.query,
    "op11_prefix_trie": prefix_trie.query,
    "op12_cross_alignment": alignment.query,
    "op13_ngram_jaccard_join": jaccard_join.query,
}

SQL = {
    "op3_source_mixing": mixing.SQL,
    "op5_exact_dedup": exact_dedup.SQL,
    "op7_benchmark_decontamination": decontaminate.SQL,
    "op11_prefix_trie": prefix_trie.SQL,
    "op13_ngram_jaccard_join": jaccard_join.SQL,
}
