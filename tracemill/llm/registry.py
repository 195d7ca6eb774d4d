"""The training-data operators' queries and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import collocations, conversation_trie, decontaminate, html_text, licenses, near_dedup, packing, quality, secrets, suffix_tree_lm, token_counts, toxicity, url_filters

QUERIES = {
    "op1_decontamination": decontaminate.query,
    "op2_lm_scoring": suffix_tree_lm.query,
    "op3_license_scan": licenses.query,
    "op4_secret_scan": secrets.query,
    "op5_toxicity": toxicity.query,
    "op6_quality_rules": quality.query,
    "op7_token_counts": token_counts.query,
    "op8_packing": packing.query,
    "op9_near_dedup": near_dedup.query,
    "op10_html_extraction": html_text.query,
    "op11_collocations": collocations.query,
    "op12_conversation_trie": conversation_trie.query,
    "op13_url_filters": url_filters.query,
}

ORACLES = {"op1_decontamination": decontaminate.ORACLE, "op3_license_scan": licenses.ORACLE, "op11_collocations": collocations.ORACLE, "op12_conversation_trie": conversation_trie.ORACLE, "op13_url_filters": url_filters.ORACLE}
