"""Registered queries of this subpackage."""

from __future__ import annotations

from inkwell.llm import decontam, jaccard, langid, lm, manifest, mixing, packing, quality, tokens, toxicity, trie, url_filter, warc

QUERIES = {
    "op1_quality": quality.query,
    "op2_lm_score": lm.query,
    "op3_jaccard": jaccard.query,
    "op4_language": langid.query,
    "op5_token_counts": tokens.query,
    "op6_toxicity": toxicity.query,
    "op7_warc": warc.query,
    "op8_url_filter": url_filter.query,
    "op9_packing": packing.query,
    "op10_decontamination": decontam.query,
    "op11_prefix_trie": trie.query,
    "op12_mixing": mixing.query,
    "op13_manifest": manifest.query,
}
ORACLES = {
    "op1_quality": quality.ORACLE,
    "op3_jaccard": jaccard.ORACLE,
    "op10_decontamination": decontam.ORACLE,
    "op7_warc": warc.ORACLE,
    "op8_url_filter": url_filter.ORACLE,
    "op11_prefix_trie": trie.ORACLE,
    "op12_mixing": mixing.ORACLE,
    "op13_manifest": manifest.ORACLE,
}
