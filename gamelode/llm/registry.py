"""The queries of this subpackage and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from . import decontamination, exact_dedup, html_extraction, language_id, line_dedup, lm_scoring, minhash_dedup, prefix_trie, quality_rules, secret_scan, sentencepiece_codec, source_audit, suffix_dedup


def queries() -> dict:
    return {
        f.__name__: f
        for f in (
            sentencepiece_codec.op1_sentencepiece, html_extraction.op2_html_extraction, secret_scan.op3_secret_scan, exact_dedup.op4_exact_dedup, minhash_dedup.op5_minhash_dedup,
            lm_scoring.op6_lm_scoring, language_id.op7_language_id, line_dedup.op8_line_dedup, suffix_dedup.op9_suffix_dedup, decontamination.op10_decontamination,
            prefix_trie.op11_prefix_trie, source_audit.op12_source_audit, quality_rules.op13_quality_rules,
        )
    }


def oracle_sql() -> dict:
    return {"op4_exact_dedup": exact_dedup.ORACLE, "op6_lm_scoring": lm_scoring.ORACLE, "op8_line_dedup": line_dedup.ORACLE, "op11_prefix_trie": prefix_trie.ORACLE, "op12_source_audit": source_audit.ORACLE}
