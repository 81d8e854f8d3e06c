"""Queries of the training-data operators and the SQL that DuckDB can check them with."""

from __future__ import annotations

from keyloom.llm import bpe, chat, decontam, html_text, langid, linededup, ngram_join, prefix_trie, quality, rules, topk, variants, warc


def queries() -> dict:
    return {
        "op1_chat_format": chat.op1_chat_format,
        "op2_bpe": bpe.op2_bpe,
        "op3_ngram_join": ngram_join.op3_ngram_join,
        "op4_language_id": langid.op4_language_id,
        "op5_line_dedup": linededup.op5_line_dedup,
        "op6_warc": warc.op6_warc,
        "op7_quality_classifier": quality.op7_quality_classifier,
        "op8_html_extraction": html_text.op8_html_extraction,
        "op9_quality_rules": rules.op9_quality_rules,
        "op10_decontamination": decontam.op10_decontamination,
        "op11_prefix_trie": prefix_trie.op11_prefix_trie,
        "op12_spelling_variants": variants.op12_spelling_variants,
        "op13_top_k": topk.op13_top_k,
    }


def oracle_sql() -> dict:
    return {"op1_chat_format": chat.SQL, "op3_ngram_join": ngram_join.SQL, "op5_line_dedup": linededup.SQL, "op6_warc": warc.SQL, "op9_quality_rules": rules.SQL, "op11_prefix_trie": prefix_trie.SQL, "op12_spelling_variants": variants.SQL, "op13_top_k": topk.SQL}
