"""Operators of a training-data pipeline."""

from __future__ import annotations


def queries() -> dict:
    from . import bpe_trie, chat, embedding_pivots, filter_audit, licenses, ngram_join, packing, pii, quality, sentencepiece_fst, spelling_trie, suffix_dedup, warc

    return {
        "op1_pivot_dedup": embedding_pivots.op1_pivot_dedup,
        "op2_sentencepiece": sentencepiece_fst.op2_sentencepiece,
        "op3_pii": pii.op3_pii,
        "op4_chat_perspectives": chat.op4_chat_perspectives,
        "op5_warc": warc.op5_warc,
        "op6_host_quality": quality.op6_host_quality,
        "op7_harmonic_packing": packing.op7_harmonic_packing,
        "op8_ngram_join": ngram_join.op8_ngram_join,
        "op9_license_scan": licenses.op9_license_scan,
        "op10_suffix_dedup": suffix_dedup.op10_suffix_dedup,
        "op11_spelling_variants": spelling_trie.op11_spelling_variants,
        "op12_filter_audit": filter_audit.op12_filter_audit,
        "op13_trie_bpe": bpe_trie.op13_trie_bpe,
    }


def oracle_sql() -> dict[str, str]:
    from . import chat, embedding_pivots, filter_audit, ngram_join, quality, spelling_trie, suffix_dedup, warc

    return {
        "op1_pivot_dedup": embedding_pivots.SQL,
        "op4_chat_perspectives": chat.SQL,
        "op5_warc": warc.SQL,
        "op6_host_quality": quality.SQL,
        "op8_ngram_join": ngram_join.SQL,
        "op10_suffix_dedup": suffix_dedup.SQL,
        "op11_spelling_variants": spelling_trie.SQL,
        "op12_filter_audit": filter_audit.SQL,
    }
