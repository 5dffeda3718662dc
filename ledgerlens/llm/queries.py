"""Queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from ledgerlens.llm import (
    bpe_codec,
    chat_format,
    exact_dedup,
    language_id,
    license_scan,
    lm_score,
    minhash,
    ngram_join,
    packing,
    prefix_trie,
    topk_search,
    warc,
    whitening,
)

QUERIES = {
    "op1_license_scan": license_scan.op1_license_scan,
    "op2_warc": warc.op2_warc,
    "op3_chat_format": chat_format.op3_chat_format,
    "op4_packing": packing.op4_packing,
    "op5_lm_score": lm_score.op5_lm_score,
    "op6_ngram_join": ngram_join.op6_ngram_join,
    "op7_bpe_codec": bpe_codec.op7_bpe_codec,
    "op8_exact_dedup": exact_dedup.op8_exact_dedup,
    "op9_topk_search": topk_search.op9_topk_search,
    "op10_language_id": language_id.op10_language_id,
    "op11_whitening": whitening.op11_whitening,
    "op12_prefix_trie": prefix_trie.op12_prefix_trie,
    "op13_minhash": minhash.op13_minhash,
}

SQL = {
    "op1_license_scan": license_scan.SQL,
    "op2_warc": warc.SQL,
    "op3_chat_format": chat_format.SQL,
    "op8_exact_dedup": exact_dedup.SQL,
    "op9_topk_search": topk_search.SQL,
    "op12_prefix_trie": prefix_trie.SQL,
}
