"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from loomframe.llm import bpe, chat, kmeans_tree, mixing, prefix_trie, quality, simhash, token_counts, topk, toxicity, url_templates, warc, whitening

QUERIES = {
    "op1_string_kernel_svm": toxicity.op1_string_kernel_svm,
    "op2_warc_zip": warc.op2_warc_zip,
    "op3_chat_events": chat.op3_chat_events,
    "op4_quality_rules": quality.op4_quality_rules,
    "op5_simhash_golay": simhash.op5_simhash_golay,
    "op6_mixing_tree": mixing.op6_mixing_tree,
    "op7_nra_top_k": topk.op7_nra_top_k,
    "op8_url_templates": url_templates.op8_url_templates,
    "op9_byte_bpe": bpe.op9_byte_bpe,
    "op10_token_counts": token_counts.op10_token_counts,
    "op11_prefix_trie": prefix_trie.op11_prefix_trie,
    "op12_jacobi_davidson": whitening.op12_jacobi_davidson,
    "op13_kmeans_tree": kmeans_tree.op13_kmeans_tree,
}
SQL: dict[str, str] = {"op3_chat_events": chat.SQL, "op2_warc_zip": warc.SQL, "op7_nra_top_k": topk.SQL, "op8_url_templates": url_templates.SQL, "op11_prefix_trie": prefix_trie.SQL}
