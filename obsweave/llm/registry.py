"""The queries of this subpackage and their DuckDB SQL, for __spark_entry__."""
from __future__ import annotations

from . import bpe, brown, doubling, exact, html, huffman, jaccard, mixing, quality, suffix, toxicity, trie, vafile

QUERIES = {
    "op1_huffman_token_file": huffman.query,
    "op2_nearest_url_extraction": html.query,
    "op3_brown_class_scores": brown.query,
    "op4_repeated_strings": suffix.query,
    "op5_boosted_quality": quality.query,
    "op6_bpe_chunk_reuse": bpe.query,
    "op7_toxicity_grammar": toxicity.query,
    "op8_es_mixing": mixing.query,
    "op9_grouped_prefix_jaccard": jaccard.query,
    "op10_msd_radix_dedup": exact.query,
    "op11_conversation_trie": trie.query,
    "op12_doubling_windows": doubling.query,
    "op13_va_file_codes": vafile.query,
}
#: Where SQL can express a query; the others are tested against brute force in tests/llm.
ORACLES = {"op10_msd_radix_dedup": exact.ORACLE, "op11_conversation_trie": trie.ORACLE, "op12_doubling_windows": doubling.ORACLE, "op13_va_file_codes": vafile.ORACLE}
