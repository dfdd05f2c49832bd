"""The queries of this subpackage by name, and their SQL where SQL can express them."""

from massgrid.llm import bpe, conversations, divergence, html_text, langid, line_dedup, media, ngram_join, packing, repeats, secrets, topk, toxicity

QUERIES = {
    "op1_media_columns": media.query,
    "op2_ngram_jaccard_join": ngram_join.query,
    "op3_secret_scans": secrets.query,
    "op4_html_extraction": html_text.query,
    "op5_byte_bpe": bpe.query,
    "op6_toxicity": toxicity.query,
    "op7_suffix_array_dedup": repeats.query,
    "op8_language_id": langid.query,
    "op9_exact_top_k": topk.query,
    "op10_packing": packing.query,
    "op11_line_dedup": line_dedup.query,
    "op12_conversation_repair": conversations.query,
    "op13_source_divergence": divergence.query,
}

ORACLES: dict[str, str] = {
    "op2_ngram_jaccard_join": ngram_join.ORACLE,
    "op9_exact_top_k": topk.ORACLE,
    "op11_line_dedup": line_dedup.ORACLE,
    "op13_source_divergence": divergence.ORACLE,
}
