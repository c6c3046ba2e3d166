"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import alignment, chat, exact, html, lines, mixing, neighbours, ngram_join, packing, quality, rules, toxicity, variants

QUERIES = {
    "op1_exact_dedup": exact.op1_exact_dedup,
    "op2_best_fit_packing": packing.op2_best_fit_packing,
    "op3_html_text": html.op3_html_text,
    "op4_quality": quality.op4_quality,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_source_mixing": mixing.op6_source_mixing,
    "op7_ngram_join": ngram_join.op7_ngram_join,
    "op8_vector_search": neighbours.op8_vector_search,
    "op9_chat_format": chat.op9_chat_format,
    "op10_line_dedup": lines.op10_line_dedup,
    "op11_spelling_variants": variants.op11_spelling_variants,
    "op12_quality_rules": rules.op12_quality_rules,
    "op13_token_alignment": alignment.op13_token_alignment,
}

ORACLE = {
    "op1_exact_dedup": exact.OP1_SQL,
    "op9_chat_format": chat.OP9_SQL,
    "op11_spelling_variants": variants.OP11_SQL,
}
