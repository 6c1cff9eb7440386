"""The registered queries of the operators, each over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from ferrule.llm import byte_bpe, html_text, match_model, nearest, packing, resampling, simhash, spelling, suffix_dedup, telephony, token_rollup, toxicity, url_filter

QUERIES = {
    "op1_html_extraction": html_text.op1,
    "op2_telephony_media": telephony.op2,
    "op3_token_rollup": token_rollup.op3,
    "token_totals_by_codec": token_rollup.by_codec,
    "op4_simhash_near_dedup": simhash.op4,
    "op5_url_filter": url_filter.op5,
    "op6_nearest_neighbours": nearest.op6,
    "op7_best_fit_packing": packing.op7,
    "op8_suffix_dedup": suffix_dedup.op8,
    "op9_toxicity": toxicity.op9,
    "op10_byte_bpe": byte_bpe.op10,
    "op11_importance_resampling": resampling.op11,
    "op12_match_model": match_model.op12,
    "op13_spelling_variants": spelling.op13,
}
ORACLE_SQL: dict[str, str] = {"op3_token_rollup": token_rollup.OP3_SQL, "op11_importance_resampling": resampling.OP11_SQL, "op13_spelling_variants": spelling.OP13_SQL}
