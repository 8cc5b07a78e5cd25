"""Registered queries of this subpackage, one for each operator, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from careflow.llm import (
    conversation_repair,
    decontaminate,
    jaccard_join,
    langid,
    license_scan,
    packing,
    secret_scan,
    spelling_variants,
    substring_dedup,
    token_counts,
    topk_search,
    url_filter,
    warc_derivatives,
)

QUERIES = {
    "op1_decontamination": decontaminate.op1_decontamination,
    "op2_language_id": langid.op2_language_id,
    "op3_substring_dedup": substring_dedup.op3_substring_dedup,
    "op4_topk_search": topk_search.op4_topk_search,
    "op5_warc_derivatives": warc_derivatives.op5_warc_derivatives,
    "op6_license_scan": license_scan.op6_license_scan,
    "op7_url_filter": url_filter.op7_url_filter,
    "op8_jaccard_join": jaccard_join.op8_jaccard_join,
    "op9_token_counts": token_counts.op9_token_counts,
    "op10_best_fit_packing": packing.op10_best_fit_packing,
    "op11_conversation_repair": conversation_repair.op11_conversation_repair,
    "op12_secret_scan": secret_scan.op12_secret_scan,
    "op13_spelling_variants": spelling_variants.op13_spelling_variants,
}

ORACLE: dict[str, str] = {
    "op1_decontamination": decontaminate.ORACLE_SQL,
    "op3_substring_dedup": substring_dedup.ORACLE_SQL,
    "op4_topk_search": topk_search.ORACLE_SQL,
    "op5_warc_derivatives": warc_derivatives.ORACLE_SQL,
    "op6_license_scan": license_scan.ORACLE_SQL,
    "op8_jaccard_join": jaccard_join.ORACLE_SQL,
    "op11_conversation_repair": conversation_repair.ORACLE_SQL,
    "op13_spelling_variants": spelling_variants.ORACLE_SQL,
}
