"""The queries of this folder and their SQL, for ``__spark_entry__.py``."""

from __future__ import annotations

from depdelver.llm import ball_clusters, decontamination, fingerprints, jaccard_join, language, licenses, line_dedup, lm_score, mixing, substring_dedup, token_alignment, topk, url_filter

QUERIES = {
    "op1_topk": topk.op1_topk,
    "op2_license_scan": licenses.op2_license_scan,
    "op3_substring_dedup": substring_dedup.op3_substring_dedup,
    "op4_url_filter": url_filter.op4_url_filter,
    "op5_decontamination": decontamination.op5_decontamination,
    "op6_line_dedup": line_dedup.op6_line_dedup,
    "op7_language": language.op7_language,
    "page_language": language.page_language,
    "op8_lm_score": lm_score.op8_lm_score,
    "op9_jaccard_join": jaccard_join.op9_jaccard_join,
    "op10_mixing": mixing.op10_mixing,
    "op11_ball_clusters": ball_clusters.op11_ball_clusters,
    "op12_token_alignment": token_alignment.op12_token_alignment,
    "op13_fingerprints": fingerprints.op13_fingerprints,
}
SQL = {
    "op1_topk": topk.SQL,
    "op2_license_scan": licenses.SQL,
    "op4_url_filter": url_filter.SQL,
    "op5_decontamination": decontamination.SQL,
    "op6_line_dedup": line_dedup.SQL,
    "op8_lm_score": lm_score.SQL,
    "op9_jaccard_join": jaccard_join.SQL,
    "op10_mixing": mixing.SQL,
    "op11_ball_clusters": ball_clusters.SQL,
    "op13_fingerprints": fingerprints.SQL,
}
