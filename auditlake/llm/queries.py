"""The corpus operators' queries and their SQL."""

from __future__ import annotations

from auditlake.llm import ann, clusters, decontaminate, divergence, html_text, language, license_scan, mixing, pii, quality, simhash, token_files, url_filter

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_nearest": ann.op2_nearest,
    "op3_decontaminate": decontaminate.op3_decontaminate,
    "op4_license_scan": license_scan.op4_license_scan,
    "op5_url_filter": url_filter.op5_url_filter,
    "op6_simhash": simhash.op6_simhash,
    "op7_html_text": html_text.op7_html_text,
    "op8_token_files": token_files.op8_token_files,
    "op9_pii": pii.op9_pii,
    "op10_quality": quality.op10_quality,
    "op11_divergence": divergence.op11_divergence,
    "op12_language": language.op12_language,
    "op13_clusters": clusters.op13_clusters,
}
ORACLE_SQL = {
    "op1_mixing": mixing.OP1_SQL, "op2_nearest": ann.OP2_SQL, "op3_decontaminate": decontaminate.OP3_SQL, "op5_url_filter": url_filter.OP5_SQL,
    "op11_divergence": divergence.OP11_SQL, "op13_clusters": clusters.OP13_SQL,
}
