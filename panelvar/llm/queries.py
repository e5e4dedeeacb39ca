"""The queries of this folder, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from panelvar.llm import clusters, contamination, hosts, licenses, lines, mixing, near, neighbours, packing, pages, repetition, rules, substrings

QUERIES = {
    "op1_best_fit_packing": packing.query,
    "op2_substring_dedup": substrings.query,
    "op3_line_dedup": lines.query,
    "op4_quality_rules": rules.query,
    "op5_near_dedup": near.query,
    "op6_nearest_neighbours": neighbours.query,
    "op7_url_filter": hosts.query,
    "op8_license_scan": licenses.query,
    "op9_source_mixing": mixing.query,
    "op10_html_extraction": pages.query,
    "op11_decontamination": contamination.query,
    "op12_centroid_clustering": clusters.query,
    "op13_periodic_runs": repetition.query,
}

ORACLE = {
    "op3_line_dedup": lines.ORACLE,
    "op7_url_filter": hosts.ORACLE,
    "op8_license_scan": licenses.ORACLE,
    "op9_source_mixing": mixing.ORACLE,
    "op11_decontamination": contamination.ORACLE,
    "op12_centroid_clustering": clusters.ORACLE,
}
