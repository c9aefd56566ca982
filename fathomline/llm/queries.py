"""Queries of the training-data operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from fathomline.llm import boilerplate, capping, encoding, keyword_spam, languages, leakage, line_states, near_dups, residue, site_lines

QUERIES = {
    "p1_found": boilerplate.p1_found,
    "p1_bodies": boilerplate.p1_bodies,
    "p2_found": residue.p2_found,
    "p3_found": site_lines.p3_found,
    "p3_excess": site_lines.p3_excess,
    "p4_found": languages.p4_found,
    "p4_languages": languages.p4_languages,
    "p5_found": keyword_spam.p5_found,
    "p6_found": capping.p6_found,
    "p7_found": near_dups.p7_found,
    "p7_groups": near_dups.p7_groups,
    "near_duplicate_pages": near_dups.near_duplicate_pages,
    "p8_ids": encoding.p8_ids,
    "p9_found": leakage.p9_found,
    "p9_near": leakage.p9_near,
    "p9_leaked_items": leakage.p9_leaked_items,
    "p10_found": line_states.p10_found,
    "p10_statistics": line_states.p10_statistics,
}

ORACLE_SQL = {
    "p3_found": site_lines.P3_SQL,
    "p6_found": capping.P6_SQL,
}
