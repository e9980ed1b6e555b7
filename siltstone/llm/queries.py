"""The queries of this subpackage and, where SQL can express one, its DuckDB SQL."""

from __future__ import annotations

from . import classifier, fingerprints, html_text, line_dedup, mixing, oracles, packing, quality_rules, simhash, token_files, url_filters

QUERIES = {
    "op1_line_dedup": line_dedup.query,
    "op2_fingerprints": fingerprints.query,
    "op3_html_text": html_text.query,
    "op4_url_filters": url_filters.query,
    "op5_packing": packing.query,
    "op6_simhash": simhash.query,
    "op7_quality_rules": quality_rules.query,
    "op8_quality_classifier": classifier.query,
    "op9_mixing": mixing.query,
    "op10_token_files": token_files.query,
}
ORACLES = {
    "op1_line_dedup": oracles.LINE_DEDUP,
    "op4_url_filters": oracles.URL_FILTERS,
    "op7_quality_rules": oracles.QUALITY_RULES,
}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
