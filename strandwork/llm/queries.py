"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from . import embedding_dedup, html_extraction, language_id, licence_scans, line_dedup, merkle, mixing, near_dedup, pieces, quality_rules, secret_scans, source_divergence, url_filters
from .sql import ORACLES

QUERIES = {
    f.__name__: f
    for f in (
        url_filters.op1_url_filters, quality_rules.op2_quality_rules, secret_scans.op3_secret_scans, near_dedup.op4_near_dedup, language_id.op5_language_id,
        mixing.op6_mixing, line_dedup.op7_line_dedup, pieces.op8_sentencepiece, html_extraction.op9_html_extraction, embedding_dedup.op10_embedding_dedup,
        source_divergence.op11_source_divergence, merkle.op12_merkle_manifest, licence_scans.op13_licence_scans,
    )
}
SQL = {name: text for name, text in ORACLES.items() if name in QUERIES}
