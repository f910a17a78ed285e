"""Queries of the corpus operators and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from . import bpe, decontaminate, divergence, filters, html, jaccard, licences, lm, pieces, pii, quality, substrings, warc

QUERIES = {
    "op1_pii": pii.op1_pii,
    "op2_bpe": bpe.op2_bpe,
    "op3_html": html.op3_html,
    "op4_substrings": substrings.op4_substrings,
    "op5_warc": warc.op5_warc,
    "op6_lm": lm.op6_lm,
    "op7_licences": licences.op7_licences,
    "op8_jaccard": jaccard.op8_jaccard,
    "op9_quality": quality.op9_quality,
    "op10_decontaminate": decontaminate.op10_decontaminate,
    "op11_pieces": pieces.op11_pieces,
    "op12_divergence": divergence.op12_divergence,
    "op13_filters": filters.op13_filters,
}

ORACLE_SQL: dict[str, str] = {
    "op7_licences": licences.ORACLE,
    "op12_divergence": divergence.ORACLE,
    "op13_filters": filters.ORACLE,
}
