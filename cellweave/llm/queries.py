"""What ``__spark_entry__.py`` registers of this subpackage."""

from __future__ import annotations

from cellweave.llm import decontaminate, html_text, importance, line_dedup, negatives, ngram_join, order_minhash, secrets, spelling, toxicity, training_order, unigram, url_filter

QUERIES = {
    "op1_toxicity": toxicity.op1,
    "op2_training_order": training_order.op2,
    "op3_order_minhash": order_minhash.op3,
    "op4_decontamination": decontaminate.op4,
    "op5_ngram_jaccard": ngram_join.op5,
    "op6_secret_scans": secrets.op6,
    "op7_url_filters": url_filter.op7,
    "op8_line_dedup": line_dedup.op8,
    "op9_importance_resampling": importance.op9,
    "op10_sentencepiece": unigram.op10,
    "op11_spelling_variants": spelling.op11,
    "op12_hard_negatives": negatives.op12,
    "op13_html_text": html_text.op13,
}
SQL = {
    "op4_decontamination": decontaminate.SQL,
    "op7_url_filters": url_filter.SQL,
    "op8_line_dedup": line_dedup.SQL,
}
