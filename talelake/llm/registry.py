"""The corpus operators' queries and the SQL that checks them."""

from __future__ import annotations

from talelake.llm import byte_bpe, embedding_dedup, exact_dedup, hard_negatives, html_extract, lexical_search, license_scan, lm_score, ngram_join, packing, quality, secrets, suffix_dedup

QUERIES = {
    "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
    "op2_ngram_jaccard": ngram_join.op2_ngram_jaccard,
    "op3_embedding_dedup": embedding_dedup.op3_embedding_dedup,
    "op4_lm_score": lm_score.op4_lm_score,
    "op5_exact_dedup": exact_dedup.op5_exact_dedup,
    "op6_best_fit_packing": packing.op6_best_fit_packing,
    "op7_secret_scan": secrets.op7_secret_scan,
    "op8_html_extract": html_extract.op8_html_extract,
    "op9_byte_bpe": byte_bpe.op9_byte_bpe,
    "op10_quality_classifier": quality.op10_quality_classifier,
    "op11_license_scan": license_scan.op11_license_scan,
    "op12_hard_negatives": hard_negatives.op12_hard_negatives,
    "op13_lexical_search": lexical_search.op13_lexical_search,
}
ORACLES = {
    "op3_embedding_dedup": embedding_dedup.ORACLE,
    "op5_exact_dedup": exact_dedup.ORACLE,
    "op11_license_scan": license_scan.ORACLE,
    "op12_hard_negatives": hard_negatives.ORACLE,
    "op13_lexical_search": lexical_search.ORACLE,
}
