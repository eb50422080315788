"""The queries of this subpackage and the SQL that some of them can be held against."""

from . import decontamination, html_extract, licenses, ngram_jaccard, packing, substring_dedup, token_codes, token_counts, topk, toxicity

QUERIES = {
    "op1_substring_dedup": substring_dedup.op1_substring_dedup,
    "op2_decontamination": decontamination.op2_decontamination,
    "op3_ngram_jaccard": ngram_jaccard.op3_ngram_jaccard,
    "op4_exact_topk": topk.op4_exact_topk,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_html_extraction": html_extract.op6_html_extraction,
    "op7_license_scan": licenses.op7_license_scan,
    "op8_token_codes": token_codes.op8_token_codes,
    "op9_token_counts": token_counts.op9_token_counts,
    "op10_best_fit_packing": packing.op10_best_fit_packing,
}
ORACLES = {"op3_ngram_jaccard": ngram_jaccard.OP3_SQL, "op4_exact_topk": topk.OP4_SQL}
