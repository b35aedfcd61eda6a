"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from quantloom.llm import ann, decontamination, fill_in_middle, html_text, jaccard_join, language_id, line_dedup, lm_scoring, packing, periodic_runs, quality, secrets, token_files

QUERIES = {
    "op1_html_extraction": html_text.op1_html_extraction,
    "op2_jaccard_join": jaccard_join.op2_jaccard_join,
    "op3_secret_scan": secrets.op3_secret_scan,
    "op4_lm_scoring": lm_scoring.op4_lm_scoring,
    "op5_quality_classifier": quality.op5_quality_classifier,
    "op6_benchmark_decontamination": decontamination.op6_benchmark_decontamination,
    "op7_nearest_neighbours": ann.op7_nearest_neighbours,
    "op8_token_files": token_files.op8_token_files,
    "op9_best_fit_packing": packing.op9_best_fit_packing,
    "op10_line_dedup": line_dedup.op10_line_dedup,
    "op11_fill_in_middle": fill_in_middle.op11_fill_in_middle,
    "op12_periodic_runs": periodic_runs.op12_periodic_runs,
    "op13_language_id": language_id.op13_language_id,
}

ORACLE_SQL = {
    "op2_jaccard_join": jaccard_join.SQL,
    "op6_benchmark_decontamination": decontamination.SQL,
    "op10_line_dedup": line_dedup.SQL,
    "op11_fill_in_middle": fill_in_middle.SQL,
    "op12_periodic_runs": periodic_runs.SQL,
}
