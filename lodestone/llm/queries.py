"""The queries of this subpackage, each over its whole table, and SQL where it can express them."""

from __future__ import annotations

from lodestone.llm import alignment, decontaminate, hamming_topk, html_text, language, mixing, personal, quality, repeats, runs, simhash, token_output, toxicity

QUERIES = {
    "op1_decontaminate": decontaminate.query,
    "op2_html_text": html_text.query,
    "op3_language": language.query,
    "op4_toxicity": toxicity.query,
    "op5_hamming_topk": hamming_topk.query,
    "op6_mixing": mixing.query,
    "op7_simhash": simhash.query,
    "op8_quality": quality.query,
    "op9_token_output": token_output.query,
    "op10_repeats": repeats.query,
    "op11_runs": runs.query,
    "op12_personal": personal.query,
    "op13_alignment": alignment.query,
}

ORACLE_SQL = {
    "op1_decontaminate": decontaminate.SQL,
    "op5_hamming_topk": hamming_topk.SQL,
}
