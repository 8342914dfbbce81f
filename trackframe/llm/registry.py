"""The corpus queries and the SQL that states the same results."""

from __future__ import annotations

from . import ann, decontaminate, html_text, lines, minhash, mixing, quality, runs, simhash, substrings, tokens, vector_codes, warc


def queries() -> dict:
    return {
        "op1_warc": warc.op1_warc,
        "op2_minhash_near_dedup": minhash.op2_minhash_near_dedup,
        "op3_suffix_array_dedup": substrings.op3_suffix_array_dedup,
        "op4_decontamination": decontaminate.op4_decontamination,
        "op5_quality_classifier": quality.op5_quality_classifier,
        "op6_line_dedup": lines.op6_line_dedup,
        "op7_ann": ann.op7_ann,
        "op8_mixing": mixing.op8_mixing,
        "op9_html_extraction": html_text.op9_html_extraction,
        "op10_token_counts": tokens.op10_token_counts,
        "op11_periodic_runs": runs.op11_periodic_runs,
        "op12_vector_codes": vector_codes.op12_vector_codes,
        "op13_simhash": simhash.op13_simhash,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_warc": warc.OP1_SQL,
        "op2_minhash_near_dedup": minhash.OP2_SQL,
        "op3_suffix_array_dedup": substrings.OP3_SQL,
        "op4_decontamination": decontaminate.OP4_SQL,
        "op8_mixing": mixing.OP8_SQL,
        "op11_periodic_runs": runs.OP11_SQL,
        "op12_vector_codes": vector_codes.OP12_SQL,
    }
