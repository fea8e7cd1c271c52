"""Registry of the subpackage's queries and of the SQL that states their results."""

from __future__ import annotations


def queries() -> dict:
    from . import chat, exact_dedup, matroska, minhash, mixing, ngram_join, packing, resampling, runs, token_scan, toxicity, url_filter, warc

    return {
        "op1_matroska": matroska.op1_matroska,
        "op2_mixing": mixing.op2_mixing,
        "op3_packing": packing.op3_packing,
        "op4_chat": chat.op4_chat,
        "op5_toxicity": toxicity.op5_toxicity,
        "op6_ngram_join": ngram_join.op6_ngram_join,
        "op7_url_filter": url_filter.op7_url_filter,
        "op8_separator_scan": token_scan.op8_separator_scan,
        "op9_warc": warc.op9_warc,
        "op10_exact_dedup": exact_dedup.op10_exact_dedup,
        "op11_periodic_runs": runs.op11_periodic_runs,
        "op12_resampling": resampling.op12_resampling,
        "op13_minmax_dedup": minhash.op13_minmax_dedup,
    }


def oracle_sql() -> dict[str, str]:
    """Where SQL can state the result.  Tests hold the others against plain versions."""
    from . import exact_dedup, minhash, mixing, ngram_join, resampling, runs, warc

    return {
        "op2_mixing": mixing.OP2_SQL,
        "op6_ngram_join": ngram_join.OP6_SQL,
        "op9_warc": warc.OP9_SQL,
        "op10_exact_dedup": exact_dedup.OP10_SQL,
        "op11_periodic_runs": runs.OP11_SQL,
        "op12_resampling": resampling.OP12_SQL,
        "op13_minmax_dedup": minhash.OP13_SQL,
    }
