"""The registered queries of this subpackage, and their SQL."""

from __future__ import annotations

from timberline.llm import clusters, decontaminate, exact_dedup, filter_audit, importance, mixing, packing, repeats, simhash, token_output, toxicity, url_filter, warc


def queries() -> dict:
    return {
        "op1_importance_resampling": importance.op1_importance_resampling,
        "op2_warc_derivatives": warc.op2_warc_derivatives,
        "op3_token_files": token_output.op3_token_files,
        "op4_mix_sources": mixing.op4_mix_sources,
        "op5_simhash_bktree": simhash.op5_simhash_bktree,
        "op6_bwt_repeats": repeats.op6_bwt_repeats,
        "op7_url_templates": url_filter.op7_url_templates,
        "op8_decontaminate": decontaminate.op8_decontaminate,
        "op9_exact_dedup": exact_dedup.op9_exact_dedup,
        "op10_toxicity_chain": toxicity.op10_toxicity_chain,
        "op11_best_fit_packing": packing.op11_best_fit_packing,
        "op12_filter_audit": filter_audit.op12_filter_audit,
        "op13_incremental_kmeans": clusters.op13_incremental_kmeans,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_mix_sources": mixing.OP4_SQL,
        "op7_url_templates": url_filter.OP7_SQL,
        "op8_decontaminate": decontaminate.OP8_SQL,
        "op9_exact_dedup": exact_dedup.OP9_SQL,
        "op12_filter_audit": filter_audit.OP12_SQL,
        "op13_incremental_kmeans": clusters.OP13_SQL,
    }
