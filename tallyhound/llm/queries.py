"""The corpus queries and their SQL, for the driver's entry module."""

from __future__ import annotations

from tallyhound.llm import chat, encoding, language, mixing, neardup, packing, repetition, runs, search, secrets, urlfilter, vectors, whitening


def queries() -> dict:
    return {
        "op1_minhash_near_dedup": neardup.op1_minhash_near_dedup,
        "op2_best_fit_packing": packing.op2_best_fit_packing,
        "op3_chat_format": chat.op3_chat_format,
        "op4_mix_sources": mixing.op4_mix_sources,
        "op5_quality_rules": repetition.op5_quality_rules,
        "op6_url_filter": urlfilter.op6_url_filter,
        "op7_embedding_near_dedup": vectors.op7_embedding_near_dedup,
        "op8_token_counts": encoding.op8_token_counts,
        "op9_language_id": language.op9_language_id,
        "op10_secret_scan": secrets.op10_secret_scan,
        "op11_exact_top_k": search.op11_exact_top_k,
        "op12_whitening": whitening.op12_whitening,
        "op13_periodic_runs": runs.op13_periodic_runs,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_chat_format": chat.OP3_SQL, "op4_mix_sources": mixing.OP4_SQL, "op6_url_filter": urlfilter.OP6_SQL, "op11_exact_top_k": search.OP11_SQL}
