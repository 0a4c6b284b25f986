"""The queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from . import chat, decontaminate, exact_dedup, langid, lm_score, ngram_join, packing, pii, suffix_dedup, tokens

QUERIES = {
    f.__name__: f
    for f in (
        chat.op1_chat_format,
        ngram_join.op2_ngram_jaccard_join,
        exact_dedup.op3_exact_dedup,
        decontaminate.op4_decontaminate,
        langid.op5_language_id,
        suffix_dedup.op6_suffix_dedup,
        pii.op7_pii,
        lm_score.op8_lm_score,
        packing.op9_best_fit_packing,
        tokens.op10_token_counts,
    )
}

ORACLES = {"op1_chat_format": chat.SQL, "op3_exact_dedup": exact_dedup.SQL}
