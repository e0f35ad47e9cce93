"""The registered queries of this package, and the SQL of those that SQL can express."""

from __future__ import annotations

from shelfgauge.llm import (collocations, decontamination, exact_dedup, language_id, language_model, line_dedup, mixing,
                            pseudonyms, quality, ranked_search, simhash, token_ids, toxicity)

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_token_ids": token_ids.op2_token_ids,
    "op3_simhash": simhash.op3_simhash,
    "op4_line_dedup": line_dedup.op4_line_dedup,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_decontamination": decontamination.op6_decontamination,
    "op7_quality": quality.op7_quality,
    "op8_language_model": language_model.op8_language_model,
    "op9_pseudonyms": pseudonyms.op9_pseudonyms,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
    "op11_collocations": collocations.op11_collocations,
    "op12_language_id": language_id.op12_language_id,
    "op13_ranked_search": ranked_search.op13_ranked_search,
}

ORACLE_SQL = {
    "op10_exact_dedup": exact_dedup.ORACLE_SQL,
    "op11_collocations": collocations.ORACLE_SQL,
    "op13_ranked_search": ranked_search.ORACLE_SQL,
}
