"""Queries of this subpackage by name, and their SQL where SQL can express them."""

from __future__ import annotations

from copse.llm import bpe_codec, curriculum, fuzzy_lines, lattice_lm, minmax_dedup, parsing_fingerprints, rans, risk_rules, token_cache, wrappers

QUERIES = {
    f.__name__: f
    for f in (
        lattice_lm.op1_lattice_lm,
        rans.op2_rans_ids,
        wrappers.op3_wrappers,
        risk_rules.op4_risk_rules,
        fuzzy_lines.op5_fuzzy_lines,
        minmax_dedup.op6_minmax_dedup,
        bpe_codec.op7_bpe_codec,
        parsing_fingerprints.op8_parsing_fingerprints,
        curriculum.op9_curriculum,
        token_cache.op10_token_cache,
    )
}

#: The others are tested against brute force, round trips or held-out likelihood.
ORACLES: dict[str, str] = {
    "op3_wrappers": wrappers.ORACLE,
    "op4_risk_rules": risk_rules.ORACLE,
    "op6_minmax_dedup": minmax_dedup.ORACLE,
    "op9_curriculum": curriculum.ORACLE,
}
