"""The queries of this subpackage, and their SQL where DuckDB can express them.

No SQL: op1 (XXH64 votes), op2 and op11 (a tokenizer), op3 and op8 (trained models),
op4 (a permutation by number): their tests compare with brute-force versions or held-out data.
"""

from __future__ import annotations

from tellurion.llm import decontam, licenses, lm, merkle, mixing, negatives, oracles, packed, quality, sharding, simhash, tokens, toxicity, warc

QUERIES = {
    "op1_simhash": simhash.op1_simhash,
    "op2_token_counts": tokens.op2_token_counts,
    "op3_lm_scoring": lm.op3_lm_scoring,
    "op4_sharding": sharding.op4_sharding,
    "op5_mixing": mixing.op5_mixing,
    "op6_quality": quality.op6_quality,
    "op7_warc": warc.op7_warc,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_licenses": licenses.op9_licenses,
    "op10_decontamination": decontam.op10_decontamination,
    "op11_packed_ids": packed.op11_packed_ids,
    "op12_hard_negatives": negatives.op12_hard_negatives,
    "op13_merkle": merkle.op13_merkle,
}
ORACLES: dict[str, str] = {
    "op5_mixing": oracles.MIXING,
    "op6_quality": oracles.QUALITY,
    "op7_warc": warc.ORACLE,
    "op9_licenses": oracles.LICENSES,
    "op10_decontamination": oracles.DECONTAMINATION,
    "op12_hard_negatives": negatives.ORACLE,
    "op13_merkle": merkle.ORACLE,
}
