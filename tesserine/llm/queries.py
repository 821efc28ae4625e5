"""The corpus operators as registered queries, each over its whole table."""

from __future__ import annotations

from tesserine.llm import langid, mixing, packing, quality, repeats, rules, simhash, tokenids, topk, toxicity

QUERIES = {
    "op1_risk_controlled_rules": rules.op1_quality_rules,
    "op2_karmarkar_karp_packing": packing.op2_pack,
    "op3_repair_token_ids": tokenids.op3_token_ids,
    "op4_bwt_merge_dedup": repeats.op4_repeats,
    "op5_entropy_balancing": mixing.op5_mix,
    "op6_threshold_topk": topk.op6_topk,
    "op7_naive_bayes_language": langid.op7_language,
    "op8_convolutional_toxicity": toxicity.op8_toxicity,
    "op9_simhash_vp_tree": simhash.op9_near_dedup,
    "op10_attention_quality": quality.op10_quality,
}
ORACLE_SQL = {**rules.ORACLE_SQL, **topk.ORACLE_SQL}
