"""The queries and SQL of this subpackage, by name."""

from __future__ import annotations

from foliant.llm import dedup, packing, pipeline, quality, rules, secrets, sentencepieces, sharding, simhash, sql, topk, toxicity
from foliant.llm.common import Query


def queries() -> dict[str, Query]:
    return {
        "pipeline": pipeline.run,
        "op1_quality_classifier": quality.op1_quality_classifier,
        "op2_sharding": sharding.op2_sharding,
        "op3_simhash_near_dedup": simhash.op3_simhash_near_dedup,
        "op4_best_fit_packing": packing.op4_best_fit_packing,
        "op5_suffix_array_dedup": dedup.op5_suffix_array_dedup,
        "op6_sentencepiece": sentencepieces.op6_sentencepiece,
        "op7_secret_scans": secrets.op7_secret_scans,
        "op8_exact_top_k": topk.op8_exact_top_k,
        "op9_quality_rules": rules.op9_quality_rules,
        "op10_toxicity": toxicity.op10_toxicity,
    }


def oracle_sql() -> dict[str, str]:
    return dict(sql.SQL)
