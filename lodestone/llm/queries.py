"""Queries of this subpackage, for the driver's entry file."""

from __future__ import annotations

from lodestone.llm import attention_lm, language, packing, quality, rollup, sentencepiece_bpe, sharding, simhash, topk, warc

QUERIES = {
    "op1_packing": packing.query,
    "op2_rollup": rollup.query,
    "op3_simhash": simhash.query,
    "op4_sharding": sharding.query,
    "op5_sentencepiece": sentencepiece_bpe.query,
    "op6_warc": warc.query,
    "op7_topk": topk.query,
    "op8_quality": quality.query,
    "op9_language": language.query,
    "op10_attention_lm": attention_lm.query,
}
ORACLES: dict[str, str] = {"op7_topk": topk.ORACLE, "op8_quality": quality.oracle_sql()}
