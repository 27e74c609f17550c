"""The registered queries of this subpackage and their DuckDB statements."""

from __future__ import annotations

from gridframe.llm import language_id, media, mixing, pieces, quality_model, quality_rules, simhash, token_counts, toxicity, warc
from gridframe.llm.common import tables

QUERIES = {
    "op1_simhash": lambda spark, d: simhash.op1_simhash(tables(spark, d, "documents")),
    "op2_quality_rules": lambda spark, d: quality_rules.op2_quality_rules(tables(spark, d, "documents")),
    "op3_quality_model": lambda spark, d: quality_model.op3_quality_model(tables(spark, d, "documents"), tables(spark, d, "labels")),
    "op4_language_id": lambda spark, d: language_id.op4_language_id(tables(spark, d, "documents")),
    "op5_media": lambda spark, d: media.op5_media(tables(spark, d, "documents")),
    "op6_mixing": lambda spark, d: mixing.op6_mixing(tables(spark, d, "documents")),
    "op7_toxicity": lambda spark, d: toxicity.op7_toxicity(tables(spark, d, "documents"), tables(spark, d, "labels")),
    "op8_sentencepiece": lambda spark, d: pieces.op8_sentencepiece(tables(spark, d, "documents")),
    "op9_token_counts": lambda spark, d: token_counts.op9_token_counts(tables(spark, d, "documents")),
    "op10_warc": lambda spark, d: warc.op10_warc(tables(spark, d, "pages")),
}

ORACLES = {"op2_quality_rules": quality_rules.ORACLE_SQL, "op4_language_id": language_id.ORACLE_SQL, "op6_mixing": mixing.ORACLE_SQL, "op10_warc": warc.ORACLE_SQL}
