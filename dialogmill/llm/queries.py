"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from dialogmill.llm import (
    conversation_repair,
    decontaminate,
    embedding_dedup,
    jaccard_join,
    language_id,
    line_dedup,
    mixing,
    passage_dedup,
    sharding,
    spelling_variants,
    token_counts,
    toxicity,
    warc,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": decontaminate.op1_decontaminate,
    "op2_jaccard": jaccard_join.op2_jaccard,
    "op3_embedding_dedup": embedding_dedup.op3_embedding_dedup,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_mixing": mixing.op5_mixing,
    "op6_token_counts": token_counts.op6_token_counts,
    "op7_language_id": language_id.op7_language_id,
    "op8_line_dedup": line_dedup.op8_line_dedup,
    "op9_passage_dedup": passage_dedup.op9_passage_dedup,
    "op10_warc": warc.op10_warc,
    "op11_sharding": sharding.op11_sharding,
    "op12_spelling_variants": spelling_variants.op12_spelling_variants,
    "op13_conversation_repair": conversation_repair.op13_conversation_repair,
}

ORACLE_SQL: dict[str, str] = {
    "op5_mixing": mixing.OP5_SQL,
    "op8_line_dedup": line_dedup.OP8_SQL,
    "op10_warc": warc.OP10_SQL,
    "op12_spelling_variants": spelling_variants.OP12_SQL,
    "op13_conversation_repair": conversation_repair.OP13_SQL,
}
