"""The training-data queries and, where SQL can say the same, their expected results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from archidex.llm import queries_duplicates as duplicates
from archidex.llm import queries_tokens as tokens
from archidex.llm import queries_vectors as vectors
from archidex.llm import queries_web as web

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": duplicates.op1_simhash,
    "op2_line_dedup": duplicates.op2_line_dedup,
    "op3_lm": tokens.op3_lm,
    "op4_chat": web.op4_chat,
    "op5_bpe": tokens.op5_bpe,
    "op6_ann": vectors.op6_ann,
    "op7_langid": tokens.op7_langid,
    "op8_token_counts": tokens.op8_token_counts,
    "op9_decontam": duplicates.op9_decontam,
    "op10_warc": web.op10_warc,
    "op11_minhash": duplicates.op11_minhash,
    "op12_vector_codes": vectors.op12_vector_codes,
    "op13_resampling": tokens.op13_resampling,
}

ORACLES: dict[str, str] = {
    "op2_line_dedup": duplicates.OP2_SQL,
    "op4_chat": web.OP4_SQL,
    "op6_ann": vectors.OP6_SQL,
    "op10_warc": web.OP10_SQL,
    "op11_minhash": duplicates.OP11_SQL,
    "op12_vector_codes": vectors.OP12_SQL,
    "op13_resampling": tokens.OP13_SQL,
}
