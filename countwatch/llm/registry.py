"""The queries of this folder's operators, and DuckDB texts for those that SQL expresses on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from countwatch.llm import chat, decontaminate, embeddings, line_dedup, merkle, mixing, quality, repair, secrets, sentencepieces, simhash, toxicity, url_filters

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": simhash.op1_simhash,
    "op2_url_filter": url_filters.op2_url_filter,
    "op3_decontaminate": decontaminate.op3_decontaminate,
    "op4_secrets": secrets.op4_secrets,
    "op5_chat": chat.op5_chat,
    "op6_quality": quality.op6_quality,
    "op7_embeddings": embeddings.op7_embeddings,
    "op8_sentencepiece": sentencepieces.op8_sentencepiece,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_line_dedup": line_dedup.op10_line_dedup,
    "op11_merkle": merkle.op11_merkle,
    "op12_mix": mixing.op12_mix,
    "op13_repair": repair.op13_repair,
}
ORACLES: dict[str, str] = {
    "op2_url_filter": url_filters.OP2_SQL,
    "op11_merkle": merkle.OP11_SQL,
    "op12_mix": mixing.OP12_SQL,
    "op13_repair": repair.OP13_SQL,
}
