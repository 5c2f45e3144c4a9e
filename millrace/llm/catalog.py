"""Queries of the training-data operators and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import bpe, embedding_dedup, hard_negatives, jaccard_join, language_id, lm_scoring, mixing, secrets, spelling, token_counts, topk, url_filter, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": language_id.query,
    "op2_token_counts": token_counts.query,
    "op3_embedding_dedup": embedding_dedup.query,
    "op4_lm_scoring": lm_scoring.query,
    "op5_bpe": bpe.query,
    "op6_topk": topk.query,
    "op7_jaccard_join": jaccard_join.query,
    "op8_secrets": secrets.query,
    "op9_mixing": mixing.query,
    "op10_url_filter": url_filter.query,
    "op11_hard_negatives": hard_negatives.query,
    "op12_spelling": spelling.query,
    "op13_warc": warc.query,
}

#: Only what SQL can express; the others are tested against brute force.
ORACLES: dict[str, str] = {
    "op6_topk": topk.SQL,
    "op7_jaccard_join": jaccard_join.SQL,
    "op9_mixing": mixing.SQL,
    "op10_url_filter": url_filter.SQL,
    "op11_hard_negatives": hard_negatives.SQL,
    "op13_warc": warc.SQL,
}
