"""Registered queries of this package: one per operator, over whole tables."""

from __future__ import annotations

from . import chat, counts, idfile, lines, merkle, mix, nra, pack, passages, pq, simhash, topk, toxicity
from .common import table

QUERIES = {
    "op1_chat_format": lambda spark, d: chat.query(table(spark, d, "conversations")),
    "op2_token_counts": counts.query,
    "op3_simhash_dedup": lambda spark, d: simhash.query(table(spark, d, "documents")),
    "op4_embedding_dedup": lambda spark, d: pq.query(table(spark, d, "embeddings")),
    "op5_topk_search": lambda spark, d: topk.query(table(spark, d, "embeddings")),
    "op6_token_ids": lambda spark, d: idfile.query(table(spark, d, "documents")),
    "op7_source_mix": lambda spark, d: mix.query(table(spark, d, "documents")),
    "op8_packing": lambda spark, d: pack.query(table(spark, d, "documents")),
    "op9_toxicity": toxicity.query,
    "op10_substring_dedup": lambda spark, d: passages.query(table(spark, d, "documents")),
    "op11_merkle_manifest": lambda spark, d: merkle.query(table(spark, d, "documents")),
    "op12_line_dedup": lambda spark, d: lines.query(table(spark, d, "documents")),
    "op13_ranked_search": nra.query,
}

ORACLE = {
    "op1_chat_format": chat.ORACLE,
    "op2_token_counts": counts.ORACLE,
    "op5_topk_search": topk.ORACLE,
    "op11_merkle_manifest": merkle.ORACLE,
    "op12_line_dedup": lines.ORACLE,
    "op13_ranked_search": nra.ORACLE,
}
