"""Queries of the training-data operators, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from . import chat, ctw, hash_forest, mixing, pieces, quality, ring, simhash, token_store, toxicity

QUERIES = {
    "op1_hash_forest": hash_forest.op1,
    "op2_chat": chat.op2,
    "op3_mixing": mixing.op3,
    "op4_pieces": pieces.op4,
    "op5_simhash": simhash.op5,
    "op6_sharding": ring.op6,
    "op7_ctw": ctw.op7,
    "op8_quality": quality.op8,
    "op9_toxicity": toxicity.op9,
    "op10_token_store": token_store.op10,
}

ORACLE_SQL: dict[str, str] = {
    "op2_chat": chat.ORACLE,
    "op3_mixing": mixing.ORACLE,
    "op8_quality": quality.ORACLE,
}
