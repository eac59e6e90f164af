"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from lakesieve.llm import chat, linededup, mixing, neighbours, packing, quality, secrets, sharding, simhash, store

QUERIES = {
    "op1_neighbours": neighbours.op1_neighbours,
    "op2_secrets": secrets.op2_secrets,
    "op3_quality": quality.op3_quality,
    "op4_chat": chat.op4_chat,
    "op5_shard": sharding.op5_shard,
    "op6_mix": mixing.op6_mix,
    "op7_store": store.op7_store,
    "op8_pack": packing.op8_pack,
    "op9_simhash": simhash.op9_simhash,
    "op10_line_dedup": linededup.op10_line_dedup,
}
ORACLES = {"op4_chat": chat.ORACLE, "op10_line_dedup": linededup.ORACLE}
