"""Queries and SQL of this subpackage, by name."""

from __future__ import annotations

from rostra.llm.byte_bpe import op3_byte_bpe
from rostra.llm.chat import OP6_SQL, op6_chat_rotation
from rostra.llm.decontaminate import OP7_SQL, op7_decontamination
from rostra.llm.fingerprints import op13_fingerprints
from rostra.llm.hard_negatives import OP12_SQL, op12_hard_negatives
from rostra.llm.language import op4_language_id
from rostra.llm.merkle import OP11_SQL, op11_merkle
from rostra.llm.near_dedup import OP8_SQL, op8_near_dedup
from rostra.llm.orc_ids import op10_orc_ids
from rostra.llm.pseudo_likelihood import op9_pseudo_likelihood
from rostra.llm.token_counts import op1_token_counts
from rostra.llm.topk import OP5_SQL, op5_topk
from rostra.llm.url_filter import OP2_SQL, op2_url_filter

QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_url_filter": op2_url_filter,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_language_id": op4_language_id,
    "op5_topk": op5_topk,
    "op6_chat_rotation": op6_chat_rotation,
    "op7_decontamination": op7_decontamination,
    "op8_near_dedup": op8_near_dedup,
    "op9_pseudo_likelihood": op9_pseudo_likelihood,
    "op10_orc_ids": op10_orc_ids,
    "op11_merkle": op11_merkle,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_fingerprints": op13_fingerprints,
}

ORACLE_SQL = {
    "op2_url_filter": OP2_SQL,
    "op5_topk": OP5_SQL,
    "op6_chat_rotation": OP6_SQL,
    "op7_decontamination": OP7_SQL,
    "op8_near_dedup": OP8_SQL,
    "op11_merkle": OP11_SQL,
    "op12_hard_negatives": OP12_SQL,
}
