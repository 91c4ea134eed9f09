"""Queries of the training-data operators and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

from . import op1_mixing, op6_topk, op9_chats, op12_repair, op13_ranked
from .op2_packing import op2_packing
from .op3_media import op3_media
from .op4_quality import op4_quality
from .op5_simhash import op5_simhash
from .op7_tokens import op7_token_files
from .op8_toxicity import op8_toxicity
from .op10_licenses import op10_licenses
from .op11_language import op11_language

QUERIES = {
    "op1_mixing": op1_mixing.op1_mixing,
    "op2_packing": op2_packing,
    "op3_media": op3_media,
    "op4_quality": op4_quality,
    "op5_simhash": op5_simhash,
    "op6_topk": op6_topk.op6_topk,
    "op7_token_files": op7_token_files,
    "op8_toxicity": op8_toxicity,
    "op9_chats": op9_chats.op9_chats,
    "op10_licenses": op10_licenses,
    "op11_language": op11_language,
    "op12_repair": op12_repair.op12_repair,
    "op13_ranked": op13_ranked.op13_ranked,
}

ORACLES: dict[str, str] = {
    "op1_mixing": op1_mixing.ORACLE,
    "op6_topk": op6_topk.ORACLE,
    "op9_chats": op9_chats.ORACLE,
    "op12_repair": op12_repair.ORACLE,
    "op13_ranked": op13_ranked.ORACLE,
}
