"""Queries and SQL of the training-data operators, one module per operator."""

from __future__ import annotations

from . import attribution, chat, fingerprint, language, lines, media, mixing, packing, simhash, warc

QUERIES = {
    "op1_chat_format": chat.op1_chat_format,
    "op7_warc": warc.op7_warc,
    "op2_media": media.op2_media,
    "op8_token_counts": attribution.op8_token_counts,
    "op4_fingerprints": fingerprint.op4_fingerprints,
    "op10_line_dedup": lines.op10_line_dedup,
    "op3_language_id": language.op3_language_id,
    "op5_packing": packing.op5_packing,
    "op6_mixing": mixing.op6_mixing,
    "op9_simhash": simhash.op9_simhash,
}
ORACLE_SQL = {
    "op1_chat_format": chat.SQL,
    "op7_warc": warc.SQL,
    "op6_mixing": mixing.SQL,
}
