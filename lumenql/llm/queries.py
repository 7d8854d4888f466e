"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from . import (
    chat,
    decontaminate,
    licenses,
    mixing,
    quality,
    simhash,
    spans,
    topk,
    toxicity,
    warc,
)

QUERIES = {
    "op1_exact_topk": topk.op1_exact_topk,
    "op2_quality": quality.op2_quality,
    "op3_warc": warc.op3_warc,
    "op4_chat_formatting": chat.op4_chat_formatting,
    "op5_substring_dedup": spans.op5_substring_dedup,
    "op6_license_scan": licenses.op6_license_scan,
    "op7_decontamination": decontaminate.op7_decontamination,
    "op8_simhash": simhash.op8_simhash,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_mixing": mixing.op10_mixing,
}

#: The others are tested against brute force, or by held-out accuracy.
SQL = {
    "op1_exact_topk": topk.OP1_SQL,
    "op3_warc": warc.OP3_SQL,
    "op4_chat_formatting": chat.OP4_SQL,
    "op6_license_scan": licenses.OP6_SQL,
    "op7_decontamination": decontaminate.OP7_SQL,
    "op10_mixing": mixing.OP10_SQL,
}
