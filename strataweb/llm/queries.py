"""The operators' queries over the driver's tables, and the SQL for those that SQL can express."""

from __future__ import annotations

from . import chat, decontaminate, language, licenses, pieces, quality, simhash, substrings, toxicity, warc

QUERIES = {
    "op1_simhash": simhash.op1_simhash,
    "op2_chat": chat.op2_chat,
    "op3_licenses": licenses.op3_licenses,
    "op4_substrings": substrings.op4_substrings,
    "op5_language": language.op5_language,
    "op6_quality": quality.op6_quality,
    "op7_pieces": pieces.op7_pieces,
    "op8_decontaminate": decontaminate.op8_decontaminate,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_warc": warc.op10_warc,
}
ORACLES = {
    "op2_chat": chat.ORACLE,
    "op4_substrings": substrings.ORACLE,
    "op6_quality": quality.ORACLE,
    "op8_decontaminate": decontaminate.ORACLE,
    "op10_warc": warc.ORACLE,
}
