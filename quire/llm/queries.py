"""Queries of this subpackage by name, and SQL for those that SQL can express."""

from __future__ import annotations

from . import ann, bytepairs, chat, classifier, mixing, negatives, pieces, rules, secrets, simhash, spelling, suffix, tokens

QUERIES = {
    "op1_mix": mixing.op1_mix,
    "op2_quality": classifier.op2_quality,
    "op3_rules": rules.op3_rules,
    "op4_ann": ann.op4_ann,
    "op5_chat": chat.op5_chat,
    "op6_pieces": pieces.op6_pieces,
    "op7_suffix": suffix.op7_suffix,
    "op8_simhash": simhash.op8_simhash,
    "op9_tokens": tokens.op9_tokens,
    "op10_secrets": secrets.op10_secrets,
    "op11_negatives": negatives.op11_negatives,
    "op12_bytepairs": bytepairs.op12_bytepairs,
    "op13_spelling": spelling.op13_spelling,
}

ORACLES = {
    "op1_mix": mixing.OP1_SQL,
    "op3_rules": rules.OP3_SQL,
    "op5_chat": chat.OP5_SQL,
    "op11_negatives": negatives.OP11_SQL,
    "op13_spelling": spelling.OP13_SQL,
}
