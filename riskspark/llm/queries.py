"""Registered queries of this subpackage, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from . import ann, chat, decontam, jaccard, language, lexical, license, packing, pii, spelling, substring, tokenfiles, toxicity

Q = {
    "op1_ngram_jaccard": jaccard.op1_ngram_jaccard,
    "op2_language": language.op2_language,
    "op3_licences": license.op3_licences,
    "op4_token_files": tokenfiles.op4_token_files,
    "op5_decontaminate": decontam.op5_decontaminate,
    "op6_pack": packing.op6_pack,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_chat_format": chat.op8_chat_format,
    "op9_pii": pii.op9_pii,
    "op10_nearest": ann.op10_nearest,
    "op11_substring": substring.op11_substring,
    "op12_lexical": lexical.op12_lexical,
    "op13_spelling": spelling.op13_spelling,
}
SQL = {
    "op1_ngram_jaccard": jaccard.OP1_SQL,
    "op5_decontaminate": decontam.OP5_SQL,
    "op8_chat_format": chat.OP8_SQL,
    "op11_substring": substring.OP11_SQL,
    "op12_lexical": lexical.OP12_SQL,
    "op13_spelling": spelling.OP13_SQL,
}
