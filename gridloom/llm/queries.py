"""The registered queries of the corpus operators, and their DuckDB counterparts where SQL can express them."""

from __future__ import annotations

from gridloom.llm import chat, codes, phrases, substrings
from gridloom.llm.langid import op5_langid
from gridloom.llm.mixing import op1_mixing
from gridloom.llm.packing import op6_packing
from gridloom.llm.pii import op7_pii
from gridloom.llm.quality import op3_quality
from gridloom.llm.simhash import op8_simhash
from gridloom.llm.sketches import op9_sketches
from gridloom.llm.tokens import op11_tokens
from gridloom.llm.urls import op2_urls

QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_urls": op2_urls,
    "op3_quality": op3_quality,
    "op4_chat": chat.op4_chat,
    "op5_langid": op5_langid,
    "op6_packing": op6_packing,
    "op7_pii": op7_pii,
    "op8_simhash": op8_simhash,
    "op9_sketches": op9_sketches,
    "op10_substrings": substrings.op10_substrings,
    "op11_tokens": op11_tokens,
    "op12_phrases": phrases.op12_phrases,
    "op13_codes": codes.op13_codes,
}

#: The others need XXH64 permutations, trained models, patterns with positions or a tokenizer: tests hold them against plain versions.
ORACLE_SQL = {
    "op4_chat": chat.ORACLE_SQL,
    "op10_substrings": substrings.ORACLE_SQL,
    "op12_phrases": phrases.ORACLE_SQL,
    "op13_codes": codes.ORACLE_SQL,
}
