"""The queries of this subpackage."""

from __future__ import annotations

from tessera.llm.bands import op12_bands
from tessera.llm.bpe import op8_bpe
from tessera.llm.chat import op6_chat
from tessera.llm.langid import op11_language
from tessera.llm.lines import op4_lines
from tessera.llm.multiset import op7_multiset
from tessera.llm.negatives import op13_negatives
from tessera.llm.packing import op9_packing
from tessera.llm.pii import op3_pii
from tessera.llm.quality import op10_quality
from tessera.llm.sharding import op2_sharding
from tessera.llm.simhash import op1_simhash
from tessera.llm.urls import op5_urls

QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_sharding": op2_sharding,
    "op3_pii": op3_pii,
    "op4_lines": op4_lines,
    "op5_urls": op5_urls,
    "op6_chat": op6_chat,
    "op7_multiset": op7_multiset,
    "op8_bpe": op8_bpe,
    "op9_packing": op9_packing,
    "op10_quality": op10_quality,
    "op11_language": op11_language,
    "op12_bands": op12_bands,
    "op13_negatives": op13_negatives,
}
