"""The queries of this subpackage and their SQL, for the entry module."""

from __future__ import annotations

from glyphmill.llm.decontam import OP2_SQL, op2_decontam
from glyphmill.llm.langid import op8_langid
from glyphmill.llm.lexical import OP12_SQL, op12_search
from glyphmill.llm.licenses import op13_licenses
from glyphmill.llm.linededup import OP4_SQL, op4_line_dedup
from glyphmill.llm.lm_scoring import op1_lm_scoring
from glyphmill.llm.merkle import OP11_SQL, op11_merkle
from glyphmill.llm.mixing import op6_mixing
from glyphmill.llm.pii import op3_pii
from glyphmill.llm.quality import op7_quality
from glyphmill.llm.quality_rules import op10_quality_rules
from glyphmill.llm.simhash import op9_simhash
from glyphmill.llm.tokencounts import op5_token_counts

QUERIES = {
    "op1_lm_scoring": op1_lm_scoring,
    "op2_decontam": op2_decontam,
    "op3_pii": op3_pii,
    "op4_line_dedup": op4_line_dedup,
    "op5_token_counts": op5_token_counts,
    "op6_mixing": op6_mixing,
    "op7_quality": op7_quality,
    "op8_langid": op8_langid,
    "op9_simhash": op9_simhash,
    "op10_quality_rules": op10_quality_rules,
    "op11_merkle": op11_merkle,
    "op12_search": op12_search,
    "op13_licenses": op13_licenses,
}

ORACLE_SQL: dict[str, str] = {
    "op2_decontam": OP2_SQL,
    "op4_line_dedup": OP4_SQL,
    "op11_merkle": OP11_SQL,
    "op12_search": OP12_SQL,
}
