"""Queries over the text operators, and their SQL where SQL can express them."""

from __future__ import annotations

from nimbara.llm.decontaminate import OP7_SQL, op7_decontamination
from nimbara.llm.html import op1_html_extraction
from nimbara.llm.line_dedup import op6_line_dedup
from nimbara.llm.ngram_join import OP8_SQL, op8_ngram_join
from nimbara.llm.packing import op3_packing
from nimbara.llm.pii import op5_pii
from nimbara.llm.quality import OP4_SQL, op4_quality_rules
from nimbara.llm.substring import OP10_SQL, op10_substring_dedup
from nimbara.llm.token_counts import op9_token_counts
from nimbara.llm.toxicity import op2_toxicity

QUERIES = {
    "op1_html_extraction": op1_html_extraction,
    "op2_toxicity": op2_toxicity,
    "op3_packing": op3_packing,
    "op4_quality_rules": op4_quality_rules,
    "op5_pii": op5_pii,
    "op6_line_dedup": op6_line_dedup,
    "op7_decontamination": op7_decontamination,
    "op8_ngram_join": op8_ngram_join,
    "op9_token_counts": op9_token_counts,
    "op10_substring_dedup": op10_substring_dedup,
}

ORACLE_SQL: dict[str, str] = {"op4_quality_rules": OP4_SQL, "op7_decontamination": OP7_SQL, "op8_ngram_join": OP8_SQL, "op10_substring_dedup": OP10_SQL}
