"""The queries of this subpackage by name, and their DuckDB SQL."""

from __future__ import annotations

from tidemark.llm.decontamination import op8_decontamination
from tidemark.llm.language_id import op3_language_id
from tidemark.llm.line_dedup import op6_line_dedup
from tidemark.llm.ngram_join import op1_ngram_join
from tidemark.llm.packing import op2_packing
from tidemark.llm.pii import op4_personal_data
from tidemark.llm.quality_rules import OP7_SQL, op7_quality_rules
from tidemark.llm.secret_scans import op5_secret_scans
from tidemark.llm.token_counts import op10_token_counts
from tidemark.llm.token_files import op9_token_files


def queries() -> dict:
    return {f.__name__: f for f in (op1_ngram_join, op2_packing, op3_language_id, op4_personal_data, op5_secret_scans, op6_line_dedup, op7_quality_rules, op8_decontamination, op9_token_files, op10_token_counts)}


def oracle_sql() -> dict:
    return {"op7_quality_rules": OP7_SQL}
