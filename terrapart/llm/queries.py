"""The registered queries of the text operators and their SQL."""

from __future__ import annotations

from terrapart.llm.chat_format import OP7_SQL, op7_chat_format
from terrapart.llm.decontaminate import op10_decontamination
from terrapart.llm.line_dedup import op4_line_dedup
from terrapart.llm.quality_rules import OP1_SQL, op1_quality_rules
from terrapart.llm.repeats import op9_repeats
from terrapart.llm.secrets import op5_secrets
from terrapart.llm.sharding import op2_sharding
from terrapart.llm.simhash import op8_simhash
from terrapart.llm.token_file import op3_token_file
from terrapart.llm.word_bpe import op6_bpe


def queries() -> dict:
    return {
        "op1_quality_rules": op1_quality_rules,
        "op2_sharding": op2_sharding,
        "op3_token_file": op3_token_file,
        "op4_line_dedup": op4_line_dedup,
        "op5_secrets": op5_secrets,
        "op6_bpe": op6_bpe,
        "op7_chat_format": op7_chat_format,
        "op8_simhash": op8_simhash,
        "op9_repeats": op9_repeats,
        "op10_decontamination": op10_decontamination,
    }


def oracle_sql() -> dict:
    return {"op1_quality_rules": OP1_SQL, "op7_chat_format": OP7_SQL}
