"""The queries of this subpackage, by name, and the SQL of those that SQL can express. All modules are imported here, so that whoever can import this one has them all."""

from __future__ import annotations

from redactory.llm.chat_format import OP3_SQL, op3_chat_format
from redactory.llm.decontamination import OP10_SQL, op10_decontamination
from redactory.llm.embedding_dedup import op13_embedding_dedup
from redactory.llm.huffman import op7_token_files
from redactory.llm.lexical_search import OP12_SQL, op12_lexical_search
from redactory.llm.line_dedup import OP2_SQL, op2_line_dedup
from redactory.llm.mixing import OP9_SQL, op9_mixing
from redactory.llm.periodic_runs import op11_periodic_runs
from redactory.llm.quality_classifier import op1_quality_classifier
from redactory.llm.quality_rules import op5_quality_rules
from redactory.llm.simhash import op6_simhash
from redactory.llm.suffix_dedup import op4_suffix_dedup
from redactory.llm.tokens import op8_token_counts

#: name: (query, its SQL or None)
ENTRIES = {
    "op1_quality_classifier": (op1_quality_classifier, None),
    "op2_line_dedup": (op2_line_dedup, OP2_SQL),
    "op3_chat_format": (op3_chat_format, OP3_SQL),
    "op4_suffix_dedup": (op4_suffix_dedup, None),
    "op5_quality_rules": (op5_quality_rules, None),
    "op6_simhash": (op6_simhash, None),
    "op7_token_files": (op7_token_files, None),
    "op8_token_counts": (op8_token_counts, None),
    "op9_mixing": (op9_mixing, OP9_SQL),
    "op10_decontamination": (op10_decontamination, OP10_SQL),
    "op11_periodic_runs": (op11_periodic_runs, None),
    "op12_lexical_search": (op12_lexical_search, OP12_SQL),
    "op13_embedding_dedup": (op13_embedding_dedup, None),
}


def queries() -> dict:
    return {name: query for name, (query, _) in ENTRIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in ENTRIES.items() if sql}
