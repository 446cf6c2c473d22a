"""Queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from .decontaminate import op1_benchmark_alignment
from .forest import OP7_SQL, op7_lsh_forest
from .licences import op8_licence_automaton
from .lines import OP3_SQL, op3_line_windows
from .paragraphs import OP9_SQL, op9_paragraph_bands
from .perplexity import op5_kneser_ney
from .pieces import op10_sentencepiece
from .substrings import OP6_SQL, op6_suffix_groups
from .toxicity import op4_factorization_machine
from .warc import OP2_SQL, op2_warc_transactions

QUERIES = {
    "op1_benchmark_alignment": op1_benchmark_alignment,
    "op2_warc_transactions": op2_warc_transactions,
    "op3_line_windows": op3_line_windows,
    "op4_factorization_machine": op4_factorization_machine,
    "op5_kneser_ney": op5_kneser_ney,
    "op6_suffix_groups": op6_suffix_groups,
    "op7_lsh_forest": op7_lsh_forest,
    "op8_licence_automaton": op8_licence_automaton,
    "op9_paragraph_bands": op9_paragraph_bands,
    "op10_sentencepiece": op10_sentencepiece,
}

ORACLES = {
    "op2_warc_transactions": OP2_SQL,
    "op3_line_windows": OP3_SQL,
    "op6_suffix_groups": OP6_SQL,
    "op7_lsh_forest": OP7_SQL,
    "op9_paragraph_bands": OP9_SQL,
}
