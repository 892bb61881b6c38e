"""Queries of the corpus operators on the driver's tables, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

import corpus_pipeline

from .bpe import op2_bpe
from .chat_format import OP7_SQL, op7_chat_format
from .embedding_join import OP9_SQL, op9_embedding_neardup
from .hard_negatives import OP12_SQL, op12_hard_negatives
from .html_extract import op3_html_extract
from .mixing import OP4_SQL, op4_mix_sources
from .pii import op1_pii
from .quality_model import op5_quality_model
from .quality_rules import op8_quality_rules
from .runs import op13_word_runs
from .shingle_join import OP6_SQL, op6_jaccard_join
from .toxicity import op11_toxicity
from .url_filter import op10_url_filter

QUERIES = {
    "op1_pii": op1_pii,
    "op2_bpe": op2_bpe,
    "op3_html_extract": op3_html_extract,
    "op4_mix_sources": op4_mix_sources,
    "op5_quality_model": op5_quality_model,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_chat_format": op7_chat_format,
    "op8_quality_rules": op8_quality_rules,
    "op9_embedding_neardup": op9_embedding_neardup,
    "op10_url_filter": op10_url_filter,
    "op11_toxicity": op11_toxicity,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_word_runs": op13_word_runs,
    "pipeline": corpus_pipeline.run,
}

ORACLES = {
    "op4_mix_sources": OP4_SQL,
    "op6_jaccard_join": OP6_SQL,
    "op7_chat_format": OP7_SQL,
    "op9_embedding_neardup": OP9_SQL,
    "op12_hard_negatives": OP12_SQL,
}

if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
