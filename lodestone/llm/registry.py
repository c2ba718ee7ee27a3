"""Queries of this subpackage by name, and SQL for those that SQL can express."""

from . import oracle
from .class_lm import op3_class_lm
from .decontaminate import op4_decontaminate
from .embedding_dedup import op8_embedding_dedup
from .html_extract import op5_html_extract
from .ngram_join import op7_ngram_join
from .packing import op9_best_fit_packing
from .suffix_dedup import op6_suffix_dedup
from .token_output import op10_token_output
from .token_counts import op2_token_counts
from .toxicity import op1_toxicity

QUERIES = {f.__name__: f for f in (op1_toxicity, op2_token_counts, op3_class_lm, op4_decontaminate, op5_html_extract, op6_suffix_dedup, op7_ngram_join, op8_embedding_dedup, op9_best_fit_packing, op10_token_output)}

ORACLE_SQL: dict[str, str] = {"op4_decontaminate": oracle.DECONTAMINATE, "op7_ngram_join": oracle.NGRAM_JOIN, "op8_embedding_dedup": oracle.EMBEDDING_DEDUP}
