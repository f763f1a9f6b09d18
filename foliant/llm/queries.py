"""The operators' queries with production parameters, and DuckDB SQL where it can express them."""

from foliant.llm.op1_mixing import op1_mixing
from foliant.llm.op2_embedding_dedup import op2_embedding_dedup
from foliant.llm.op3_html_extraction import op3_html_extraction
from foliant.llm.op4_quality_rules import op4_quality_rules
from foliant.llm.op5_toxicity import op5_toxicity
from foliant.llm.op6_packing import op6_packing
from foliant.llm.op7_language_id import op7_language_id
from foliant.llm.op8_ngram_jaccard import op8_ngram_jaccard
from foliant.llm.op9_line_dedup import op9_line_dedup
from foliant.llm.op10_quality_classifier import op10_quality_classifier
from foliant.llm.op11_fill_in_middle import SQL as FILL_IN_MIDDLE
from foliant.llm.op11_fill_in_middle import op11_fill_in_middle
from foliant.llm.op12_suffix_dedup import op12_suffix_dedup
from foliant.llm.op13_periodic_runs import op13_periodic_runs

QUERIES = {f.__name__: f for f in (op1_mixing, op2_embedding_dedup, op3_html_extraction, op4_quality_rules, op5_toxicity, op6_packing, op7_language_id, op8_ngram_jaccard, op9_line_dedup, op10_quality_classifier, op11_fill_in_middle, op12_suffix_dedup, op13_periodic_runs)}
ORACLE_SQL: dict[str, str] = {"op11_fill_in_middle": FILL_IN_MIDDLE}
