"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from strandlake.llm.lexical import OP12_SQL, op12_block_max_wand
from strandlake.llm.minhash import OP5_SQL, op5_minhash_near_dedup
from strandlake.llm.packing import op2_best_fit_packing
from strandlake.llm.pieces import op6_sentencepiece
from strandlake.llm.prefix_forest import op4_prefix_forest
from strandlake.llm.quality import op1_quality_classifier
from strandlake.llm.quality_rules import op8_quality_rules
from strandlake.llm.secret_ledger import OP3_SQL, op3_secret_scans
from strandlake.llm.substrings import OP7_SQL, op7_substring_dedup
from strandlake.llm.toxicity import op10_toxicity
from strandlake.llm.url_templates import op11_url_filters
from strandlake.llm.warc import OP9_SQL, op9_warc

QUERIES = {f.__name__: f for f in (op1_quality_classifier, op2_best_fit_packing, op3_secret_scans, op4_prefix_forest, op5_minhash_near_dedup, op6_sentencepiece, op7_substring_dedup, op8_quality_rules, op9_warc, op10_toxicity, op11_url_filters, op12_block_max_wand)}
ORACLE_SQL = {
    "op3_secret_scans": OP3_SQL,
    "op5_minhash_near_dedup": OP5_SQL,
    "op7_substring_dedup": OP7_SQL,
    "op9_warc": OP9_SQL,
    "op12_block_max_wand": OP12_SQL,
}
