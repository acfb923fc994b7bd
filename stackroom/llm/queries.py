"""The queries of this subpackage, and the SQL that tests them where SQL can express them."""

from __future__ import annotations

from .bpe import op3_byte_bpe
from .exact_dedup import OP9_SQL, op9_exact_dedup
from .html_text import op2_html_extraction
from .license_scan import OP4_SQL, op4_license_scan
from .mixing import OP6_SQL, op6_mix_sources
from .near_dup import OP7_SQL, op7_ngram_jaccard
from .quality_rules import op1_quality_rules
from .suffix_dedup import OP8_SQL, op8_suffix_dedup
from .toxicity import op10_toxicity
from .url_filter import OP5_SQL, op5_url_filter

QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_html_extraction": op2_html_extraction,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_license_scan": op4_license_scan,
    "op5_url_filter": op5_url_filter,
    "op6_mix_sources": op6_mix_sources,
    "op7_ngram_jaccard": op7_ngram_jaccard,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_toxicity": op10_toxicity,
}

ORACLES = {
    "op4_license_scan": OP4_SQL,
    "op5_url_filter": OP5_SQL,
    "op6_mix_sources": OP6_SQL,
    "op7_ngram_jaccard": OP7_SQL,
    "op8_suffix_dedup": OP8_SQL,
    "op9_exact_dedup": OP9_SQL,
}
