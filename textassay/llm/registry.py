"""The queries of this subpackage and the SQL that gives the same rows, where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .alignment import op13_alignment
from .cascade import OP11_SQL, op11_quality_rules
from .chunks import op9_fingerprints
from .exact_dedup import OP1_SQL, op1_exact_dedup
from .html_text import op7_html_text
from .mixing import op3_mixing
from .packing import op6_packing
from .pitman_yor import op10_language_model
from .prefix_trie import OP12_SQL, op12_prefix_trie
from .quality import op5_quality
from .repeats import op8_repeats
from .secrets import op4_secrets
from .simhash import op2_simhash

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_simhash": op2_simhash,
    "op3_mixing": op3_mixing,
    "op4_secrets": op4_secrets,
    "op5_quality": op5_quality,
    "op6_packing": op6_packing,
    "op7_html_text": op7_html_text,
    "op8_repeats": op8_repeats,
    "op9_fingerprints": op9_fingerprints,
    "op10_language_model": op10_language_model,
    "op11_quality_rules": op11_quality_rules,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_alignment": op13_alignment,
}

ORACLE_SQL: dict[str, str] = {
    "op1_exact_dedup": OP1_SQL,
    "op11_quality_rules": OP11_SQL,
    "op12_prefix_trie": OP12_SQL,
}
