"""Column expressions.  Everything here maps Columns to Columns and stays
JVM-side (built-in ``pyspark.sql.functions``), so it sits inside whole-stage
codegen wherever it is used."""

from shoppulse.functions.text import (
    WORD_PATTERN, words, clean_text, cjk_runs, cjk_bigrams, char_runs,
)
from shoppulse.functions.numeric import (
    row_sum, ratio, safe_rate, p1, round_class, blend, threshold_label,
    min_max_expr, share_label,
)
from shoppulse.functions.hashing import hash_bucket, unit_hash

__all__ = [
    "WORD_PATTERN", "words", "clean_text", "cjk_runs", "cjk_bigrams", "char_runs",
    "row_sum", "ratio", "safe_rate", "p1", "round_class", "blend", "threshold_label",
    "min_max_expr", "share_label", "hash_bucket", "unit_hash",
]
