"""Text column expressions (cleaning, run extraction, word lists)."""

from __future__ import annotations

from functools import reduce
from typing import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's for equal results).
# Review cleaning removes, in this order: ASCII letters and digits (optional),
# each listed word, the characters & | ;, then backslashes.
ASCII_ALNUM = "[a-zA-Z0-9]"
PUNCT_AMP_PIPE_SEMI = "[&|;]"
BACKSLASH = "\\\\"
# Runs of CJK ideographs plus the full-width comma and colon.
CJK_RUN = "[一-龥，：]+"
# ---------------------------------------------------------------------------

# Words of spaced scripts (Latin letters incl. Latin-1 accented letters) after
# lower-casing.  DuckDB's RE2 and Java's regex agree on this class.
WORD_PATTERN = "[a-zà-öø-ÿ]+"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def words(col, pattern: str = WORD_PATTERN, lower: bool = True) -> Column:
    """All matches of ``pattern`` in the (lower-cased) text, as array<string>."""
    c = _c(col)
    if lower:
        c = F.lower(c)
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(0))


def clean_text(col, remove_words: Iterable[str] = (), strip_ascii: bool = True) -> Column:
    """Sequential removal, each step a regex: ASCII alnum (optional), every
    word of ``remove_words`` in order, ``[&|;]``, backslashes."""
    c = _c(col)
    if strip_ascii:
        c = F.regexp_replace(c, ASCII_ALNUM, "")
    c = reduce(lambda acc, w: F.regexp_replace(acc, w, ""), list(remove_words), c)
    c = F.regexp_replace(c, PUNCT_AMP_PIPE_SEMI, "")
    return F.regexp_replace(c, BACKSLASH, "")


def char_runs(col, run_pattern: str = CJK_RUN, sep: str = " ") -> Column:
    """Every run matching ``run_pattern`` joined by ``sep`` (empty when none)."""
    return F.array_join(F.regexp_extract_all(_c(col), F.lit(run_pattern), F.lit(0)), sep)


def cjk_runs(col) -> Column:
    """Runs of CJK ideographs / full-width comma and colon joined by one space."""
    return char_runs(col, CJK_RUN, " ")


def cjk_bigrams(col) -> Column:
    """Character bigrams inside each ideograph run (a run of one character
    yields that character), the segmenter stand-in for unspaced scripts."""
    runs = F.regexp_extract_all(_c(col), F.lit("[一-龥]+"), F.lit(0))
    return F.flatten(F.transform(
        runs,
        lambda r: F.transform(
            F.sequence(F.lit(1), F.greatest(F.length(r) - 1, F.lit(1))),
            lambda i: F.substr(r, i, F.lit(2)))))
