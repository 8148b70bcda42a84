"""Numeric column expressions: family sums, guarded ratios, score helpers."""

from __future__ import annotations

from functools import reduce
from typing import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def row_sum(cols: Sequence) -> Column:
    """Horizontal sum, nulls count as 0, an empty family is 0."""
    cols = list(cols)
    if not cols:
        return F.lit(0)
    return reduce(lambda a, b: a + b, [F.coalesce(_c(c), F.lit(0)) for c in cols])


def ratio(num, den) -> Column:
    """num/den as double; x/0 -> -1.0 and 0/0 -> null (the undefined case).

    Plain ``/`` raises under ANSI mode, so both zero cases are handled before
    dividing.  Null marks 0/0 so callers can drop columns that are undefined on
    every row before filling it with 0 (see :func:`safe_rate`)."""
    n, d = _c(num).cast("double"), _c(den).cast("double")
    return (F.when(d != 0, n / d)
            .when(n == 0, F.lit(None).cast("double"))
            .otherwise(F.lit(-1.0)))


def safe_rate(num, den) -> Column:
    """Conversion rate with 0/0 -> 0 and x/0 -> -1."""
    return F.coalesce(ratio(num, den), F.lit(0.0))


def p1(col) -> Column:
    """P(class 1) out of a probability vector."""
    from pyspark.ml.functions import vector_to_array
    return vector_to_array(_c(col))[1]


def round_class(col) -> Column:
    """Round half to even to a 0/1 class (numpy/Python rounding)."""
    return F.bround(_c(col), 0).cast("int")


def blend(a, b, w: float) -> Column:
    """Linear blend ``w*a + (1-w)*b``."""
    return F.lit(float(w)) * _c(a) + F.lit(1.0 - float(w)) * _c(b)


def threshold_label(col, alpha: float = 0.5) -> Column:
    """1 when ``col >= alpha`` else 0."""
    return F.when(_c(col) >= F.lit(alpha), F.lit(1)).otherwise(F.lit(0))


def min_max_expr(col, lo: Column, hi: Column) -> Column:
    """``(x - lo) / (hi - lo)``; 0.0 when hi == lo (constant input)."""
    x = _c(col).cast("double")
    return F.when(hi > lo, (x - lo) / (hi - lo)).otherwise(F.lit(0.0))


def share_label(topic, pct) -> Column:
    """``topic:<i>(<pct rounded to 2>%)`` with pct already in percent; a whole
    percentage prints without decimals (``50``), as R prints numbers."""
    pct_txt = F.regexp_replace(F.round(_c(pct), 2).cast("string"), "\\.0$", "")
    return F.concat(F.lit("topic:"), _c(topic).cast("string"), F.lit("("), pct_txt, F.lit("%)"))
