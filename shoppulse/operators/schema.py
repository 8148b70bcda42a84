"""Schema-level operators: column families, positional renames, duplicate
names, exclusion columns, all-null / zero-variance columns, unions.

Decisions about *which* columns to keep are made from one aggregate row
(one value per column) so the driver only ever sees d numbers, never data.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce
from typing import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def features_only(df: DataFrame, *id_cols: str) -> DataFrame:
    """Drop identifier / label columns."""
    return df.drop(*id_cols)


def label_cohorts(pos: DataFrame, neg: DataFrame, label: str = "label") -> DataFrame:
    """Tag two cohorts 1 / 0 and union them by column name."""
    return union_by_name([pos.withColumn(label, F.lit(1)), neg.withColumn(label, F.lit(0))])


def union_by_name(dfs: Sequence[DataFrame], allow_missing: bool = False) -> DataFrame:
    """Union by column name (a positional union silently misaligns tables
    whose column sets were decided per table)."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=allow_missing), dfs)


def filter_extra_zero(target: DataFrame, reference_cols: Iterable[str]) -> DataFrame:
    """Keep rows where every column the target has beyond ``reference_cols``
    is 0, then drop those columns.  No extra column -> unchanged."""
    ref = set(reference_cols)
    extra = [c for c in target.columns if c not in ref]
    if not extra:
        return target
    cond = reduce(lambda a, b: a & b, [F.col(c) == 0 for c in extra])
    return target.filter(cond).drop(*extra)


# ---------------------------------------------------------------- families --
# Tokens looked for in column names, the levels a token is summed
# at, and the names of the resulting lists.
PCHS, FLW, BRS, CLK, ATTR, CART, SECOND = "pchs", "flw", "brs", "clk", "attr", "cart", "secondcate"
LEVEL_NAMES = {"all": "{}_columns", "first": "{}_firstcate_columns", "second": "{}_secondcate_columns"}
FAMILY_LEVELS = {PCHS: ("all", "first", "second"), BRS: ("all", "first", "second"), CLK: ("all", "first", "second"),
                 CART: ("all", "first", "second"), FLW: ("second",), ATTR: ("all",)}


def in_family(column: str, token: str, level: str) -> bool:
    """Whether a column belongs to a token's family at a level.

    A column carries its token; at the first level it carries no second-level
    token, at the second level it does.  Followed shops exist at the second
    level only and do not spell it out; purchased attributes are no first-level
    purchases.
    """
    if token not in column:
        return False
    if level == "all" or FAMILY_LEVELS[token] == (level,):
        return True
    if level == "second":
        return SECOND in column
    return SECOND not in column and not (token == PCHS and ATTR in column)


def column_families(cols: Sequence[str]) -> dict[str, list[str]]:
    """Columns of every family; families overlap (a purchase column is in one
    list for all purchases and in one for its level)."""
    return {LEVEL_NAMES[level].format(token): [c for c in cols if in_family(c, token, level)]
            for token, levels in FAMILY_LEVELS.items() for level in levels}


def leftover_columns(cols: Sequence[str], families: dict[str, list[str]]) -> list[str]:
    """Columns in no family, in table order."""
    used = {c for v in families.values() for c in v}
    return [c for c in cols if c not in used]


# ------------------------------------------------------------------ renames --

def rename_positional(df: DataFrame, names: Sequence[str], skip_first: int = 0,
                      skip_last: int = 0) -> DataFrame:
    """Give the columns between the first ``skip_first`` and the last
    ``skip_last`` the names ``names`` by position.  The count must match."""
    cols = df.columns
    middle = cols[skip_first:len(cols) - skip_last]
    if len(middle) != len(names):
        raise ValueError(f"rename_positional: {len(middle)} columns but {len(names)} names")
    new = cols[:skip_first] + list(names) + cols[len(cols) - skip_last:]
    return df.toDF(*new)


def dedup_names(names: Sequence[str]) -> list[str]:
    """Every name occurring twice or more gets a running suffix
    ``x -> x1, x2, ...``; unique names are unchanged."""
    counts = Counter(names)
    seen: Counter = Counter()
    out = []
    for n in names:
        if counts[n] >= 2:
            seen[n] += 1
            out.append(f"{n}{seen[n]}")
        else:
            out.append(n)
    return out


def dedup_columns(df: DataFrame) -> DataFrame:
    """:func:`dedup_names` applied to a DataFrame (e.g. after a join that
    repeated column names)."""
    return df.toDF(*dedup_names(df.columns))


# ---------------------------------------------------------- column checks --

def _stddev(c: str):
    """Sample standard deviation; exactly 0 for equal values, whose computed
    one need not be; null for fewer than two values."""
    x = F.col(c).cast("double")
    return F.when((F.count(x) > 1) & (F.min(x) == F.max(x)), F.lit(0.0)).otherwise(F.stddev_samp(x))


def column_stddevs(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Long table ``(column, stddev)``: sample standard deviation per column,
    nulls skipped (null when fewer than two values).  One aggregation pass,
    unpivoted inside Spark."""
    row = df.agg(*[_stddev(c).alias(c) for c in cols])
    return row.unpivot([], list(cols), "column", "stddev")


def fit_zero_variance(df: DataFrame, cols: Sequence[str], fraction: float | None = None,
                      key: str | None = None, seed: int = 2019) -> list[str]:
    """Names of columns with at least two values, all equal (a column of fewer is kept).
    Full data by default; ``fraction`` with ``key`` uses a stable hash sample."""
    data = df
    if fraction is not None:
        from shoppulse.operators.sampling import hash_sample
        data = hash_sample(df, key, fraction, seed)
    row = data.agg(*[_stddev(c).alias(c) for c in cols]).first()
    return [c for c in cols if row[c] == 0.0]


def drop_zero_variance(dfs: Sequence[DataFrame], cols: Sequence[str]) -> tuple[list[DataFrame], list[str]]:
    """Fit on the union of ``dfs`` (by name) and drop the zero-variance
    columns from every table (the reference forgets the target table)."""
    zero = fit_zero_variance(union_by_name([d.select(*cols) for d in dfs]), cols)
    return [d.drop(*zero) for d in dfs], zero


def all_null_columns(df: DataFrame, cols: Sequence[str]) -> list[str]:
    """Columns without a single non-null value (one ``count`` per column)."""
    row = df.agg(*[F.count(c).alias(c) for c in cols]).first()
    return [c for c in cols if row[c] == 0]


def fill_zero(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """null and NaN -> 0 (on ``cols`` or on every numeric column)."""
    return df.na.fill(0, subset=list(cols)) if cols else df.na.fill(0)
