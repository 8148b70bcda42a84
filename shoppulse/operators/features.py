"""Behaviour features over a wide user table: family sums, conversion
ratios, vector assembly and chi-square selection.

All sums and ratios are one ``select`` of column expressions (no pandas round
trip); the data-dependent part (which ratio columns survive) is decided once
at fit time from a single aggregate row and reused for every table scored
with the same fitted object, so positives, negatives and target share one
schema.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoppulse.functions.numeric import ratio, row_sum
from shoppulse.operators.schema import column_families

# Names of the sums and of the ratios with their families.
SUM_NAMES = ["attr_sum", "pchs_sum", "clk_sum", "brs_sum", "cart_sum"]
# (ratio name, numerator family, denominator family)
RATIOS = [
    ("clk_rate", "pchs_columns", "clk_columns"),
    ("clk_firstcate_rate", "pchs_firstcate_columns", "clk_firstcate_columns"),
    ("clk_secondcate_rate", "pchs_secondcate_columns", "clk_secondcate_columns"),
    ("brs_rate", "pchs_columns", "brs_columns"),
    ("brs_firstcate_rate", "pchs_firstcate_columns", "brs_firstcate_columns"),
    ("brs_secondcate_rate", "pchs_secondcate_columns", "brs_secondcate_columns"),
    ("cart_rate", "pchs_columns", "cart_columns"),
    ("cart_firstcate_rate", "pchs_firstcate_columns", "cart_firstcate_columns"),
    ("cart_secondcate_rate", "pchs_secondcate_columns", "cart_secondcate_columns"),
    ("attr_rate", "pchs_columns", "attr_columns"),
]
_SUM_FAMILY = {"attr_sum": "attr_columns", "pchs_sum": "pchs_columns", "clk_sum": "clk_columns",
               "brs_sum": "brs_columns", "cart_sum": "cart_columns"}


def family_sums(df: DataFrame, families: dict[str, list[str]] | None = None,
                level_sums: bool = True) -> DataFrame:
    """Append per-family row totals (nulls as 0, empty family = 0): the five
    family totals and, with ``level_sums``, first/second-category totals."""
    fam = families or column_families(df.columns)
    exprs = {name: row_sum(fam[f]) for name, f in _SUM_FAMILY.items()}
    if level_sums:
        for f in ("pchs", "brs", "clk", "cart"):
            exprs[f"{f}_firstcate_sum"] = row_sum(fam[f"{f}_firstcate_columns"])
            exprs[f"{f}_secondcate_sum"] = row_sum(fam[f"{f}_secondcate_columns"])
    return df.withColumns(exprs)


def _ratio_exprs(fam):
    return {name: ratio(row_sum(fam[num]), row_sum(fam[den])) for name, num, den in RATIOS}


@dataclass
class BehaviourFeatures:
    """Five family sums + ten conversion ratios.

    ``fit`` drops ratio columns that are undefined (0/0) on every row and
    checks that at least one row is defined on all surviving ratios (any row
    is, if none survives: the sums are then appended alone); when none is,
    nothing is appended and nothing is filled.  ``transform``
    appends the sums and surviving ratios (x/0 -> -1) and turns null/NaN
    into 0 on every column."""

    families: dict[str, list[str]] = field(default_factory=dict)
    ratios: list[str] = field(default_factory=list)
    appended: bool = False

    def fit(self, df: DataFrame) -> "BehaviourFeatures":
        fam = column_families(df.columns)
        rx = _ratio_exprs(fam)
        names = [n for n, _, _ in RATIOS]
        # bit i set <=> ratio i defined on the row; one pass gives both the
        # surviving set (OR of masks) and whether some row covers all of it
        mask = sum((F.when(rx[n].isNotNull(), F.lit(1 << i)).otherwise(F.lit(0))
                    for i, n in enumerate(names)), F.lit(0))
        row = df.select(mask.alias("m")).agg(
            F.bit_or("m").alias("any"), F.max(F.bit_count("m")).alias("best")).first()
        any_mask = row["any"] or 0
        survivors = [n for i, n in enumerate(names) if any_mask >> i & 1]
        complete = row["any"] is not None and row["best"] == bin(any_mask).count("1")
        self.families, self.ratios, self.appended = fam, survivors, complete
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        if not self.appended:
            return df
        fam = column_families(df.columns)
        rx = _ratio_exprs(fam)
        exprs = {name: row_sum(fam[f]) for name, f in _SUM_FAMILY.items()}
        exprs.update({n: rx[n] for n in self.ratios})
        return df.withColumns(exprs).na.fill(0)

    def output_columns(self, df: DataFrame) -> list[str]:
        return list(df.columns) + (SUM_NAMES + self.ratios if self.appended else [])


def behaviour_features(train: DataFrame, *others: DataFrame) -> list[DataFrame]:
    """Fit on ``train`` and transform ``train`` and every other table."""
    bf = BehaviourFeatures().fit(train)
    return [bf.transform(d) for d in (train, *others)]


# ------------------------------------------------------------ ML features --

def assemble(df: DataFrame, cols: Sequence[str], out_col: str = "fvec",
             handle_invalid: str = "keep") -> DataFrame:
    """Feature vector column (named ``fvec``: Spark resolves names without
    case, so ``features``/``Features`` pairs would collide)."""
    from pyspark.ml.feature import VectorAssembler
    return VectorAssembler(inputCols=list(cols), outputCol=out_col,
                           handleInvalid=handle_invalid).transform(df)


def top_feature_count(alpha: float, d: int) -> int:
    """``int(alpha * d)`` clamped to at least 1 (0 makes the selector fail)."""
    return max(1, int(alpha * d))


def chi2_table(df: DataFrame, cols: Sequence[str], label: str = "label", buckets: int = 10) -> DataFrame:
    """Chi-square statistic of each (bucketed) feature against the label:
    ``(feature, statistic, dof)``.  Features are cut into ``buckets``
    equal-width bins between their min and max (one pass for the bounds),
    every (feature, bin, label) count comes from one ``groupBy`` over an
    unpivoted table, and expected counts from the margins."""
    bounds = df.agg(*[F.min(c).alias(f"lo_{i}") for i, c in enumerate(cols)],
                    *[F.max(c).alias(f"hi_{i}") for i, c in enumerate(cols)])
    long = df.select(label, F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.lit(i).alias("fi"), F.col(c).cast("double").alias("x"))
        for i, c in enumerate(cols)])).alias("kv")).select(label, "kv.*")
    b = bounds.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("fi"), F.col(f"lo_{i}").cast("double").alias("lo"),
                 F.col(f"hi_{i}").cast("double").alias("hi")) for i in range(len(cols))])).alias("b")).select("b.*")
    binned = long.join(F.broadcast(b), "fi").select(
        "feature", label,
        F.when(F.col("hi") > F.col("lo"),
               F.least(F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * buckets),
                       F.lit(buckets - 1))).otherwise(F.lit(0)).cast("int").alias("bin"))
    return chi2_from_binned(binned, label)


def chi2_from_binned(binned: DataFrame, label: str = "label") -> DataFrame:
    """Pearson chi-square per feature from ``(feature, bin, label)`` rows.

    Uses ``chi2 = sum(o^2 / e) - t`` over the observed cells only, so no
    bin x label grid is ever materialised.  After one aggregation of the rows
    everything is read off the small table of cells, by windows per feature."""
    from pyspark.sql import Window
    cell = binned.groupBy("feature", "bin", label).agg(F.count(F.lit(1)).cast("double").alias("o"))

    def over(*by):
        return F.sum("o").over(Window.partitionBy(*by))

    j = cell.select("feature", "bin", label, "o", over("feature", "bin").alias("r"), over("feature", label).alias("c"),
                    over("feature").alias("t"))
    o, e = F.col("o"), F.col("r") * F.col("c") / F.col("t")
    return j.groupBy("feature").agg(
        (F.sum(o * o / e) - F.first("t")).alias("statistic"),
        ((F.size(F.collect_set("bin")) - 1) * (F.size(F.collect_set(label)) - 1)).cast("bigint").alias("dof"))


def rank_features(df: DataFrame, cols: Sequence[str], label: str = "label", buckets: int = 10) -> DataFrame:
    """``(feature, statistic, dof, strength)``, most dependent on the label
    first, ties in column order.  ``strength`` is the normal score of the
    chi-square statistic at its degrees of freedom (Wilson and Hilferty), which
    orders features like their p-values do and does not underflow; a constant
    feature has none and comes last."""
    k = F.col("dof").cast("double")
    score = (F.cbrt(F.greatest(F.col("statistic"), F.lit(0.0)) / k) - (1 - 2 / (9 * k))) / F.sqrt(2 / (9 * k))
    place = F.array_position(F.array(*[F.lit(c) for c in cols]), F.col("feature"))
    return chi2_table(df, cols, label, buckets).withColumn("strength", F.when(F.col("dof") > 0, score)) \
        .orderBy(F.col("strength").desc_nulls_last(), place)


def select_features(df: DataFrame, cols: Sequence[str], alpha: float, label: str = "label", buckets: int = 10,
                    out_col: str = "fvec"):
    """Chi-square selection of the top ``int(alpha * d)`` features.  Returns
    ``(fitted stage, selected names in column order)``."""
    from shoppulse.operators.selection import ChiSquareSelection
    model = ChiSquareSelection(inputCols=list(cols), outputCol=out_col, labelCol=label, alpha=float(alpha), buckets=buckets).fit(df)
    return model, model.getSelected()
