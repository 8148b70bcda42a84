"""Sampling, labelling, class balancing, splits and folds.

``DataFrame.sample``/``randomSplit`` pick rows by partition-local random
streams, so the same seed selects different rows after a repartition or an
executor retry on a different layout.  Here membership is a pure function of
the row key (md5 of key and salt), so a lost task recomputes exactly the same
rows and DuckDB can reproduce the selection.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoppulse.functions.hashing import TWO_32, hash_bucket


def hash_sample(df: DataFrame, key: str, fraction: float, seed: int | str = 0) -> DataFrame:
    """Rows whose key hash falls below ``fraction`` (without replacement);
    a plain filter, pushed next to the scan."""
    if fraction >= 1.0:
        return df
    bound = int(TWO_32 * fraction)
    return df.filter(hash_bucket(key, f"s{seed}") < F.lit(bound))


def label_cohort(df: DataFrame, label: int, col: str = "label") -> DataFrame:
    return df.withColumn(col, F.lit(label))


def cohort_counts(df: DataFrame, label: str = "label") -> DataFrame:
    """Rows per class in one aggregation."""
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def balance_fractions(n_pos: int, n_neg: int, policy: str = "upto2") -> tuple[float, float]:
    """Sampling fractions ``(pos, neg)``.

    ``upto2``: n <= p -> positives at n/p; n >= 2p -> negatives at 2p/n
    (1:2); otherwise negatives at p/n.  ``equal``: the larger class down to
    the smaller one (1:1)."""
    p, n = n_pos, n_neg
    if p == 0 or n == 0:
        return 1.0, 1.0
    if policy == "equal":
        return (n / p, 1.0) if p > n else (1.0, p / n)
    if policy != "upto2":
        raise ValueError(policy)
    if n <= p:
        return n / p, 1.0
    if n >= 2 * p:
        return 1.0, 2 * p / n
    return 1.0, p / n


def balance(pos: DataFrame, neg: DataFrame, key: str, policy: str = "upto2", seed: int = 0,
            label: str = "label") -> DataFrame:
    """Down-sample one class by a stable hash sample, then label (1 / 0) and
    union.  The two counts are the only values brought to the driver."""
    fp, fn = balance_fractions(pos.count(), neg.count(), policy)
    return (hash_sample(pos, key, fp, f"bal{seed}").withColumn(label, F.lit(1))
            .unionByName(hash_sample(neg, key, fn, f"bal{seed}").withColumn(label, F.lit(0))))


def split_column(key: str, weights: Sequence[float], seed: int | str = 0, col: str = "split") -> F.Column:
    """Split index 0..k-1 by cumulative normalised weights over the key hash."""
    total = float(sum(weights))
    bounds, acc = [], 0.0
    for w in weights[:-1]:
        acc += w / total
        bounds.append(int(TWO_32 * acc))
    h = hash_bucket(key, f"t{seed}")
    expr = F.lit(len(weights) - 1)
    for i in reversed(range(len(bounds))):
        expr = F.when(h < F.lit(bounds[i]), F.lit(i)).otherwise(expr)
    return expr.alias(col)


def split(df: DataFrame, key: str, weights: Sequence[float] = (4, 1), seed: int | str = 0) -> list[DataFrame]:
    """Stable train/test (or k-way) split on the key hash."""
    tagged = df.withColumn("_split", split_column(key, weights, seed, "_split"))
    return [tagged.filter(F.col("_split") == i).drop("_split") for i in range(len(weights))]


def fold_column(key: str, k: int = 5, seed: int | str = 0, col: str = "fold") -> F.Column:
    """Fold id in [0, k) from the key hash (salt differs from split/sample)."""
    return (hash_bucket(key, f"f{seed}") % F.lit(k)).cast("int").alias(col)
