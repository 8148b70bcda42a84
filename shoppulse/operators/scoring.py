"""Scores: weighted sums, min-max scaling, thresholds, bands, histograms,
ensembles and blends.  Global statistics (min, max, totals) are one-row
aggregates joined back with a broadcast (one row by construction)."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoppulse.functions.numeric import blend, min_max_expr, round_class, threshold_label


def weighted_score(df: DataFrame, weights: dict[str, float], out_col: str = "score") -> DataFrame:
    """Row total of weight * feature over the weighted features."""
    terms = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) * F.lit(float(w))
             for c, w in weights.items() if w != 0]
    total = sum(terms[1:], terms[0]) if terms else F.lit(0.0)
    return df.withColumn(out_col, total)


def min_max(df: DataFrame, col: str, out_col: str | None = None) -> DataFrame:
    """Scale ``col`` to [0, 1] over the whole table; a constant column -> 0."""
    out_col = out_col or col
    mm = df.agg(F.min(col).cast("double").alias("_lo"), F.max(col).cast("double").alias("_hi"))
    return (df.crossJoin(F.broadcast(mm))
              .withColumn(out_col, min_max_expr(col, F.col("_lo"), F.col("_hi")))
              .drop("_lo", "_hi"))


def label_by_threshold(df: DataFrame, col: str, alpha: float = 0.5, out_col: str = "label_int") -> DataFrame:
    return df.withColumn(out_col, threshold_label(col, alpha))


def select_above(scored: DataFrame, col: str = "pro", thr: float = 0.59) -> DataFrame:
    """Rows scoring strictly above the threshold."""
    return scored.filter(F.col(col) > F.lit(thr))


def predicted_positive(scored: DataFrame, pred: str = "prediction", cls: int = 1) -> DataFrame:
    return scored.filter(F.col(pred) == F.lit(cls))


# Score band edges among predicted positives.
BAND_EDGES = {"high": 0.8, "medium": 0.7, "low": 0.5}


def band_column(col: str, edges: dict[str, float] = BAND_EDGES):
    s = F.col(col)
    return (F.when(s >= edges["high"], F.lit("high"))
             .when(s >= edges["medium"], F.lit("medium"))
             .when(s >= edges["low"], F.lit("low")))


def score_bands(scored: DataFrame, score: str = "pro", pred: str = "prediction",
                edges: dict[str, float] = BAND_EDGES) -> DataFrame:
    """Counts of predicted positives per band: high >= .8, medium [.7, .8),
    low [.5, .7)."""
    pos = predicted_positive(scored, pred).withColumn("band", band_column(score, edges))
    return pos.filter(F.col("band").isNotNull()).groupBy("band").agg(F.count(F.lit(1)).alias("n"))


def histogram(df: DataFrame, col: str, bins: int = 100) -> DataFrame:
    """Equal-width histogram between min and max: ``(bin, lo, hi, n,
    density)``; the maximum falls in the last bin; density = n / (N*width)."""
    st = df.agg(F.min(col).cast("double").alias("_lo"), F.max(col).cast("double").alias("_hi"),
                F.count(col).alias("_N"))
    x = F.col(col).cast("double")
    width = (F.col("_hi") - F.col("_lo")) / F.lit(bins)
    b = F.when(F.col("_hi") > F.col("_lo"),
               F.least(F.floor((x - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins) + 1, F.lit(bins))
               ).otherwise(F.lit(1)).cast("int")
    h = (df.filter(F.col(col).isNotNull()).crossJoin(F.broadcast(st)).withColumn("bin", b)
           .groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.first("_lo").alias("_lo"),
                               F.first("_hi").alias("_hi"), F.first("_N").alias("_N")))
    return h.select("bin",
                    (F.col("_lo") + (F.col("bin") - 1) * width).alias("lo"),
                    (F.col("_lo") + F.col("bin") * width).alias("hi"),
                    "n",
                    F.when(width > 0, F.col("n") / (F.col("_N") * width)).alias("density"))


def attr_share(df: DataFrame, attr: str, value) -> DataFrame:
    """Share of rows whose ``attr`` equals ``value`` (one-row result)."""
    return df.agg(F.avg((F.col(attr) == F.lit(value)).cast("double")).alias("share"))


def normalise_weights(weights: Sequence[float], n_models: int) -> list[float]:
    if len(weights) != n_models:
        raise ValueError(f"{len(weights)} weights for {n_models} models")
    total = float(sum(weights))
    if total == 0:
        raise ValueError("weights sum to 0")
    return [float(w) / total for w in weights]


def ensemble(scored: DataFrame, prob_cols: Sequence[str], weights: Sequence[float] | None = None,
             out_col: str = "ensemble", rescale: bool = False) -> DataFrame:
    """Weighted blend of per-model P(1) columns; weights (given, or e.g. the
    models' AUCs) normalised to sum 1, all models used.  ``rescale`` min-max
    scales the blend afterwards."""
    w = normalise_weights(weights if weights is not None else [1.0] * len(prob_cols), len(prob_cols))
    expr = sum((F.lit(wi) * F.col(c) for wi, c in zip(w[1:], prob_cols[1:])), F.lit(w[0]) * F.col(prob_cols[0]))
    out = scored.withColumn(out_col, expr)
    return min_max(out, out_col) if rescale else out


def blend_and_pick(scored: DataFrame, a: str, b: str, w: float = 0.99, cls: int = 0,
                   out_col: str = "blend") -> DataFrame:
    """Blend two scores, round half-to-even to a class, keep rows of ``cls``."""
    out = scored.withColumn(out_col, blend(a, b, w)).withColumn("cls", round_class(out_col))
    return out.filter(F.col("cls") == cls)


def remove_mislabelled(scored: DataFrame, p: str = "p_mean", label: str = "label",
                       lo: float = 0.35, hi: float = 0.65) -> DataFrame:
    """Drop rows whose mean learner probability contradicts the label:
    (p < lo and label = 1) or (p > hi and label = 0), both strict."""
    bad = ((F.col(p) < lo) & (F.col(label) == 1)) | ((F.col(p) > hi) & (F.col(label) == 0))
    return scored.filter(~bad)


def mislabel_ratio(scored: DataFrame, p: str = "p_mean", label: str = "label",
                   lo: float = 0.35, hi: float = 0.65) -> DataFrame:
    """``(before, after, ratio)`` with ratio = (before - after) / before."""
    bad = ((F.col(p) < lo) & (F.col(label) == 1)) | ((F.col(p) > hi) & (F.col(label) == 0))
    r = scored.agg(F.count(F.lit(1)).alias("before"), F.count_if(~bad).alias("after"))
    return r.withColumn("ratio", F.try_divide(F.col("before") - F.col("after"), F.col("before").cast("double")))
