"""Evaluation: confusion summary, accuracy, classification report, confusion
matrix, ROC AUC.  Each report is one aggregation pass over the scored table
(the reference fires one count job per number)."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoppulse.operators.layout import prefix_sums


def confusion_summary(df: DataFrame, label: str = "label", pred: str = "prediction") -> DataFrame:
    """One row: total, correct, accuracy, pos, neg, tp, tn, fn, fp,
    recall_pos, recall_neg (null on an empty class)."""
    y, p = F.col(label), F.col(pred)
    r = df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(y == p).alias("correct"),
        F.count_if(y == 1).alias("pos"),
        F.count_if(y == 0).alias("neg"),
        F.count_if((y == 1) & (p == 1)).alias("tp"),
        F.count_if((y == 0) & (p == 0)).alias("tn"),
        F.count_if((y == 1) & (p == 0)).alias("fn"),
        F.count_if((y == 0) & (p == 1)).alias("fp"))
    return r.select("total", "correct",
                    F.try_divide(F.col("correct").cast("double"), F.col("total")).alias("accuracy"),
                    "pos", "neg", "tp", "tn", "fn", "fp",
                    F.try_divide(F.col("tp").cast("double"), F.col("pos")).alias("recall_pos"),
                    F.try_divide(F.col("tn").cast("double"), F.col("neg")).alias("recall_neg"))


def accuracy(df: DataFrame, label: str = "label", pred: str = "prediction", out: str = "accuracy") -> DataFrame:
    return df.agg(F.avg((F.col(label) == F.col(pred)).cast("double")).alias(out))


def accuracy_gain(df: DataFrame, pred_a: str, pred_b: str, label: str = "label") -> DataFrame:
    """Accuracy of two predictions on the same rows and b - a, one pass."""
    y = F.col(label)
    r = df.agg(F.avg((y == F.col(pred_a)).cast("double")).alias("acc_a"),
               F.avg((y == F.col(pred_b)).cast("double")).alias("acc_b"))
    return r.withColumn("gain", F.col("acc_b") - F.col("acc_a"))


def _safe(num, den):
    return F.coalesce(F.try_divide(num.cast("double"), den), F.lit(0.0))


def classification_report(df: DataFrame, label: str = "label", pred: str = "prediction") -> DataFrame:
    """Per class: precision, recall, f1, support; plus ``accuracy``,
    ``macro avg`` and ``weighted avg`` rows (0 on a zero denominator).
    Truth first, then prediction.  Classes are the label/prediction values;
    the per-class table has one row per class."""
    y, p = F.col(label).cast("string"), F.col(pred).cast("string")
    cells = df.select(y.alias("t"), p.alias("q")).groupBy("t", "q").agg(F.count(F.lit(1)).alias("c"))
    # each cell counts once for its true class (support, tp) and once for its
    # predicted class: two rows per cell and one groupBy, no join
    c, hit = F.col("c"), F.col("t") == F.col("q")
    per = cells.select(F.explode(F.array(
        F.struct(F.col("t").alias("cls"), c.alias("support"), F.when(hit, c).otherwise(0).alias("tp"),
                 F.lit(0).cast("bigint").alias("predicted")),
        F.struct(F.col("q").alias("cls"), F.lit(0).cast("bigint").alias("support"),
                 F.lit(0).cast("bigint").alias("tp"), c.alias("predicted")))).alias("e")).select("e.*") \
        .groupBy("cls").agg(F.sum("support").alias("support"), F.sum("tp").alias("tp"),
                            F.sum("predicted").alias("predicted"))
    per = per.select("cls", "support", "tp",
                     _safe(F.col("tp"), F.col("predicted")).alias("precision"),
                     _safe(F.col("tp"), F.col("support")).alias("recall"))
    per = per.withColumn("f1", _safe(2 * F.col("precision") * F.col("recall"),
                                     F.col("precision") + F.col("recall")))
    rows = per.select("cls", "precision", "recall", "f1", F.col("support").cast("bigint").alias("support"))
    tot = per.agg(F.sum("support").alias("n"), F.sum("tp").alias("tp"), F.count(F.lit(1)).alias("k"),
                  F.sum("precision").alias("sp"), F.sum("recall").alias("sr"), F.sum("f1").alias("sf"),
                  F.sum(F.col("precision") * F.col("support")).alias("wp"),
                  F.sum(F.col("recall") * F.col("support")).alias("wr"),
                  F.sum(F.col("f1") * F.col("support")).alias("wf"))
    acc = _safe(F.col("tp"), F.col("n"))
    summary = tot.select(F.explode(F.array(
        F.struct(F.lit("accuracy").alias("cls"), acc.alias("precision"), acc.alias("recall"),
                 acc.alias("f1"), F.col("n").alias("support")),
        F.struct(F.lit("macro avg").alias("cls"), (F.col("sp") / F.col("k")).alias("precision"),
                 (F.col("sr") / F.col("k")).alias("recall"), (F.col("sf") / F.col("k")).alias("f1"),
                 F.col("n").alias("support")),
        F.struct(F.lit("weighted avg").alias("cls"), _safe(F.col("wp"), F.col("n")).alias("precision"),
                 _safe(F.col("wr"), F.col("n")).alias("recall"), _safe(F.col("wf"), F.col("n")).alias("f1"),
                 F.col("n").alias("support")))).alias("r")).select("r.*")
    return rows.unionByName(summary.withColumn("support", F.col("support").cast("bigint")))


def confusion_matrix(df: DataFrame, label: str = "label", pred: str = "prediction",
                     classes: Sequence = (0, 1)) -> DataFrame:
    """``(label, prediction, n)`` for every pair of the given classes (zeros
    included; the class grid is a literal of len(classes)^2 rows)."""
    grid = df.sparkSession.createDataFrame(
        [(int(a), int(b)) for a in classes for b in classes], f"{label} int, {pred} int")
    cnt = df.groupBy(F.col(label).cast("int").alias(label), F.col(pred).cast("int").alias(pred)) \
            .agg(F.count(F.lit(1)).alias("n"))
    return grid.join(cnt, [label, pred], "left").select(label, pred, F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def auc_roc(df: DataFrame, score: str, label: str = "label", by: Sequence[str] = ()) -> DataFrame:
    """Exact area under the ROC curve (mid-rank / Mann-Whitney form, ties
    count one half), as a one-row DataFrame, or one row per group ``by``.

    Rows are first aggregated per distinct score (a score shared by a third
    of the table becomes one row), then the count of negatives below each
    score comes from a two-level histogram -- no global sort into a single
    task, and no job while the plan is built."""
    g = df.groupBy(*by, F.col(score).cast("double").alias("_s")).agg(
        F.count_if(F.col(label) == 1).alias("_pos"), F.count_if(F.col(label) != 1).alias("_neg"))
    ps = prefix_sums(g, "_s", ["_neg"], inclusive=False, by=by)
    return ps.groupBy(*by).agg(F.sum("_pos").alias("P"), F.sum("_neg").alias("N"),
                               F.sum(F.col("_pos") * (F.col("_neg_before") + 0.5 * F.col("_neg"))).alias("_u")) \
             .select(*by, F.try_divide(F.col("_u"), F.col("P").cast("double") * F.col("N").cast("double")).alias("auc"))


def auc_evaluator(df: DataFrame, score: str, label: str = "label", metric: str = "areaUnderROC") -> float:
    """Spark ML's evaluator (numBins=0: exact) for ROC or PR area."""
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    ev = BinaryClassificationEvaluator(rawPredictionCol=score, labelCol=label, metricName=metric, numBins=0)
    return ev.evaluate(df.select(F.col(score).cast("double").alias(score), F.col(label).cast("double").alias(label)))


def auc_pr(df: DataFrame, score: str, label: str = "label") -> DataFrame:
    """Exact area under the precision-recall curve, as Spark ML computes it
    without binning: one curve point per distinct score (descending), a first
    point (recall 0, precision of the top point), trapezoids in between.  One
    row ``auc_pr``.

    The previous point of each score is recovered from its own row (the
    cumulative counts minus its own counts), so after the per-score
    aggregation and range-partitioned prefix sums the area is a single
    ``sum`` -- no ordered pass through one task."""
    g = df.groupBy((-F.col(score).cast("double")).alias("_s")).agg(
        F.count_if(F.col(label) == 1).alias("_pos"), F.count_if(F.col(label) != 1).alias("_neg"))
    ps = prefix_sums(g, "_s", ["_pos", "_neg"], inclusive=True, suffix="_cum")
    tot = g.agg(F.sum("_pos").cast("double").alias("_P"))  # one row
    tp, fp = F.col("_pos_cum").cast("double"), F.col("_neg_cum").cast("double")
    tp0, fp0 = tp - F.col("_pos"), fp - F.col("_neg")
    prec = tp / (tp + fp)
    prec0 = F.when(tp0 + fp0 > 0, tp0 / (tp0 + fp0)).otherwise(prec)
    rec, rec0 = tp / F.col("_P"), tp0 / F.col("_P")
    area = (rec - rec0) * (prec + prec0) / 2
    return (ps.crossJoin(F.broadcast(tot)).filter(F.col("_P") > 0)
              .agg(F.sum(area).alias("auc_pr")))
