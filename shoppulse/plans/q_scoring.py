"""Evaluation, scoring and ensemble queries over deterministic rule scores
(labelled documents) and min-max scaled account balances (customers)."""

from __future__ import annotations

from pyspark.sql import functions as F

from shoppulse.functions.numeric import round_class
from shoppulse.operators import features as FE
from shoppulse.operators import metrics as M
from shoppulse.operators import scoring as SC
from shoppulse.plans import fixtures as FX
from shoppulse.plans.catalog import query

SCORED = FX.SQL["scored"]


def _scored(spark, sf_dir):
    """Labelled documents with rule scores and their rounded classes."""
    df = FX.rule_scores(FX.labelled_docs(spark, sf_dir, parallel=True))
    return df.withColumns({"prediction": round_class("s2"), "pred_s1": round_class("s1")})


_PRED = f"(SELECT *, CAST(round_even(s2, 0) AS INTEGER) AS prediction, CAST(round_even(s1, 0) AS INTEGER) AS pred_s1 FROM {SCORED})"


@query("confusion_summary", f"""SELECT count(*) AS total, count(*) FILTER (WHERE label = prediction) AS correct,
  round(count(*) FILTER (WHERE label = prediction) / count(*), 6) AS accuracy,
  count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg,
  count(*) FILTER (WHERE label = 1 AND prediction = 1) AS tp, count(*) FILTER (WHERE label = 0 AND prediction = 0) AS tn,
  count(*) FILTER (WHERE label = 1 AND prediction = 0) AS fn, count(*) FILTER (WHERE label = 0 AND prediction = 1) AS fp,
  round(count(*) FILTER (WHERE label = 1 AND prediction = 1) / count(*) FILTER (WHERE label = 1), 6) AS recall_pos,
  round(count(*) FILTER (WHERE label = 0 AND prediction = 0) / count(*) FILTER (WHERE label = 0), 6) AS recall_neg
FROM {_PRED}""")
def confusion_summary(spark, sf_dir):
    r = M.confusion_summary(_scored(spark, sf_dir), "label", "prediction")
    return r.withColumns({c: F.round(c, 6) for c in ("accuracy", "recall_pos", "recall_neg")})


_REPORT_SQL = f"""WITH p AS {_PRED},
  cells AS (SELECT CAST(label AS VARCHAR) AS t, CAST(prediction AS VARCHAR) AS q, count(*) AS c FROM p GROUP BY ALL),
  bt AS (SELECT t AS cls, sum(c) AS support, sum(CASE WHEN t = q THEN c ELSE 0 END) AS tp FROM cells GROUP BY t),
  bq AS (SELECT q AS cls, sum(c) AS predicted FROM cells GROUP BY q),
  per AS (SELECT coalesce(bt.cls, bq.cls) AS cls, coalesce(support, 0) AS support, coalesce(tp, 0) AS tp,
            coalesce(predicted, 0) AS predicted FROM bt FULL JOIN bq ON bt.cls = bq.cls),
  m AS (SELECT cls, support, tp, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0 END AS precision,
          CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall FROM per),
  f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END
          AS f1 FROM m),
  tot AS (SELECT sum(support) AS n, sum(tp) AS tp, count(*) AS k, sum(precision) AS sp, sum(recall) AS sr,
            sum(f1) AS sf, sum(precision * support) AS wp, sum(recall * support) AS wr, sum(f1 * support) AS wf FROM f)
SELECT cls, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
  CAST(support AS BIGINT) AS support FROM f
UNION ALL SELECT 'accuracy', round(tp / n, 6), round(tp / n, 6), round(tp / n, 6), CAST(n AS BIGINT) FROM tot
UNION ALL SELECT 'macro avg', round(sp / k, 6), round(sr / k, 6), round(sf / k, 6), CAST(n AS BIGINT) FROM tot
UNION ALL SELECT 'weighted avg', round(wp / n, 6), round(wr / n, 6), round(wf / n, 6), CAST(n AS BIGINT) FROM tot"""


@query("classification_report", _REPORT_SQL)
def classification_report(spark, sf_dir):
    r = M.classification_report(_scored(spark, sf_dir), "label", "prediction")
    return r.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@query("confusion_matrix", f"""WITH g AS (SELECT * FROM (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) v(label, prediction)),
  c AS (SELECT label, prediction, count(*) AS n FROM {_PRED} GROUP BY ALL)
SELECT g.label, g.prediction, CAST(coalesce(c.n, 0) AS BIGINT) AS n FROM g LEFT JOIN c USING (label, prediction)""")
def confusion_matrix(spark, sf_dir):
    return M.confusion_matrix(_scored(spark, sf_dir), "label", "prediction")


@query("accuracy_gain", f"""SELECT round(avg(CASE WHEN label = pred_s1 THEN 1.0 ELSE 0.0 END), 6) AS acc_a,
  round(avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END), 6) AS acc_b,
  round(avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END) - avg(CASE WHEN label = pred_s1 THEN 1.0 ELSE 0.0 END), 6)
    AS gain FROM {_PRED}""")
def accuracy_gain(spark, sf_dir):
    r = M.accuracy_gain(_scored(spark, sf_dir), "pred_s1", "prediction", "label")
    return r.select(*[F.round(c, 6).alias(c) for c in ("acc_a", "acc_b", "gain")])


def _auc_sql(score: str, label: str, src: str) -> str:
    return f"""WITH r AS (SELECT {label} AS y, rank() OVER (ORDER BY {score}) +
      (count(*) OVER (PARTITION BY {score}) - 1) / 2.0 AS mr FROM {src}),
  c AS (SELECT count(*) FILTER (WHERE y = 1) AS P, count(*) FILTER (WHERE y <> 1) AS N,
          sum(mr) FILTER (WHERE y = 1) AS rs FROM r)
SELECT round((rs - P * (P + 1) / 2.0) / (P * N), 6) AS auc FROM c"""


@query("auc_roc", _auc_sql("s2", "label", SCORED))
def auc_roc(spark, sf_dir):
    r = M.auc_roc(FX.rule_scores(FX.labelled_docs(spark, sf_dir, parallel=True)), "s2", "label")
    return r.select(F.round("auc", 6).alias("auc"))


@query("auc_pr", f"""WITH g AS (SELECT -s2 AS s, count(*) FILTER (WHERE label = 1) AS pos,
      count(*) FILTER (WHERE label <> 1) AS neg FROM {SCORED} GROUP BY 1),
  c AS (SELECT *, sum(pos) OVER (ORDER BY s) AS tp, sum(neg) OVER (ORDER BY s) AS fp,
      sum(pos) OVER () AS P FROM g),
  pts AS (SELECT tp / P AS r, (tp - pos) / P AS r0, tp / (tp + fp) AS pr,
      CASE WHEN tp - pos + fp - neg > 0 THEN (tp - pos) / (tp - pos + fp - neg) ELSE tp / (tp + fp) END AS pr0
    FROM c WHERE P > 0)
SELECT round(sum((r - r0) * (pr + pr0) / 2), 6) AS auc_pr FROM pts""")
def auc_pr(spark, sf_dir):
    r = M.auc_pr(FX.rule_scores(FX.labelled_docs(spark, sf_dir, parallel=True)), "s2", "label")
    return r.select(F.round("auc_pr", 6).alias("auc_pr"))


# customers: account balance min-max scaled is the score, class by rounding
def _customers(spark, sf_dir):
    c = FX.table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    s = SC.min_max(c, "c_acctbal", "pro")
    return s.withColumn("prediction", round_class("pro"))


_CUST = """(SELECT c_custkey, c_mktsegment, pro, CAST(round_even(pro, 0) AS INTEGER) AS prediction FROM (
  SELECT c_custkey, c_mktsegment, CASE WHEN hi > lo THEN (c_acctbal - lo) / (hi - lo) ELSE 0.0 END AS pro
  FROM customer, (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer)))"""


@query("score_bands", f"""SELECT band, count(*) AS n FROM (SELECT CASE WHEN pro >= 0.8 THEN 'high'
  WHEN pro >= 0.7 THEN 'medium' WHEN pro >= 0.5 THEN 'low' END AS band FROM {_CUST} WHERE prediction = 1)
WHERE band IS NOT NULL GROUP BY band""")
def score_bands(spark, sf_dir):
    return SC.score_bands(_customers(spark, sf_dir), "pro", "prediction")


@query("score_histogram", """WITH s AS (SELECT c_acctbal AS x FROM customer WHERE c_acctbal IS NOT NULL),
  st AS (SELECT min(x) AS lo, max(x) AS hi, count(*) AS N FROM s),
  b AS (SELECT CAST(CASE WHEN hi > lo THEN least(floor((x - lo) / (hi - lo) * 100) + 1, 100) ELSE 1 END AS INTEGER)
          AS bin, lo, hi, N FROM s, st)
SELECT bin, round(lo + (bin - 1) * (hi - lo) / 100, 6) AS lo, round(lo + bin * (hi - lo) / 100, 6) AS hi,
  count(*) AS n, round(count(*) / (N * ((hi - lo) / 100)), 6) AS density FROM b GROUP BY bin, lo, hi, N""")
def score_histogram(spark, sf_dir):
    c = FX.table(spark, sf_dir, "customer")
    h = SC.histogram(c, "c_acctbal", 100)
    return h.select("bin", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"), "n",
                    F.round("density", 6).alias("density"))


@query("attr_share", f"""SELECT round(avg(CASE WHEN c_mktsegment = 'BUILDING' THEN 1.0 ELSE 0.0 END), 6) AS share
FROM {_CUST} WHERE prediction = 0""")
def attr_share(spark, sf_dir):
    picked = SC.predicted_positive(_customers(spark, sf_dir), "prediction", 0)
    return SC.attr_share(picked, "c_mktsegment", "BUILDING").select(F.round("share", 6).alias("share"))


@query("select_above", f"SELECT user_pin, round(s2, 6) AS pro FROM {SCORED} WHERE s2 > 0.59")
def select_above(spark, sf_dir):
    df = FX.rule_scores(FX.labelled_docs(spark, sf_dir, parallel=True))
    return SC.select_above(df, "s2", 0.59).select("user_pin", F.round("s2", 6).alias("pro"))


# Fixed stand-in model weights (e.g. validation AUCs of three learners).
ENSEMBLE_WEIGHTS = [0.62, 0.91, 0.74]


def _ens_sql(rescale: bool) -> str:
    tot = sum(ENSEMBLE_WEIGHTS)
    w = [x / tot for x in ENSEMBLE_WEIGHTS]
    e = f"{w[0]!r} * s1 + {w[1]!r} * s2 + {w[2]!r} * s3"
    if not rescale:
        return f"SELECT user_pin, label, round({e}, 6) AS ensemble FROM {SCORED}"
    return (f"WITH e AS (SELECT user_pin, label, {e} AS ensemble FROM {SCORED}), "
            "mm AS (SELECT min(ensemble) AS lo, max(ensemble) AS hi FROM e) "
            "SELECT user_pin, label, round(CASE WHEN hi > lo THEN (ensemble - lo) / (hi - lo) ELSE 0.0 END, 6) "
            "AS ensemble FROM e, mm")


@query("ensemble_fixed", _ens_sql(False))
def ensemble_fixed(spark, sf_dir):
    df = FX.rule_scores(FX.labelled_docs(spark, sf_dir, parallel=True))
    e = SC.ensemble(df, ["s1", "s2", "s3"], ENSEMBLE_WEIGHTS)
    return e.select("user_pin", "label", F.round("ensemble", 6).alias("ensemble"))


@query("ensemble_rescaled", _ens_sql(True))
def ensemble_rescaled(spark, sf_dir):
    df = FX.rule_scores(FX.labelled_docs(spark, sf_dir, parallel=True))
    e = SC.ensemble(df, ["s1", "s2", "s3"], ENSEMBLE_WEIGHTS, rescale=True)
    return e.select("user_pin", "label", F.round("ensemble", 6).alias("ensemble"))


@query("blend_pick", f"""SELECT user_pin, round(b, 6) AS blend FROM (SELECT user_pin, 0.99 * s2 + {1 - 0.99!r} * s1 AS b
  FROM {SCORED}) WHERE CAST(round_even(b, 0) AS INTEGER) = 0""")
def blend_pick(spark, sf_dir):
    df = FX.rule_scores(FX.labelled_docs(spark, sf_dir, parallel=True))
    out = SC.blend_and_pick(df, "s2", "s1", 0.99, cls=0)
    return out.select("user_pin", F.round("blend", 6).alias("blend"))


_PMEAN = f"(SELECT user_pin, label, (s1 + s2) / 2 AS p_mean FROM {SCORED})"
_BAD = "((p_mean < 0.35 AND label = 1) OR (p_mean > 0.65 AND label = 0))"


@query("remove_mislabelled_rule", f"SELECT user_pin, label, round(p_mean, 6) AS p_mean FROM {_PMEAN} WHERE NOT {_BAD}")
def remove_mislabelled_rule(spark, sf_dir):
    df = FX.rule_scores(FX.labelled_docs(spark, sf_dir, parallel=True)).withColumn("p_mean", (F.col("s1") + F.col("s2")) / 2)
    return SC.remove_mislabelled(df).select("user_pin", "label", F.round("p_mean", 6).alias("p_mean"))


@query("mislabel_ratio", f"""SELECT count(*) AS before, count(*) FILTER (WHERE NOT {_BAD}) AS after,
  round((count(*) - count(*) FILTER (WHERE NOT {_BAD})) / count(*), 6) AS ratio FROM {_PMEAN}""")
def mislabel_ratio(spark, sf_dir):
    df = FX.rule_scores(FX.labelled_docs(spark, sf_dir, parallel=True)).withColumn("p_mean", (F.col("s1") + F.col("s2")) / 2)
    return SC.mislabel_ratio(df).withColumn("ratio", F.round("ratio", 6))


CHI2_SQL = f"""WITH d AS {FX.SQL['labelled']},
  u AS (UNPIVOT d ON {', '.join(FX.FEATURES)} INTO NAME feature VALUE x),
  bd AS (SELECT feature, min(x) AS lo, max(x) AS hi FROM u GROUP BY feature),
  b AS (SELECT u.feature, u.label, CAST(CASE WHEN hi > lo THEN least(floor((x - lo) / (hi - lo) * 10), 9) ELSE 0 END
          AS INTEGER) AS bin FROM u JOIN bd USING (feature)),
  cell AS (SELECT feature, bin, label, count(*) AS o FROM b GROUP BY ALL),
  r AS (SELECT feature, bin, sum(o) AS r FROM cell GROUP BY ALL),
  c AS (SELECT feature, label, sum(o) AS c FROM cell GROUP BY ALL),
  t AS (SELECT feature, sum(o) AS t, count(DISTINCT bin) AS nb, count(DISTINCT label) AS nl FROM cell GROUP BY feature)
SELECT feature, sum(o * o / (r * c / t)) - any_value(t) AS statistic,
  CAST((any_value(nb) - 1) * (any_value(nl) - 1) AS BIGINT) AS dof
FROM cell JOIN r USING (feature, bin) JOIN c USING (feature, label) JOIN t USING (feature) GROUP BY feature"""


@query("chi2_statistic", f"SELECT feature, round(statistic, 6) AS statistic, dof FROM ({CHI2_SQL})")
def chi2_statistic(spark, sf_dir):
    t = FE.chi2_table(FX.labelled_docs(spark, sf_dir, parallel=True), FX.FEATURES, "label", 10)
    return t.select("feature", F.round("statistic", 6).alias("statistic"), "dof")


@query("attached_scores", f"""SELECT u.user_pin, round(s1, 6) AS s1 FROM
  (SELECT user_pin FROM {FX.SQL['labelled']} UNION ALL SELECT user_pin FROM {FX.SQL['target']}) u
LEFT JOIN {SCORED} s ON s.user_pin = u.user_pin""")
def attached_scores(spark, sf_dir):
    """J2: scores joined to all users on their key; users without one get null."""
    from shoppulse.operators.models import attach_scores
    users = FX.labelled_docs(spark, sf_dir).select("user_pin").unionByName(FX.target_docs(spark, sf_dir).select("user_pin"))
    scores = FX.rule_scores(FX.labelled_docs(spark, sf_dir)).select("user_pin", F.round("s1", 6).alias("s1"))
    return attach_scores(users, scores)
