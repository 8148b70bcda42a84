"""Property checks for trained models, out-of-fold scores and topic models
(no exact oracle: assert invariants, not values)."""

import math

from pyspark.sql import functions as F

from conftest import SF_SMALL
from shoppulse.plans.catalog import load_all

REG = load_all()


def _q(spark, name):
    return REG[name][0](spark, SF_SMALL)


def test_base_learners_probabilities(spark):
    for name in ("lr_scores", "dt_scores", "gbt_scores", "nb_scores"):
        df = _q(spark, name)
        r = df.agg(F.min("p").alias("lo"), F.max("p").alias("hi"), F.count("*").alias("n")).first()
        assert r.n > 0 and 0.0 <= r.lo <= r.hi <= 1.0, name
        assert set(df.columns) == {"user_pin", "label", "p", "p_pred"}


def test_oof_every_row_once(spark):
    from shoppulse.plans import fixtures as FX
    oof = _q(spark, "oof_scores")
    n = FX.labelled_docs(spark, SF_SMALL).count()
    assert oof.count() == n
    assert oof.select("user_pin").distinct().count() == n
    assert oof.filter((F.col("oof") < 0) | (F.col("oof") > 1)).count() == 0


def test_same_seed_same_model(spark):
    a = {r.user_pin: r.p for r in _q(spark, "gbt_scores").collect()}
    b = {r.user_pin: r.p for r in _q(spark, "gbt_scores").collect()}
    assert a == b


def test_train_all_auc_and_ensemble(spark):
    aucs = _q(spark, "train_all_auc").collect()
    assert {r.model for r in aucs} == {"lr", "dt", "nb", "mlp"}
    assert all(r.auc is None or 0.0 <= r.auc <= 1.0 for r in aucs)


def test_topic_share_sums_to_one(spark):
    rows = _q(spark, "topic_share").collect()
    assert len(rows) == 3
    assert math.isclose(sum(r.share for r in rows), 1.0, rel_tol=1e-9)
    assert all(r.label.startswith(f"topic:{r.topic}(") for r in rows)


def test_topic_terms_shape(spark):
    t = _q(spark, "topic_terms")
    per = {r.topic: r["count"] for r in t.groupBy("topic").count().collect()}
    assert set(per) == {1, 2, 3}


def test_rules_properties(spark):
    rules = _q(spark, "fpgrowth_rules").collect()
    assert rules and all(r.confidence >= 0.005 for r in rules)
    assert all(r.support >= 0.003 - 1e-9 for r in rules)


def test_topics_read_every_document_in_each_iteration(spark):
    from pyspark.ml.linalg import Vectors
    from shoppulse.operators import topics
    vectors = spark.createDataFrame([(k, Vectors.dense([1.0 + k % 2, 1.0])) for k in range(20)], ["doc", "tf"])
    assert topics.fit_topics(vectors, 2, max_iter=2, optimizer="online").getSubsamplingRate() == 1.0
    assert topics.fit_topics(vectors, 2, max_iter=2).isDistributed()


def test_learners_read_written_features(spark, tmpdir_path, monkeypatch):
    from shoppulse.plans import q_models as QM
    docs = [(d, f"some words | and {d}\nlines" * (d % 4), 20 * (d % 4)) for d in range(60)] + [(7, None, None), (None, "x", 1)]
    spark.createDataFrame(docs, "doc_id long, text string, n_chars long").coalesce(1).write.parquet(f"{tmpdir_path}/documents.parquet")
    spark.createDataFrame([(d, d % 2) for d in range(0, 60, 2)] + [(7, 1), (None, 0)], "doc_id long, quality int") \
        .write.parquet(f"{tmpdir_path}/labels.parquet")
    want = sorted(map(str, QM.FX.labelled_docs(spark, tmpdir_path).collect()))
    for rows, least in ((10_000, 1), (8, 4)):
        monkeypatch.setattr(QM, "ROWS", rows)
        df = QM._labelled(spark, tmpdir_path)
        assert sorted(map(str, df.collect())) == want and len(want) == 32
        # no pass of a learner goes back to the texts, and many rows are on more than one core
        assert all("/written-" in f for f in df.inputFiles())
        assert len({r.p for r in df.selectExpr("spark_partition_id() AS p").collect()}) >= min(least, 2)
    train, valid = QM._split(spark, tmpdir_path)
    assert all("/written-" in f for d in (train, valid) for f in d.inputFiles())
