"""Fitted selection stage, early stopping and the learners around them."""

import random

import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from shoppulse.operators import features as FE
from shoppulse.operators import metrics as ME
from shoppulse.operators import models as MO
from shoppulse.operators import schema as SC

COLS = ["noise1", "strong", "flat", "weak", "noise2"]


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(4)
    rows = []
    for k in range(600):
        y = k % 2
        rows.append((f"u{k}", y, rng.random(), y + rng.random(), 1.0, y * .4 + rng.random(), rng.random()))
    return spark.createDataFrame(rows, "user_pin string, label int, " + ", ".join(f"{c} double" for c in COLS)).cache()


def test_the_checked_statistic_selects(data):
    table = {r.feature: r for r in FE.rank_features(data, COLS).collect()}
    plain = {r.feature: r for r in FE.chi2_table(data, COLS).collect()}
    assert all(table[c].statistic == plain[c].statistic for c in COLS)
    assert table["flat"].dof == 0 and table["flat"].strength is None
    best = sorted(COLS, key=lambda c: -(table[c].strength if table[c].strength is not None else -1e9))
    assert best[:2] == ["strong", "weak"] and best[-1] == "flat"
    for alpha, n in ((.5, 2), (.9, 4), (.0, 1)):
        model, names = FE.select_features(data, COLS, alpha)
        assert names == [c for c in COLS if c in best[:n]]
        assert model.transform(data).first().fvec.size == n


def test_chi_square_equals_spark_ml(spark, data):
    from pyspark.ml.stat import ChiSquareTest
    cols = ["strong", "weak", "noise1"]
    binned = data.select("label", *[F.least(F.floor((F.col(c) - lo) / (hi - lo) * 10), F.lit(9)).cast("double").alias(c)
                                    for c, lo, hi in ((c, *data.agg(F.min(c), F.max(c)).first()) for c in cols)])
    want = ChiSquareTest.test(FE.assemble(binned, cols), "fvec", "label").first()
    got = {r.feature: r for r in FE.chi2_table(data, cols).collect()}
    for k, c in enumerate(cols):
        assert got[c].statistic == pytest.approx(want.statistics[k]) and got[c].dof == want.degreesOfFreedom[k]


@pytest.fixture(scope="module")
def trained(data):
    train, valid = data.filter("cast(substr(user_pin, 2) as int) < 450"), data.filter("cast(substr(user_pin, 2) as int) >= 450")
    return MO.train_all(train, valid, COLS, alpha=.5), valid


def test_learners_see_the_selected_columns(trained):
    (models, aucs), valid = trained
    got = {r.model: r.auc for r in aucs.collect()}
    assert set(got) == set(models) == {"lr", "dt", "nb", "mlp"} and min(got["lr"], got["dt"]) > .9
    assert list(models["mlp"].stages[-1].bestModel.getLayers())[0] == 2  # int(.5 * 5)
    assert models["lr"].stages[-1].bestModel.coefficients.size == 2
    scored = MO.score_all(models, valid, COLS, keep=("user_pin", "label"))
    for name, area in got.items():
        assert area == pytest.approx(ME.auc_roc(scored, f"p_{name}", "label").first().auc, rel=1e-12)


def test_a_pipeline_read_back_gives_equal_scores(trained, tmpdir_path):
    (models, _), valid = trained
    for name, m in models.items():
        m.write().save(f"{tmpdir_path}/{name}")
    back = {name: PipelineModel.load(f"{tmpdir_path}/{name}") for name in models}
    stage = MO.selection_of(back)
    assert stage.getInputCols() == COLS and stage.getSelected() == MO.selection_of(models).getSelected()
    a, b = (sorted(MO.score_all(m, valid, COLS).collect()) for m in (models, back))
    assert a == b and len(a) == 150


def test_target_columns_are_taken_in_training_order(trained):
    (models, _), valid = trained
    named = MO.ensemble_target(models, valid.select("user_pin", *COLS), [1, 1, 1, 1])
    other = valid.select(*[F.col(c).alias(f"t{k}") for k, c in enumerate(COLS)], "user_pin")
    assert sorted(MO.ensemble_target(models, other, [1, 1, 1, 1]).collect()) == sorted(named.collect())
    with pytest.raises(ValueError):
        MO.prepare_target(MO.selection_of(models), valid.select("user_pin", *COLS[1:]))


def test_audio_grids():
    specs = {s.name: s for s in MO.search_specs(20, "full", width=18, audio=True)}
    pick = lambda name, param: sorted({tuple(v) if isinstance(v, list) else v for m in specs[name].grid
                                       for p, v in m.items() if p.name == param})
    assert pick("lr", "regParam") == [.01, .05, .1, .15, .3] and pick("dt", "maxDepth") == [1, 14]
    assert pick("mlp", "layers") == [(18, 80, 80, 80, 2)]
    plain = {s.name: s for s in MO.search_specs(20, "full", width=18)}
    assert [m[p][0] for m in plain["mlp"].grid for p in m] == [18, 18, 18]


def test_boosting_stops_before_the_last_round(spark, data):
    noisy = data.withColumn("label", F.when(F.crc32(F.col("user_pin").cast("binary")) % 3 == 0, 1 - F.col("label")).otherwise(F.col("label")))
    oof, target, rounds = MO.oof_scores(noisy, data.drop("label"), ["strong", "weak"], k=2, max_iter=40)
    trees = {r.fold: r.n_trees for r in rounds.collect()}
    assert set(trees) == {0, 1} and all(1 <= n < 40 for n in trees.values())
    assert oof.count() == target.count() == 600
    model = MO.fit_gbt(noisy.withColumn("held", F.col("user_pin") < "u3"), ["strong"], depth=10, validation_col="held")
    assert model.stages[-1].getOrDefault("maxDepth") == 10


def test_mislabelled_rows_go(data):
    flipped = ["u3", "u4", "u77", "u200"]
    wrong = data.withColumn("label", F.when(F.col("user_pin").isin(flipped), 1 - F.col("label")).otherwise(F.col("label")))
    kept, scored = MO.remove_mislabelled_models(wrong, ["strong", "weak"])
    left = {r.user_pin for r in kept.collect()}
    assert not left & set(flipped) and len(left) > 560 and scored.count() == 600


def test_zero_variance_columns_leave_every_table(data):
    (a, b), zero = SC.drop_zero_variance([data.limit(5), data], COLS)
    assert zero == ["flat"] and "flat" not in a.columns + b.columns


def test_weighted_columns_add_up_to_the_weighted_score(data):
    from shoppulse.operators import correlation as C
    from shoppulse.operators import scoring as S
    weights = {"strong": 2.0, "weak": -0.5, "flat": 0.0, "absent": 3.0}
    wide = C.apply_weights(data, weights, keep=["user_pin"])
    assert wide.columns == ["user_pin", "strong", "weak"]
    total = {r.user_pin: r.strong + r.weak for r in wide.collect()}
    got = {r.user_pin: r.score for r in S.weighted_score(data, {k: w for k, w in weights.items() if k != "absent"}).collect()}
    assert got == pytest.approx(total)
