"""Spark ML learners, parameter searches, ensembles and out-of-fold scores.

Every fitted model is applied with ``transform`` so scores keep the row's
``user_pin`` (no positional re-alignment of separately computed columns).
Training sets that feed several searches are persisted around the searches
and released afterwards.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoppulse.functions.numeric import p1
from shoppulse.operators.features import top_feature_count
from shoppulse.operators.sampling import fold_column

FEATURES = "fvec"


def _assembler(cols):
    from pyspark.ml.feature import VectorAssembler
    return VectorAssembler(inputCols=list(cols), outputCol=FEATURES, handleInvalid="keep")


def _auc_eval(label="label"):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    return BinaryClassificationEvaluator(rawPredictionCol="probability", labelCol=label,
                                         metricName="areaUnderROC", numBins=0)


def clamp_depth(d: float) -> int:
    """Tree depth rounded and clamped to Spark's [1, 30]."""
    return int(min(30, max(1, round(d))))


# ------------------------------------------------------------ base learners --

def fit_lr(train: DataFrame, cols: Sequence[str], label: str = "label", reg: float = 0.01,
           max_iter: int = 10):
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    lr = LogisticRegression(featuresCol=FEATURES, labelCol=label, regParam=reg, maxIter=max_iter)
    return Pipeline(stages=[_assembler(cols), lr]).fit(train)


def fit_dt(train: DataFrame, cols: Sequence[str], label: str = "label", depth: int = 10, seed: int = 0):
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import DecisionTreeClassifier
    dt = DecisionTreeClassifier(featuresCol=FEATURES, labelCol=label, maxDepth=clamp_depth(depth), seed=seed)
    return Pipeline(stages=[_assembler(cols), dt]).fit(train)


def fit_gbt(train: DataFrame, cols: Sequence[str], label: str = "label", depth: int = 4, seed: int = 0,
            max_iter: int = 20, validation_col: str | None = None, step: float = 0.1):
    """Boosted trees; with ``validation_col`` (true on held-out rows) boosting
    stops as soon as the held-out loss no longer falls, and keeps the best."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    gbt = GBTClassifier(featuresCol=FEATURES, labelCol=label, maxDepth=clamp_depth(depth), seed=seed,
                        maxIter=max_iter, stepSize=step)
    if validation_col:
        gbt = gbt.setValidationIndicatorCol(validation_col)
    return Pipeline(stages=[_assembler(cols), gbt]).fit(train)


# ----------------------------------------------------------------- searches --
@dataclass
class SearchSpec:
    name: str
    estimator: object
    grid: list = field(default_factory=list)


def _tvs(est, grid, label, parallelism, seed):
    from pyspark.ml.tuning import TrainValidationSplit
    return TrainValidationSplit(estimator=est, estimatorParamMaps=grid, evaluator=_auc_eval(label),
                                trainRatio=0.75, parallelism=parallelism, seed=seed)


def search_specs(d: int, mode: str = "fast", label: str = "label", seed: int = 0,
                 with_rf: bool = False, width: int | None = None, audio: bool = False) -> list[SearchSpec]:
    """Learners and grids for ``d`` columns, of which ``width`` (all, if not
    given) are selected and reach the learner.  ``fast``: LR maxIter 20, reg
    {.11,.21}; tree depth round(.07 d); NB smoothing {.5}; MLP hidden {30x4}.
    ``full``: LR maxIter round(.3 d), reg {.01,.05,.1,.15,.3,.4}; depths
    round({.03,.04,.05} d); NB smoothing {.2,1.1,1.7}; MLP {30x4, 50x3, 80x2}.
    RF (if asked for): trees round(2 d), depth round(.07 d); ``full``:
    round({2,3} d) and round({.05,.07} d).  ``audio``: full reg without .4,
    full depths round({.05,.06,.7} d), one MLP 80x3.  Depths clamp to [1, 30]."""
    from pyspark.ml.classification import (DecisionTreeClassifier, LogisticRegression,
                                           MultilayerPerceptronClassifier, NaiveBayes,
                                           RandomForestClassifier)
    from pyspark.ml.tuning import ParamGridBuilder
    full, width = mode == "full", width or d
    # The grids' numbers
    regs = ([.01, .05, .1, .15, .3] if audio else [.01, .05, .1, .15, .3, .4]) if full else [.11, .21]
    depths = ((.05, .06, .7) if audio else (.03, .04, .05)) if full else (.07,)
    hidden = [[80] * 3] if audio else [[30] * 4, [50] * 3, [80] * 2] if full else [[30] * 4]
    lr = LogisticRegression(featuresCol=FEATURES, labelCol=label,
                            maxIter=max(1, round(0.3 * d)) if full else 20)
    dt = DecisionTreeClassifier(featuresCol=FEATURES, labelCol=label, seed=seed)
    nb = NaiveBayes(featuresCol=FEATURES, labelCol=label)
    mlp = MultilayerPerceptronClassifier(featuresCol=FEATURES, labelCol=label, maxIter=60,
                                         blockSize=300, seed=seed)
    rf = RandomForestClassifier(featuresCol=FEATURES, labelCol=label, seed=seed)
    specs = [
        SearchSpec("lr", lr, ParamGridBuilder().addGrid(lr.regParam, regs).build()),
        SearchSpec("dt", dt, ParamGridBuilder()
                   .addGrid(dt.maxDepth, sorted({clamp_depth(f * d) for f in depths}))
                   .addGrid(dt.impurity, ["entropy", "gini"]).build()),
        SearchSpec("nb", nb, ParamGridBuilder()
                   .addGrid(nb.modelType, ["multinomial", "bernoulli"])
                   .addGrid(nb.smoothing, [.2, 1.1, 1.7] if full else [.5]).build()),
        SearchSpec("mlp", mlp, ParamGridBuilder().addGrid(mlp.layers, [[width, *h, 2] for h in hidden]).build()),
    ]
    if with_rf:
        specs.append(SearchSpec("rf", rf, ParamGridBuilder()
                                .addGrid(rf.numTrees, sorted({max(1, round(f * d)) for f in ((2, 3) if full else (2,))}))
                                .addGrid(rf.maxDepth, sorted({clamp_depth(f * d) for f in ((.05, .07) if full else (.07,))})).build()))
    return specs


def nb_ready(df: DataFrame, cols: Sequence[str], binary: bool = False) -> DataFrame:
    """Naive Bayes needs non-negative (multinomial) or 0/1 (bernoulli)
    features: the -1 ratio sentinel is clipped to 0, bernoulli binarises."""
    exprs = {}
    for c in cols:
        x = F.greatest(F.col(c).cast("double"), F.lit(0.0))
        exprs[c] = (x > 0).cast("double") if binary else x
    return df.withColumns(exprs)


def train_search(train: DataFrame, cols: Sequence[str], spec: SearchSpec, label: str = "label",
                 parallelism: int = 2, seed: int = 0, features=None):
    """Fit one learner's grid with a 75/25 train-validation split.
    ``features`` is the stage that makes the vector (a fitted
    :class:`~shoppulse.operators.selection.ChiSquareSelectionModel`); by
    default all columns are assembled."""
    from pyspark.ml import Pipeline

    def search(data, grid):
        stages = [features or _assembler(cols), _tvs(spec.estimator, grid, label, parallelism, seed)]
        return Pipeline(stages=stages).fit(data)

    if spec.name != "nb":
        return search(train, spec.grid)
    # the two model types need different inputs: each part of the grid is
    # searched on its own (on the same split), and the better one stands
    kind = spec.estimator.modelType
    parts = [(binary, [m for m in spec.grid if (m.get(kind, "multinomial") == "bernoulli") == binary])
             for binary in (False, True)]
    found = [search(nb_ready(train, cols, binary), grid) for binary, grid in parts if grid]
    return max(found, key=lambda m: max(m.stages[-1].validationMetrics))


def nb_binary(model) -> bool:
    """Whether a fitted Naive Bayes pipeline takes 0/1 features."""
    last = model.stages[-1]
    best = getattr(last, "bestModel", last)
    return best.getOrDefault("modelType") == "bernoulli"


def score(model, df: DataFrame, cols: Sequence[str] | None = None, name: str = "p",
          keep: Sequence[str] = ("user_pin",), nb: bool = False) -> DataFrame:
    """``keep`` columns + ``name`` = P(class 1) + ``name_pred``."""
    data = nb_ready(df, cols, nb_binary(model)) if nb and cols else df
    out = model.transform(data)
    return out.select(*keep, p1("probability").alias(name), F.col("prediction").cast("int").alias(f"{name}_pred"))


def train_all(train: DataFrame, valid: DataFrame, cols: Sequence[str], mode: str = "fast",
              with_rf: bool = False, label: str = "label", parallelism: int = 2, seed: int = 0,
              alpha: float = 0.9, audio: bool = False):
    """Select ``int(alpha * d)`` columns by chi-square, fit every learner's
    search on them and report validation AUC.  Returns ``(models: dict of
    fitted pipelines, auc table DataFrame(model, auc))``; every pipeline begins
    with the one fitted selection stage.

    The validation rows are scored by all learners in one pass, and all areas
    come from one aggregation of (model, score)."""
    from shoppulse.operators.features import select_features
    from shoppulse.operators.metrics import auc_roc
    from shoppulse.session import written
    # the training rows are read by every grid point
    train = train.persist()
    try:
        features, selected = select_features(train, cols, alpha, label)
        specs = search_specs(len(cols), mode, label, seed, with_rf, len(selected), audio)
        models = {spec.name: train_search(train, cols, spec, label, parallelism, seed, features) for spec in specs}
    finally:
        train.unpersist()
    scored = score_all(models, valid, cols, keep=(label,))
    long = scored.select(label, F.explode(F.array(*[
        F.struct(F.lit(n).alias("model"), F.col(f"p_{n}").alias("p")) for n in models])).alias("s")).select(label, "s.*")
    return models, written(auc_roc(long, "p", label, by=["model"]))


def selection_of(models: dict):
    """The fitted selection stage that the pipelines of :func:`train_all` begin with."""
    return next(iter(models.values())).stages[0]


def score_all(models: dict, df: DataFrame, cols: Sequence[str], keep: Sequence[str] = ("user_pin",)) -> DataFrame:
    """One P(1) column per model (``p_<name>``) on the same rows, built by
    chaining transforms (no re-join on synthetic ids)."""
    out = df
    for name, m in models.items():
        # only the new column is kept: Naive Bayes sees prepared copies, and the
        # features of the learners after it stay as they are
        row = F.struct(*[F.col(c) for c in out.columns]).alias("_row")
        data = out.withColumn("_row", row)
        t = m.transform(nb_ready(data, cols, nb_binary(m)) if name == "nb" else data)
        out = t.withColumn(f"p_{name}", p1("probability")).select("_row.*", f"p_{name}")
    return out.select(*keep, *[f"p_{n}" for n in models])


# ------------------------------------------------------ out-of-fold scores --

#: Share of the training rows held out to stop boosting or a network early.
HELD_OUT = 0.2


def oof_scores(train: DataFrame, target: DataFrame, cols: Sequence[str], key: str = "user_pin",
               label: str = "label", k: int = 5, depth: int = 10, max_iter: int = 50, seed: int = 0, step: float = 0.1):
    """K-fold out-of-fold scores with boosted trees: each training row is
    scored by the model that did not see it; target rows get the mean over
    the k fold models.  Folds come from the key hash, so every training row
    lands in exactly one fold; a fifth of the rows of the other folds, dealt by
    another hash, stops the boosting.  Returns ``(oof DataFrame(key, label,
    fold, oof), target DataFrame(key, oof), rounds DataFrame(fold, n_trees))``.

    The k fold models are applied to the target by chaining ``transform``s
    (each adds one probability column), so the target is never re-joined on
    its key: no shuffle of the target table at all."""
    from shoppulse.functions.hashing import unit_hash
    from shoppulse.session import written
    # k fits and the held-out scoring read the same folds, from the shared folder
    tagged = written(train.withColumn("fold", fold_column(key, k, seed, "fold"))
                     .withColumn("_held_out", unit_hash(F.col(key), f"early{seed}") < HELD_OUT))
    models = [fit_gbt(tagged.filter(F.col("fold") != f), cols, label, depth, seed, max_iter, "_held_out", step) for f in range(k)]
    oof = None
    for f, m in enumerate(models):
        held = m.transform(tagged.filter(F.col("fold") == f))
        part = held.select(key, label, "fold", p1("probability").alias("oof"))
        oof = part if oof is None else oof.unionByName(part)
    out = target
    for f, m in enumerate(models):
        t = m.transform(out)
        out = t.select(*out.columns, p1("probability").alias(f"_p{f}"))
    mean = sum((F.col(f"_p{f}") for f in range(1, k)), F.col("_p0")) / F.lit(float(k))
    rounds = train.sparkSession.createDataFrame([(f, m.stages[-1].getNumTrees) for f, m in enumerate(models)], "fold int, n_trees int")
    return oof, out.select(key, mean.alias("oof")), rounds


def fit_stopped_mlp(train: DataFrame, cols: Sequence[str], label: str = "label", key: str = "user_pin",
                    hidden: Sequence[int] = (80, 60), seed: int = 0, iterations: int = 10, most: int = 20, patience: int = 2):
    """A perceptron trained ``iterations`` steps at a time, each time from the
    weights of the last, until the log loss of a held-out fifth (by key hash)
    has not fallen ``patience`` times; the best weights stay.  Columns are
    standardised first."""
    from pyspark.ml import Pipeline, PipelineModel
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from shoppulse.functions.hashing import unit_hash
    from shoppulse.session import written
    ready = Pipeline(stages=[VectorAssembler(inputCols=list(cols), outputCol="_raw", handleInvalid="keep"),
                             StandardScaler(inputCol="_raw", outputCol=FEATURES, withMean=True)]).fit(train)
    data = written(ready.transform(train).select(FEATURES, label, (unit_hash(F.col(key), f"mlp{seed}") < HELD_OUT).alias("held")))
    fit_on, held = data.filter("not held"), data.filter("held")
    mlp = MultilayerPerceptronClassifier(featuresCol=FEATURES, labelCol=label, layers=[len(cols), *hidden, 2],
                                         maxIter=iterations, seed=seed)
    p = F.greatest(F.least(p1("probability"), F.lit(1 - 1e-12)), F.lit(1e-12))
    loss = -F.avg(F.when(F.col(label) == 1, F.log(p)).otherwise(F.log(1 - p)))
    best, best_loss, worse = None, None, 0
    for _ in range(most):
        model = mlp.fit(fit_on)
        now = model.transform(held).agg(loss).first()[0]  # one number
        if best is None or (now is not None and now < best_loss - 1e-4):
            best, best_loss, worse = model, now, 0
        else:
            worse += 1
        if now is None or worse == patience:
            break
        mlp = mlp.setInitialWeights(model.weights)
    return PipelineModel(stages=[*ready.stages, best])


def remove_mislabelled_models(train: DataFrame, cols: Sequence[str], label: str = "label",
                              lo: float = 0.35, hi: float = 0.65, seed: int = 0, key: str = "user_pin", c: float = 50.0):
    """In-sample P(1) of a weakly regularised logistic regression (inverse
    strength ``c``) and a perceptron (80, 60) stopped early, averaged; rows
    contradicting their label beyond (lo, hi) are dropped.  Returns ``(kept
    rows, scored rows)``."""
    from shoppulse.operators.scoring import remove_mislabelled
    # the reference's penalty is 1/(2c) of the summed loss, Spark's of the mean loss
    lr = fit_lr(train, cols, label, reg=1.0 / (c * max(train.count(), 1)), max_iter=100)
    mlp = fit_stopped_mlp(train, cols, label, key, seed=seed)
    s = lr.transform(train).select(*train.columns, p1("probability").alias("p_lr"))
    s = mlp.transform(s).select(*s.columns, p1("probability").alias("p_mlp"))
    s = s.withColumn("p_mean", (F.col("p_lr") + F.col("p_mlp")) / 2)
    return remove_mislabelled(s, "p_mean", label, lo, hi), s


def prepare_target(selection, target: DataFrame, key: str = "user_pin") -> DataFrame:
    """Give the target table's columns (all but ``key``) the names of the
    training columns that the fitted selection stage holds, by position
    (guarded by the column count), so every fitted pipeline applies."""
    from shoppulse.operators.schema import rename_positional
    rest = [c for c in target.columns if c != key]
    return rename_positional(target.select(key, *rest), selection.getInputCols(), skip_first=1)


def output(scored: DataFrame, prob_col: str = "ensemble", users_only: bool = False,
           key: str = "user_pin") -> DataFrame:
    """Users with (or without) their blended probability."""
    return scored.select(key) if users_only else scored.select(key, prob_col)


# The 3 x 3 logistic-regression grid searched after chi-square
# selection.
LR_GRID_MAX_ITER = [2, 10, 20]
LR_GRID_REG = [0.01, 0.05, 0.08]


def search_lr_selected(train: DataFrame, cols: Sequence[str], alpha: float = 0.9, label: str = "label",
                       parallelism: int = 2, seed: int = 0):
    """Chi-square selection of ``int(alpha d)`` features, then a 3 x 3
    (maxIter x regParam) logistic-regression grid with a 75/25
    train-validation split.  Returns ``(fitted pipeline, selected names)``."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.tuning import ParamGridBuilder
    from shoppulse.operators.selection import ChiSquareSelection
    lr = LogisticRegression(featuresCol=FEATURES, labelCol=label)
    grid = (ParamGridBuilder().addGrid(lr.maxIter, LR_GRID_MAX_ITER)
            .addGrid(lr.regParam, LR_GRID_REG).build())
    model = Pipeline(stages=[ChiSquareSelection(inputCols=list(cols), outputCol=FEATURES, labelCol=label, alpha=float(alpha)),
                             _tvs(lr, grid, label, parallelism, seed)]).fit(train)
    return model, model.stages[0].getSelected()


# ------------------------------------------------- named searches (M4-M8) --

def _search(name):
    def run(train: DataFrame, cols: Sequence[str], mode: str = "fast", label: str = "label",
            parallelism: int = 2, seed: int = 0):
        spec = {s.name: s for s in search_specs(len(cols), mode, label, seed, with_rf=True)}[name]
        return train_search(train, cols, spec, label, parallelism, seed)
    run.__name__ = f"search_{name}"
    run.__doc__ = f"Train-validation search of the ``{name}`` grid (see :func:`search_specs`)."
    return run


search_lr = _search("lr")
search_dt = _search("dt")
search_nb = _search("nb")
search_mlp = _search("mlp")
search_rf = _search("rf")


def attach_scores(users: DataFrame, scores: DataFrame, key: str = "user_pin") -> DataFrame:
    """Left join of users to their scores on the user key (never on
    separately generated row ids, which depend on partitioning)."""
    return users.join(scores, on=key, how="left")


def ensemble_target(models: dict, target: DataFrame, weights: Sequence[float],
                    key: str = "user_pin", rescale: bool = False) -> DataFrame:
    """Blend every model's P(1) on the unlabelled target table, whose columns
    may have names of their own: they are taken in training order."""
    from shoppulse.operators.scoring import ensemble
    selection = selection_of(models)
    scored = score_all(models, prepare_target(selection, target, key), selection.getInputCols(), keep=(key,))
    return ensemble(scored, [f"p_{n}" for n in models], weights, rescale=rescale)


def model_result(model, target: DataFrame, cols: Sequence[str], key: str = "user_pin",
                 nb: bool = False) -> tuple[DataFrame, DataFrame]:
    """One learner on the target: ``(scores(key, pro, prediction), band
    counts among predicted positives)``."""
    from shoppulse.operators.scoring import score_bands
    s = score(model, target, cols, "pro", keep=(key,), nb=nb).withColumnRenamed("pro_pred", "prediction")
    return s, score_bands(s, "pro", "prediction")
