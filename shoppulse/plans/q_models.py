"""Association rules, model training / ensembles and topic-model queries.

Rule queries have exact SQL oracles; trained models and topic models are
checked by row counts (and by property tests in ``tests/``)."""

from __future__ import annotations

from pyspark.sql import functions as F

from shoppulse.operators import features as FE
from shoppulse.operators import models as MO
from shoppulse.operators import packed_counts as PC
from shoppulse.operators import rules as R
from shoppulse.operators import sampling as S
from shoppulse.operators import scoring as SC
from shoppulse.operators import text as T
from shoppulse.operators import topics as TP
from shoppulse.plans import fixtures as FX
from shoppulse.plans.catalog import query
from shoppulse.plans.q_scoring import CHI2_SQL
from shoppulse.session import written

# The reference's rule thresholds.
MIN_SUPPORT, MIN_CONFIDENCE = 0.003, 0.005


def _brands(spark, sf_dir):
    li = FX.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    part = FX.table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return li.join(part, li.l_partkey == part.p_partkey).select("l_orderkey", "p_brand")


def _brand_rules(spark, sf_dir):
    _, rules = R.association_rules(_brands(spark, sf_dir), "l_orderkey", "p_brand", MIN_SUPPORT, MIN_CONFIDENCE)
    t = R.rules_table(rules)
    return t.select("antecedent", "consequent", "lhs_size", *[F.round(c, 6).alias(c)
                                                              for c in ("support", "confidence", "lift")])


_RULE_BASE = f"""b AS (SELECT DISTINCT l_orderkey AS id, p_brand AS item FROM lineitem JOIN part ON l_partkey = p_partkey
                   WHERE p_brand IS NOT NULL),
  n AS (SELECT CAST(count(DISTINCT id) AS DOUBLE) AS B, ceil({MIN_SUPPORT} * count(DISTINCT id)) AS m FROM b),
  s1 AS (SELECT item, count(*) AS c FROM b GROUP BY item),
  s2 AS (SELECT a.item AS x, c.item AS y, count(*) AS c FROM b a JOIN b c ON a.id = c.id AND a.item <> c.item
         GROUP BY ALL)"""

_PAIR_SELECT = """SELECT x AS antecedent, y AS consequent, 1 AS lhs_size, round(s2.c / B, 6) AS support,
  round(s2.c / sx.c, 6) AS confidence, round((s2.c / sx.c) / (sy.c / B), 6) AS lift
FROM s2 JOIN s1 sx ON sx.item = x JOIN s1 sy ON sy.item = y, n
WHERE s2.c >= m AND s2.c / sx.c >= """ + str(MIN_CONFIDENCE)


@query("pair_rules", f"WITH {_RULE_BASE} {_PAIR_SELECT}")
def pair_rules(spark, sf_dir):
    """Rules with one item on each side (basket = order, item = brand)."""
    rules = R.pair_rules(_brands(spark, sf_dir), "l_orderkey", "p_brand", MIN_SUPPORT, MIN_CONFIDENCE)
    return rules.select("antecedent", "consequent", F.lit(1).alias("lhs_size"),
                        *[F.round(c, 6).alias(c) for c in ("support", "confidence", "lift")])


def _rules_sql(max_len: int = 5) -> str:
    """Brute-force oracle: every rule whose itemset has at most ``max_len``
    items, by self-joins of the distinct (basket, item) table."""
    ctes, selects = [], []
    for k in range(1, max_len):  # antecedent size k, itemset size k + 1
        a = [f"a{i}" for i in range(k)]
        joins = " ".join(f"JOIN b {x} ON {x}.id = a0.id AND {x}.item > {a[i - 1]}.item"
                         for i, x in enumerate(a) if i > 0)
        keys = ", ".join(f"{x}.item AS x{i}" for i, x in enumerate(a))
        ctes.append(f"ant{k} AS (SELECT {keys}, count(*) AS c FROM b a0 {joins} GROUP BY ALL)")
        excl = " AND ".join(f"y.item <> {x}.item" for x in a)
        ctes.append(f"its{k} AS (SELECT {keys}, y.item AS y, count(*) AS c FROM b a0 {joins} "
                    f"JOIN b y ON y.id = a0.id AND {excl} GROUP BY ALL)")
        on = " AND ".join(f"ant{k}.x{i} = its{k}.x{i}" for i in range(k))
        label = " || ',' || ".join(f"its{k}.x{i}" for i in range(k))
        selects.append(
            f"SELECT {label} AS antecedent, its{k}.y AS consequent, {k} AS lhs_size, "
            f"round(its{k}.c / B, 6) AS support, round(its{k}.c / ant{k}.c, 6) AS confidence, "
            f"round((its{k}.c / ant{k}.c) / (sy.c / B), 6) AS lift FROM its{k} JOIN ant{k} ON {on} "
            f"JOIN s1 sy ON sy.item = its{k}.y, n WHERE its{k}.c >= m AND its{k}.c / ant{k}.c >= {MIN_CONFIDENCE}")
    return f"WITH {_RULE_BASE}, " + ", ".join(ctes) + " " + " UNION ALL ".join(selects)


@query("fpgrowth_rules", _rules_sql(5))
def fpgrowth_rules(spark, sf_dir):
    """All rules at support .003 / confidence .005 (the oracle enumerates
    itemsets up to 5 items; larger ones are not frequent on these baskets)."""
    return _brand_rules(spark, sf_dir)


# --------------------------------------------------------------- learners --
FEATS = FX.FEATURES


#: Labelled rows a partition, about, when they are dealt to more partitions than they came in.
ROWS = 10_000


def _labelled(spark, sf_dir):
    """The labelled rows, written: the learners pass over them many times, and
    each pass over the fixture would take its features from the texts again.
    Their partitions follow the rows, up to the cluster's cores, not the files
    and joins they come from."""
    df = written(FX.labelled_docs(spark, sf_dir))
    parts = min(spark.sparkContext.defaultParallelism, df.count() // ROWS)
    return written(df.repartition(parts, "user_pin")) if parts > df.rdd.getNumPartitions() else df


def _split(spark, sf_dir):
    train, valid = S.split(_labelled(spark, sf_dir), "user_pin", [4, 1], seed=0)
    return train, valid


def _base(fit):
    def run(spark, sf_dir):
        train, valid = _split(spark, sf_dir)
        m = fit(train)
        return MO.score(m, valid, FEATS, "p", keep=("user_pin", "label"))
    return run


query("lr_scores")(_base(lambda t: MO.fit_lr(t, FEATS, reg=0.01, max_iter=10)))
query("dt_scores")(_base(lambda t: MO.fit_dt(t, FEATS, depth=10)))
query("gbt_scores")(_base(lambda t: MO.fit_gbt(t, FEATS, depth=4)))


def _spec_scores(name):
    def run(spark, sf_dir):
        train, valid = _split(spark, sf_dir)
        spec = {s.name: s for s in MO.search_specs(len(FEATS), "full", with_rf=True)}[name]
        m = MO.train_search(train, FEATS, spec)
        return MO.score(m, valid, FEATS, "p", keep=("user_pin", "label"), nb=name == "nb")
    return run


query("nb_scores")(_spec_scores("nb"))
query("mlp_scores")(_spec_scores("mlp"))
query("rf_scores")(_spec_scores("rf"))
query("lr_search_scores")(_spec_scores("lr"))
query("dt_search_scores")(_spec_scores("dt"))


@query("lr_grid_selected_scores")
def lr_grid_selected_scores(spark, sf_dir):
    """Chi-square selection (alpha .9) + 3 x 3 LR grid, scored on the
    held-out split."""
    train, valid = _split(spark, sf_dir)
    train = train.persist()
    try:
        m, _ = MO.search_lr_selected(train, FEATS, 0.9)
    finally:
        train.unpersist()
    return MO.score(m, valid, FEATS, "p", keep=("user_pin", "label"))


@query("model_auc")
def model_auc(spark, sf_dir):
    """Held-out ROC and PR areas of the selected-feature LR grid (both exact
    and distributed: rank form for ROC, per-score trapezoids for PR)."""
    from shoppulse.operators.metrics import auc_pr, auc_roc
    s = written(lr_grid_selected_scores(spark, sf_dir))
    return auc_roc(s, "p", "label").crossJoin(auc_pr(s, "p", "label"))  # one row each


@query("chi2_selected", f"""WITH s AS ({CHI2_SQL}), z AS (SELECT feature, CASE WHEN dof > 0 THEN
    (cbrt(greatest(statistic, 0) / dof) - (1 - 2 / (9.0 * dof))) / sqrt(2 / (9.0 * dof)) END AS strength,
    list_position([{', '.join(f"'{c}'" for c in FEATS)}], feature) AS place FROM s)
SELECT feature FROM z ORDER BY strength DESC NULLS LAST, place LIMIT {FE.top_feature_count(0.9, len(FEATS))}""")
def chi2_selected(spark, sf_dir):
    """Names of the int(.9 d) features kept by chi-square selection."""
    df = _labelled(spark, sf_dir)
    _, names = FE.select_features(df, FEATS, 0.9)
    return spark.createDataFrame([(n,) for n in names], "feature string")


def _trained(spark, sf_dir):
    train, valid = _split(spark, sf_dir)
    models, aucs = MO.train_all(train, valid, FEATS, mode="fast")
    return models, aucs, valid


@query("train_all_auc")
def train_all_auc(spark, sf_dir):
    _, aucs, _ = _trained(spark, sf_dir)
    return aucs


def _auc_weights(models, aucs):
    got = {r["model"]: r["auc"] for r in aucs.collect()}  # one number per model
    return [got[n] if got.get(n) is not None else 0.0 for n in models]


@query("ensemble_trained")
def ensemble_trained(spark, sf_dir):
    models, aucs, valid = _trained(spark, sf_dir)
    s = MO.score_all(models, valid, FEATS, keep=("user_pin", "label"))
    return SC.ensemble(s, [f"p_{n}" for n in models], _auc_weights(models, aucs))


@query("ensemble_target")
def ensemble_target(spark, sf_dir):
    models, aucs, _ = _trained(spark, sf_dir)
    target = FX.target_docs(spark, sf_dir)
    own = target.toDF("user_pin", *[f"t{k}" for k in range(len(FEATS))])  # the target's own names
    return MO.ensemble_target(models, own, _auc_weights(models, aucs))


@query("model_result")
def model_result(spark, sf_dir):
    """One learner on the target table, banded among predicted positives."""
    train, _ = _split(spark, sf_dir)
    _, bands = MO.model_result(MO.fit_lr(train, FEATS), FX.target_docs(spark, sf_dir), FEATS)
    return bands


@query("output_users")
def output_users(spark, sf_dir):
    """Target users whose blended probability exceeds .59."""
    e = ensemble_target(spark, sf_dir)
    return SC.select_above(e, "ensemble", 0.59).select("user_pin", "ensemble")


@query("oof_scores")
def oof_scores(spark, sf_dir):
    oof, _, _ = MO.oof_scores(_labelled(spark, sf_dir), FX.target_docs(spark, sf_dir), FEATS, k=5)
    return oof


@query("oof_target")
def oof_target(spark, sf_dir):
    _, tgt, _ = MO.oof_scores(_labelled(spark, sf_dir), FX.target_docs(spark, sf_dir), FEATS, k=5)
    return tgt


@query("remove_mislabelled")
def remove_mislabelled(spark, sf_dir):
    kept, _ = MO.remove_mislabelled_models(_labelled(spark, sf_dir), FEATS)
    return kept.select("user_pin", "label", "p_lr", "p_mlp", "p_mean")


# ------------------------------------------------------------------ topics --

def _vectors(spark, sf_dir):
    docs = FX.table(spark, sf_dir, "documents")
    toks = T.tokenize(docs, "doc_id", "text", stopwords=FX.STOP_WORDS, lists=True)
    packed = PC.pack(toks, "doc_id", "word")
    vec, vocab = TP.count_vectors(TP.doc_term_matrix(packed, "doc_id", "word", min_df=5), "doc_id")
    return packed, vec, vocab


@query("topic_terms")
def topic_terms(spark, sf_dir):
    _, vec, vocab = _vectors(spark, sf_dir)
    return TP.topic_terms(TP.fit_topics(vec, 3, seed=0), vocab, 200)


@query("topic_separation")
def topic_separation(spark, sf_dir):
    _, vec, vocab = _vectors(spark, sf_dir)
    return TP.topic_separation(vec, vocab, range(2, 11), 50, seed=0)  # nine fits read the written vectors


@query("topic_share")
def topic_share(spark, sf_dir):
    packed, vec, vocab = _vectors(spark, sf_dir)
    terms = TP.topic_terms(TP.fit_topics(vec, 3, seed=0), vocab, 200)
    return TP.topic_share(terms, T.term_frequency(packed.terms, n_col="n"))
