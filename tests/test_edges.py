"""Hand-made edge cases (FIXTURES.md section F) and operator properties."""

import math
import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from shoppulse.functions import cjk_runs, clean_text, ratio, safe_rate
from shoppulse.operators import correlation as C
from shoppulse.operators import features as FE
from shoppulse.operators import layout as L
from shoppulse.operators import metrics as M
from shoppulse.operators import rules as R
from shoppulse.operators import sampling as S
from shoppulse.operators import schema as SC
from shoppulse.operators import scoring as SCO
from shoppulse.operators import text as T


def test_dedup_names():
    assert SC.dedup_names(["a", "b", "a"]) == ["a1", "b", "a2"]
    assert SC.dedup_names(["x", "y"]) == ["x", "y"]


def test_dedup_columns(spark):
    df = spark.createDataFrame([(1, 2, 3)], ["a", "b", "c"]).toDF("a", "b", "a")
    assert SC.dedup_columns(df).columns == ["a1", "b", "a2"]


def test_filter_extra_zero_noop_and_filter(spark):
    t = spark.createDataFrame([(1, 0, 0), (2, 1, 0), (3, 0, 5)], ["id", "e1", "e2"])
    assert SC.filter_extra_zero(t, ["id", "e1", "e2"]).count() == 3
    out = SC.filter_extra_zero(t, ["id"])
    assert out.columns == ["id"] and [r.id for r in out.collect()] == [1]


def test_rename_positional_guard(spark):
    df = spark.createDataFrame([(1, 2, 3)], ["u", "a", "b"])
    assert SC.rename_positional(df, ["x", "y"], skip_first=1).columns == ["u", "x", "y"]
    with pytest.raises(ValueError):
        SC.rename_positional(df, ["x"], skip_first=1)


def test_zero_variance(spark):
    df = spark.createDataFrame([(1.0, None, 5.0, 1.0), (2.0, None, None, 1.0), (3.0, None, None, 1.0)],
                               "a double, allnull double, single double, const double")
    assert SC.fit_zero_variance(df, df.columns) == ["const"]
    assert SC.all_null_columns(df, df.columns) == ["allnull"]


def test_ratio_edges(spark):
    df = spark.createDataFrame([(0, 0), (3, 0), (3, 2), (0, 4)], "n long, d long")
    got = [(r.r, r.s) for r in df.select(ratio("n", "d").alias("r"), safe_rate("n", "d").alias("s")).collect()]
    assert got == [(None, 0.0), (-1.0, -1.0), (1.5, 1.5), (0.0, 0.0)]


def _wide(spark, rows):
    cols = ["user_pin", "pchs_firstcate_n", "pchs_secondcate_n", "clk_firstcate_n", "clk_secondcate_n",
            "brs_firstcate_n", "brs_secondcate_n", "cart_firstcate_n", "cart_secondcate_n", "attr_v"]
    return spark.createDataFrame(rows, cols)


def test_behaviour_guard_no_complete_row(spark):
    # clk_firstcate defined only on row 1, cart_secondcate only on row 2
    rows = [("u1", 0, 0, 1, 0, 1, 1, 0, 0, 1), ("u2", 0, 0, 0, 0, 1, 1, 0, 2, 1)]
    df = _wide(spark, rows)
    bf = FE.BehaviourFeatures().fit(df)
    assert not bf.appended
    assert bf.transform(df).columns == df.columns


def test_behaviour_appends_and_fills(spark):
    rows = [("u1", 1, 0, 2, 0, 0, 0, 1, 1, 4), ("u2", 0, 0, 0, 0, 0, 0, 0, 0, 2)]
    df = _wide(spark, rows)
    bf = FE.BehaviourFeatures().fit(df)
    # clk_secondcate: 0/0 on every row -> dropped; brs*: x/0 or 0/0 ...
    assert "clk_secondcate_rate" not in bf.ratios
    out = bf.transform(df).orderBy("user_pin").collect()
    assert out[0]["clk_rate"] == 0.5 and out[0]["brs_rate"] == -1.0
    assert out[1]["attr_rate"] == 0.0


def test_top_terms_keeps_ties(spark):
    rows = [(1, f"w{i}", float(20 - i)) for i in range(9)] + [(1, "t1", 5.0), (1, "t2", 5.0), (1, "t3", 1.0)]
    df = spark.createDataFrame(rows, "doc long, word string, tf_idf double")
    got = {r.word for r in T.top_terms(df, "doc", "tf_idf", 10).collect()}
    assert {"t1", "t2"} <= got and "t3" not in got and len(got) == 11


def test_tf_idf_formula(spark):
    rows = [(1, "a", 2), (1, "b", 1), (2, "a", 1)]
    df = spark.createDataFrame(rows, "doc long, word string, n long")
    got = {(r.doc, r.word): r.tf_idf for r in T.tf_idf(df, "doc", "word", "n").collect()}
    assert got[(1, "a")] == 0.0
    assert math.isclose(got[(1, "b")], (1 / 3) * math.log(2))


def test_split_parts_tail(spark):
    df = spark.range(10).withColumnRenamed("id", "k")
    parts = {r.k: r.part for r in L.split_parts(df, "k", 3).collect()}
    # len = round(10/3) = 3 -> parts 1: 0-2, 2: 3-5, 3: 6-9 (tail joins the last part)
    assert [parts[i] for i in range(10)] == [1, 1, 1, 2, 2, 2, 3, 3, 3, 3]
    df2 = spark.range(7).withColumnRenamed("id", "k")
    # round(7/2) = 4 (half to even of 3.5)
    assert L.part_length(7, 2) == 4


def test_row_index_matches_sort(spark):
    vals = random.Random(1).sample(range(100000), 500)
    df = spark.createDataFrame([(v,) for v in vals], "k long")
    got = {r.k: r.row_idx for r in L.with_row_index(df, "k", ranges=7).collect()}
    assert [got[v] for v in sorted(vals)] == list(range(500))


def _auc_brute(scores, labels):
    pos = [s for s, y in zip(scores, labels) if y == 1]
    neg = [s for s, y in zip(scores, labels) if y == 0]
    u = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p in pos for n in neg)
    return u / (len(pos) * len(neg))


def test_auc_against_pairs(spark):
    rnd = random.Random(3)
    rows = [(round(rnd.random(), 1), rnd.randint(0, 1)) for _ in range(300)]
    df = spark.createDataFrame(rows, "s double, label int")
    got = M.auc_roc(df, "s", "label").first().auc
    assert math.isclose(got, _auc_brute(*zip(*rows)), rel_tol=1e-12)
    assert math.isclose(M.auc_evaluator(df, "s", "label"), got, rel_tol=1e-9)


def test_score_band_edges(spark):
    df = spark.createDataFrame([(0.5, 1), (0.7, 1), (0.8, 1), (0.49, 1), (0.9, 0)], "pro double, prediction int")
    got = {r.band: r.n for r in SCO.score_bands(df).collect()}
    assert got == {"low": 1, "medium": 1, "high": 1}


def test_mislabel_strict(spark):
    df = spark.createDataFrame([(0.35, 1), (0.34, 1), (0.65, 0), (0.66, 0), (0.1, 0)], "p_mean double, label int")
    assert SCO.remove_mislabelled(df).count() == 3


def test_min_max_constant(spark):
    df = spark.createDataFrame([(2.0,), (2.0,)], "x double")
    assert [r.x for r in SCO.min_max(df, "x").collect()] == [0.0, 0.0]


def test_ensemble_weight_length(spark):
    df = spark.createDataFrame([(0.2, 0.4)], "a double, b double")
    with pytest.raises(ValueError):
        SCO.ensemble(df, ["a", "b"], [1.0])
    got = SCO.ensemble(df, ["a", "b"], [1.0, 3.0]).first().ensemble
    assert math.isclose(got, 0.25 * 0.2 + 0.75 * 0.4)


def _sequential_weights(pairs, feats, pos, neg, mode):
    w = {f: (1.0 if mode == "multiply" else 0.0) for f in feats}
    table = [(lambda a, b: pos in a and neg in b, (1, 1.0, -1, 1.0, 40, -40)),
             (lambda a, b: neg in a and pos in b, (-1, 1.0, 1, 1.0, -40, 40)),
             (lambda a, b: pos in a and neg not in b, (1, 2.0, 1, 0.5, 70, 40)),
             (lambda a, b: neg in a and pos not in b, (-1, 2.0, -1, 0.5, -60, -40)),
             (lambda a, b: pos not in a and neg in b, (-1, 0.5, -1, 2.0, -40, -60)),
             (lambda a, b: neg not in a and pos in b, (1, 0.5, 1, 2.0, 40, 70))]
    for a, b, c in sorted(pairs, key=lambda p: (-p[2], p[0], p[1])):
        for cond, (s1, k1, s2, k2, a1, a2) in table:
            if cond(a, b):
                if mode == "multiply":
                    w[a] = s1 * abs(w[a] * (1 + k1 * c))
                    w[b] = s2 * abs(w[b] * (1 + k2 * c))
                else:
                    w[a] += a1 * c
                    w[b] += a2 * c
                break
    return w


@pytest.mark.parametrize("mode", ["multiply", "add"])
def test_signed_weights_closed_form(spark, mode):
    feats = ["m_a", "m_b", "f_a", "f_b", "x", "m_f_both"]
    rnd = random.Random(7)
    pairs = []
    for i, a in enumerate(feats):
        for b in feats[i + 1:]:
            c = round(rnd.random(), 3)
            pairs += [(a, b, c), (b, a, c)]
    df = spark.createDataFrame(pairs, "level_0 string, level_1 string, corr_value double")
    got = {r.feature: r.weight for r in C.signed_weights(df, feats, "m_", "f_", mode).collect()}
    want = _sequential_weights(pairs, feats, "m_", "f_", mode)
    for f in feats:
        assert math.isclose(got[f], want[f], rel_tol=1e-9, abs_tol=1e-9), f


def test_corr_pairs_constant_dropped(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, 4.1, 5.0), (3.0, 5.9, 5.0)], "a double, b double, c double")
    out = C.corr_pairs(df, ["a", "b", "c"]).collect()
    assert {(r.level_0, r.level_1) for r in out} == {("a", "b"), ("b", "a")}


def test_item_correlation_symmetric(spark):
    rows = [("s1", "w1", 3), ("s1", "w2", 1), ("s2", "w1", 2), ("s2", "w3", 4), ("s3", "w2", 2), ("s3", "w3", 1)]
    df = spark.createDataFrame(rows, "item string, term string, n long")
    out = {(r.SKU1, r.SKU2): r.correlation for r in C.item_correlation(df, "item", "term").collect()}
    assert len(out) == 6
    for (a, b), v in out.items():
        assert math.isclose(v, out[(b, a)])


def test_association_rules_duplicates_and_threshold(spark):
    rows = [(1, "a"), (1, "a"), (1, "b"), (2, "a"), (2, "b"), (3, "a"), (3, "c")]
    df = spark.createDataFrame(rows, "id long, item string")
    _, rules = R.association_rules(df, "id", "item", 0.3, 0.5)
    got = {(tuple(r.antecedent), r.consequent[0]): r.confidence for r in rules.collect()}
    assert math.isclose(got[(("b",), "a")], 1.0)
    assert math.isclose(got[(("a",), "b")], 2 / 3)
    assert all(v >= 0.5 for v in got.values())


def test_balance_fractions():
    assert S.balance_fractions(100, 50) == (0.5, 1.0)
    assert S.balance_fractions(10, 50) == (1.0, 0.4)
    assert S.balance_fractions(10, 15) == (1.0, 10 / 15)
    assert S.balance_fractions(10, 40, "equal") == (1.0, 0.25)


def test_hash_sample_stable_under_repartition(spark):
    df = spark.range(5000).withColumnRenamed("id", "k")
    a = {r.k for r in S.hash_sample(df, "k", 0.2, 1).collect()}
    b = {r.k for r in S.hash_sample(df.repartition(13), "k", 0.2, 1).collect()}
    assert a == b and 800 < len(a) < 1200


def test_folds_cover_once(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    f = df.select(S.fold_column("k", 5, 0, "fold")).groupBy("fold").count().collect()
    assert sum(r["count"] for r in f) == 1000 and len(f) == 5


def test_text_expressions(spark):
    df = spark.createDataFrame([("好評abc，很好:x 不错 &|;\\ 电视机",)], "t string")
    r = df.select(cjk_runs("t").alias("c"), clean_text("t", ["不错", "电视"]).alias("k")).first()
    assert r.c == "好評 很好 不错 电视机" or r.c.startswith("好")
    assert "abc" not in r.k and "&" not in r.k and "\\" not in r.k and "电视" not in r.k and "机" in r.k


def test_extract_tags_and_qa(spark):
    body = ('"averageScore":4,"commentCount":12,"id":1,"name":"good","count":7,'
            '"id":2,"name":"fast","count":5')
    df = spark.createDataFrame([(1, body)], "sku long, body string")
    tags = [(r.name, r["count"]) for r in T.extract_tags(df, "sku", "body").orderBy("tag_pos").collect()]
    assert tags == [("good", 7), ("fast", 5)]
    s = T.extract_tag_summary(df, "sku", "body").first()
    assert (s.averagescore, s.commentCount, s.labelID) == ("4", "12", "good:7 fast:5 ")
    qa = ('"content":"is it big: yes?","clientType":1,"productId":9,"status":1,'
          '"lastAnswerTime":"2024-01-01 10:00:00",[{"content":"quite big","systemId":1,'
          '"created":"2024-01-02 00:00:00","modified":"2024-01-03 00:00:00"}]')
    q = T.extract_qa(spark.createDataFrame([(9, qa)], "sku long, body string"), "sku", "body").first()
    assert q.ask_content == "is it big" and q.reply_content == "quite big"
    assert str(q.replymodifiedTime).startswith("2024-01-03")


def test_read_review_files(spark, tmpdir_path):
    d = tmpdir_path
    with open(os.path.join(d, "123po.csv"), "w", encoding="utf-8-sig") as f:
        f.write("comments\ngood one\n\"\"\nnice\n")
    with open(os.path.join(d, "456ne.csv"), "w", encoding="utf-8-sig") as f:
        f.write("comments\n")
    from shoppulse.sources import read_review_dir, read_reviews, read_sku_list
    assert read_reviews(spark, os.path.join(d, "456ne.csv")).count() == 0
    df = read_review_dir(spark, os.path.join(d, "*.csv"))
    rows = df.collect()
    assert {(r.sku, r.sentiment) for r in rows} == {("123", "po")}
    assert sorted(r.comments for r in rows if r.comments) == ["good one", "nice"]
    with open(os.path.join(d, "sku.txt"), "w") as f:
        f.write("111,222, 333,\n")
    assert [r.sku for r in read_sku_list(spark, os.path.join(d, "sku.txt")).collect()] == ["111", "222", "333"]


def test_sinks(spark, tmpdir_path):
    from shoppulse.sources import save_single_csv, save_users, write_parts
    df = spark.range(10).select(F.col("id").cast("string").alias("user_pin"), F.col("id").alias("k"))
    save_users(df, os.path.join(tmpdir_path, "users"))
    assert spark.read.option("header", True).csv(os.path.join(tmpdir_path, "users")).count() == 10
    save_single_csv(df, os.path.join(tmpdir_path, "single"))
    parts = [p for p in os.listdir(os.path.join(tmpdir_path, "single")) if p.startswith("part-")]
    assert len(parts) == 1
    write_parts(df, "k", 3, os.path.join(tmpdir_path, "parts"))
    back = spark.read.parquet(os.path.join(tmpdir_path, "parts"))
    assert {r.part: r["count"] for r in back.groupBy("part").count().collect()} == {1: 3, 2: 3, 3: 4}


def test_classification_report_zero_division(spark):
    df = spark.createDataFrame([(1, 1), (1, 1), (0, 1)], "label int, prediction int")
    rep = {r.cls: r for r in M.classification_report(df).collect()}
    assert rep["0"].precision == 0.0 and rep["0"].support == 1
    assert math.isclose(rep["1"].precision, 2 / 3) and rep["accuracy"].precision == 2 / 3


def test_cjk_bigrams(spark):
    from shoppulse.functions import cjk_bigrams
    df = spark.createDataFrame([("很好用 a 好",)], "t string")
    assert df.select(cjk_bigrams("t").alias("b")).first().b == ["很好", "好用", "好"]


def test_spread_keeps_rows(spark):
    from shoppulse.session import spread
    df = spark.range(100).coalesce(1)
    out = spread(df, min_partitions=4)
    assert out.rdd.getNumPartitions() == 4 and out.count() == 100


def test_join_frequency_full_outer(spark):
    tokens = spark.createDataFrame([(1, "a"), (2, "a"), (2, "b")], "id long, word string")
    freq = spark.createDataFrame([("a", 2), ("b", 1), ("z", 9)], "word string, frequency long")
    got = sorted((r.word, r.id, r.frequency) for r in T.join_frequency(tokens, freq).collect())
    assert got == [("a", 1, 2), ("a", 2, 2), ("b", 2, 1), ("z", None, 9)]


def test_with_frequency_in_blocks(spark):
    """A third of all tokens is one word; a few blocks make long lists, many short ones; null words stay."""
    rows = [(i % 7, "hot" if i % 3 == 0 else f"w{i % 50}", i) for i in range(3000)] + [(8, None, 1), (8, "once", 2)]
    tokens = spark.createDataFrame(rows, "id long, word string, place long")
    n = Counter(w for _, w, _ in rows)
    want = sorted(((w, i, p, n[w] if w else None) for i, w, p in rows), key=str)
    for blocks in (1, 5, 1 << 16):
        got = T.with_frequency(tokens, blocks=blocks)
        assert got.columns == ["word", "id", "place", "frequency"]
        got = got.collect()
        assert [r.id for r in got] == sorted(r.id for r in got)
        assert sorted((tuple(r) for r in got), key=str) == want
    freq = T.term_frequency(tokens.filter("word IS NOT NULL"))
    joined = T.join_frequency(tokens, freq).select("word", "id", "place", "frequency").collect()
    assert sorted((tuple(r) for r in joined), key=str) == want
    assert T.with_frequency(tokens.limit(0)).collect() == []


def test_with_frequency_makes_the_tokens_once(spark):
    docs = spark.createDataFrame([(i, f"a b{i % 3} c") for i in range(50)], "id long, text string")
    df = T.with_frequency(T.token_positions(docs, "id", "text"), order_col=None)
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert final.count("ReusedExchange") + final.count("ReusedQueryStage") >= 1
    assert final.count("Generate posexplode") == 1


def test_topic_overlap_and_share(spark):
    from shoppulse.operators import topics as TP
    rows = [(1, 1, "a", 0.1), (1, 2, "b", 0.1), (2, 1, "b", 0.1), (2, 2, "c", 0.1),
            (3, 1, "d", 0.1), (3, 2, "e", 0.1)]
    terms = spark.createDataFrame(rows, "topic int, rank int, term string, weight double")
    ov = TP.topic_overlap(terms, 3, 2).first()
    # pairs (1,2): |{b}|/2 = .5, (1,3): 0, (2,3): 0 -> mean 1/6
    assert ov.k == 3 and math.isclose(ov.mean_cosine, 0.5 / 3)
    freq = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2), ("d", 0), ("e", 0)], "word string, frequency long")
    share = {r.topic: (r.share, r.label) for r in TP.topic_share(terms, freq).collect()}
    assert share[1] == (0.4, "topic:1(40%)") and share[2] == (0.6, "topic:2(60%)")
    assert share[3] == (0.0, "topic:3(0%)")


def test_share_label_format(spark):
    from shoppulse.functions import share_label
    df = spark.createDataFrame([(1, 33.3333), (2, 12.5), (3, 50.0)], "t int, p double")
    assert [r.l for r in df.select(share_label("t", "p").alias("l")).collect()] == \
        ["topic:1(33.33%)", "topic:2(12.5%)", "topic:3(50%)"]


def test_read_cohort_and_headerless(spark, tmpdir_path):
    from shoppulse.sources import read_cohort, read_lines, read_reviews
    from shoppulse.sources.sinks import save_table
    p = os.path.join(tmpdir_path, "cohort.csv")
    with open(p, "w") as f:
        f.write("user_pin,pchs_a,clk_b\n007,1,2.5\n008,0,1.0\n")
    df = read_cohort(spark, p)
    assert dict(df.dtypes) == {"user_pin": "string", "pchs_a": "int", "clk_b": "double"}
    assert sorted(r.user_pin for r in df.collect()) == ["007", "008"]
    typed = read_cohort(spark, p, "user_pin string, pchs_a double, clk_b double")
    assert typed.first().pchs_a in (1.0, 0.0)
    h = os.path.join(tmpdir_path, "nohead.csv")
    with open(h, "w", encoding="utf-8") as f:
        f.write("好评\n不错\n")
    assert read_reviews(spark, h, header=False).columns == ["V1"]
    assert read_lines(spark, h).count() == 2
    save_table(df, os.path.join(tmpdir_path, "t_csv"), fmt="csv")
    assert spark.read.option("header", True).csv(os.path.join(tmpdir_path, "t_csv")).count() == 2


def test_attach_scores_by_key(spark):
    from shoppulse.operators.models import attach_scores
    users = spark.createDataFrame([("u1",), ("u2",), ("u3",)], "user_pin string").repartition(3)
    scores = spark.createDataFrame([("u3", 0.9), ("u1", 0.2)], "user_pin string, p double").repartition(2)
    got = {r.user_pin: r.p for r in attach_scores(users, scores).collect()}
    assert got == {"u1": 0.2, "u2": None, "u3": 0.9}


def test_row_index_hot_key_is_split(spark):
    # key 5 holds a third of the rows
    rows = [(5 if i % 3 == 0 else i, i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k long, v long")
    out = L.with_row_index(df, "k", ranges=8).collect()
    idx = sorted(r.row_idx for r in out)
    assert idx == list(range(3000))
    by_idx = sorted(out, key=lambda r: r.row_idx)
    keys = [r.k for r in by_idx]
    assert keys == sorted(keys)  # positions follow the key order


def test_split_parts_with_ties_sizes(spark):
    rows = [(1 if i < 400 else i, i) for i in range(1000)]
    df = spark.createDataFrame(rows, "k long, v long")
    sizes = {r.part: r["count"] for r in L.split_parts(df, "k", 3).groupBy("part").count().collect()}
    assert sizes == {1: 333, 2: 333, 3: 334}


def test_broadcast_only_under_bound(spark):
    from shoppulse.session import broadcast_if_small
    small = spark.range(5)
    big = spark.range(50)
    assert "broadcast" in broadcast_if_small(small, 10)._jdf.queryExecution().logical().toString().lower()
    assert broadcast_if_small(big, 10) is big


def test_spread_no_op_with_enough_splits(spark):
    from shoppulse.session import spread
    df = spark.range(100).repartition(16)
    assert spread(df, min_partitions=8) is df


def test_auc_pr_matches_evaluator(spark):
    rnd = random.Random(9)
    rows = [(round(rnd.random(), 2), rnd.randint(0, 1)) for _ in range(500)]
    df = spark.createDataFrame(rows, "s double, label int")
    got = M.auc_pr(df, "s", "label").first().auc_pr
    assert math.isclose(got, M.auc_evaluator(df, "s", "label", "areaUnderPR"), rel_tol=1e-9)
