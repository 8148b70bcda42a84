"""Inputs on which earlier versions failed or gave other answers."""

import glob

import pytest
from pyspark.sql import functions as F

from shoppulse.operators import correlation as CO
from shoppulse.operators import features as FE
from shoppulse.operators import layout as L
from shoppulse.operators import metrics as ME
from shoppulse.operators import models as MO
from shoppulse.operators import schema as SC
from shoppulse.operators import text as T
from shoppulse.operators import topics as TO
from shoppulse.sources import sinks

CONSTANT = 123456.789


def _with_constant(spark, width):
    cols = [F.lit(CONSTANT).alias("c0")] + [((F.col("id") * (k + 3)) % 101).cast("double").alias(f"x{k}") for k in range(width - 1)]
    return spark.range(0, 3001, 1, 7).select(*cols)


@pytest.mark.parametrize("width", [4, 17])
def test_constant_column_has_no_correlation(spark, width):
    df = _with_constant(spark, width)
    pairs = CO.corr_pairs(df, df.columns).collect()
    assert pairs and not any("c0" in (r.level_0, r.level_1) for r in pairs)


def test_constant_column_has_zero_variance(spark):
    df = _with_constant(spark, 3)
    assert SC.fit_zero_variance(df, df.columns) == ["c0"]
    assert {r.column: r.stddev for r in SC.column_stddevs(df, df.columns).collect()}["c0"] == 0.0


def test_score_all_does_not_depend_on_the_order(spark):
    rows = [(k, float((k * 7) % 5 - 1), float(k % 3), int((k * 7) % 5 > 2)) for k in range(60)]
    df = spark.createDataFrame(rows, "user_pin long, a double, b double, label int")
    nb = MO.search_nb(df, ["a", "b"])
    lr = MO.fit_lr(df, ["a", "b"])
    one = MO.score_all({"nb": nb, "lr": lr}, df, ["a", "b"])
    two = MO.score_all({"lr": lr, "nb": nb}, df, ["a", "b"]).select(one.columns)
    assert sorted(one.collect()) == sorted(two.collect())
    alone = {r.user_pin: r.p for r in MO.score(lr, df, keep=["user_pin"]).collect()}
    assert {r.user_pin: r.p_lr for r in one.collect()} == alone


def test_every_search_has_a_default_grid():
    names = {s.name: s for s in MO.search_specs(30, with_rf=True)}
    assert set(names) == {"lr", "dt", "nb", "mlp", "rf"} and len(names["rf"].grid) == 1 and len(names["nb"].grid) == 2


def test_sums_are_appended_without_any_ratio(spark):
    df = spark.createDataFrame([("u1", 0, 0), ("u2", 0, 0)], "user_pin string, pchs_firstcate_n int, clk_firstcate_n int")
    out = FE.behaviour_features(df)[0]
    assert out.columns == df.columns + FE.SUM_NAMES
    assert FE.behaviour_features(df.limit(0))[0].columns == df.columns


def test_families_follow_the_rule():
    cols = ["pchs_attr_n", "pchs_secondcate_n", "pchs_n", "flw_n", "cart_secondcate_n", "brs_n", "other"]
    fam = SC.column_families(cols)
    assert len(fam) == 14
    assert fam["pchs_columns"] == cols[:3] and fam["pchs_firstcate_columns"] == ["pchs_n"] and fam["pchs_secondcate_columns"] == ["pchs_secondcate_n"]
    assert fam["flw_secondcate_columns"] == ["flw_n"] and fam["attr_columns"] == ["pchs_attr_n"] and fam["cart_columns"] == ["cart_secondcate_n"]
    assert SC.leftover_columns(cols, fam) == ["other"]


def test_odd_tag_names_and_times_do_not_fail(spark):
    tags = spark.createDataFrame([(1, '"id":1,"name":"a:b","count":7,"id":2,"name":"fast","count":5')], "sku long, body string")
    assert [(r.name, r["count"]) for r in T.extract_tags(tags, "sku", "body").orderBy("tag_pos").collect()] == [("a", None), ("fast", 5)]
    body = ('"content":"is it big: yes?","clientType":1,"productId":9,"status":1,"lastAnswerTime":"0000-00-00 00:00:00",'
            '[{"content":"quite big","systemId":1,"created":"2024-01-02 00:00:00","modified":"2024-13-03 00:00:00"}]')
    r = T.extract_qa(spark.createDataFrame([(9, body)], "sku long, body string"), "sku", "body").first()
    assert r.ask_content == "is it big" and r.lastAnswerTime is None and r.replymodifiedTime is None and r.replycreatedTime is not None


def test_stop_lists_treat_null_terms_alike(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "word string")
    words = ["a", "z"]
    forms = (words, words + [f"w{k}" for k in range(20_000)], spark.createDataFrame([(w,) for w in words], "w string"))
    for w in forms:
        assert {r.word for r in T.drop_terms(df, w, drop_na=False).collect()} == {"b", None}
        assert {r.word for r in T.drop_terms(df, w).collect()} == {"b"}


def test_three_million_terms_never_meet_the_driver(spark):
    """The vocabulary is numbered, joined and fitted on the executors."""
    n = 3_000_000
    words = spark.range(n).select(F.concat(F.lit("w"), "id").alias("word"), F.col("id"))
    counts = words.select((F.col("id") % 40).alias("doc_id"), "word", F.lit(1).alias("n")).union(
        words.filter("id < 90").select((F.col("id") % 40 + 40).alias("doc_id"), "word", F.lit(2).alias("n")))
    vec, vocab = TO.count_vectors(counts, "doc_id")
    r = vocab.agg(F.count("*").alias("n"), F.min("term_index").alias("lo"), F.max("term_index").alias("hi"),
                  F.count_distinct("term_index").alias("d")).first()
    assert (r.n, r.lo, r.hi, r.d) == (n, 0, n - 1, n)
    ids = {t.term: t.term_index for t in vocab.filter("term in ('w0', 'w1', 'w10', 'w2')").collect()}
    assert ids["w0"] < ids["w1"] < ids["w10"] < ids["w2"]
    tf = vec.filter("doc_id = 41").first().tf
    assert tf.size == n and sorted(tf.indices) == list(tf.indices) and set(tf.values) == {2.0}
    model = TO.fit_topics(vec.filter("doc_id >= 40"), 2, max_iter=2)
    assert model.isDistributed()
    top = TO.topic_terms(model, vocab, 5).collect()
    assert len(top) == 10 and {x.rank for x in top} == set(range(1, 6))


def test_blocked_em_finds_the_topics_of_sparks_optimiser(spark, monkeypatch):
    from pyspark.ml.clustering import LDA
    from shoppulse.operators import topic_em
    from shoppulse.session import checkpoint_dir
    monkeypatch.setattr(topic_em, "BLOCK", 40)
    rows = [(d, f"w{(d * 7 + j * j) % 23}", 1 + (d + j) % 3) for d in range(60) for j in range(9)]
    counts = spark.createDataFrame(rows, "d long, word string, n long").groupBy("d", "word").agg(F.sum("n").alias("n"))
    vec, vocab = TO.count_vectors(counts, "d")
    checkpoint_dir(spark)
    models = topic_em.fit_em(vec, [2, 3, 4], seed=5, max_iter=6)
    for k, model in models.items():
        want = LDA(k=k, seed=5, maxIter=6, optimizer="em", featuresCol="tf").fit(vec).describeTopics(30).collect()
        got = model.describeTopics(30).collect()
        for a, b in zip(got, want):
            a, b = (dict(zip(x.termIndices, x.termWeights)) for x in (a, b))
            assert a.keys() == b.keys() and len(a) == 23
            assert all(abs(a[i] - b[i]) < 1e-9 for i in a)
    # one pass over the documents for all k: no graph of (document, term) pairs, no fit for each k
    alone = topic_em.fit_em(vec, [3], seed=5, max_iter=6)[3].describeTopics(5).collect()
    assert alone == models[3].describeTopics(5).collect()



def _odd_texts():
    texts = [(d, " ".join(f"W{'abcdefghijklmnopqrstuvwxyz'[(d * 7 + j * j) % 26]}é the" for j in range(d % 11))) for d in range(80)]
    texts += [(3, "wa wa only three"), (None, "wa wb"), (None, "wb the"), (200, None), (201, ""), (202, "the the"), (203, "12 rare")]
    return texts + [(300, "wa " * 70_000 + "wb")]


@pytest.mark.parametrize("chunk, min_df", [(1, 5), (40, 5), (1 << 19, 5), (40, 1), (40, 1000)])
def test_packed_counts_give_the_vectors_of_the_long_matrix(spark, monkeypatch, chunk, min_df):
    from shoppulse.operators import packed_counts
    monkeypatch.setattr(packed_counts, "CHUNK", chunk)
    df = spark.createDataFrame(_odd_texts(), "doc_id long, text string").repartition(5)
    long = T.tokenize(df, "doc_id", "text", pattern="[a-zé0-9]+", stopwords=["the"])
    packed = packed_counts.pack(T.tokenize(df, "doc_id", "text", pattern="[a-zé0-9]+", stopwords=["the"], lists=True), "doc_id", "word")
    want, terms = TO.count_vectors(TO.doc_term_matrix(long, "doc_id", "word", min_df), "doc_id")
    got, vocab = TO.count_vectors(TO.doc_term_matrix(packed, "doc_id", "word", min_df), "doc_id")
    assert sorted(vocab.collect()) == sorted(terms.collect())
    assert "12" not in {r.term for r in vocab.collect()}
    rows = {r.doc_id: r.tf for r in got.collect()}
    assert len(rows) == got.count() == want.count()
    assert rows == {r.doc_id: r.tf for r in want.collect()}
    assert sorted(T.term_frequency(packed.terms, n_col="n").collect()) == sorted(T.term_frequency(long).collect())
    # a list of a chunk's terms is gathered by term, no (document, term) pair
    assert packed.lists.count() <= packed_counts.BUCKETS * packed.chunks.count()


def test_text_keys_and_no_documents_packed(spark):
    from shoppulse.operators import packed_counts
    for rows in ([("b'x`", "u v u"), ("a", "v"), ("b'x`", "w")], []):
        df = spark.createDataFrame(rows, "`the doc` string, text string")
        packed = packed_counts.pack(T.tokenize(df, "the doc", "text", lists=True), "the doc", "word")
        vec, vocab = TO.count_vectors(TO.doc_term_matrix(packed, "the doc", "word", 1), "the doc")
        assert {r["the doc"]: r.tf.toArray().tolist() for r in vec.collect()} == ({"b'x`": [2, 1, 1], "a": [0, 1, 0]} if rows else {})
        assert vocab.count() == (3 if rows else 0)


def test_topics_read_the_text_once(spark, monkeypatch):
    from shoppulse.operators import text
    from shoppulse.plans import fixtures, q_models
    tokenized, long = [], []
    whole, matrix = text.tokenize, q_models.TP.doc_term_matrix
    monkeypatch.setattr(text, "tokenize", lambda *a, **b: tokenized.append(whole(*a, **b)) or tokenized[-1])
    monkeypatch.setattr(q_models.TP, "doc_term_matrix", lambda tokens, *a, **b: long.append(tokens) or matrix(tokens, *a, **b))
    docs = spark.createDataFrame(_odd_texts() * 2, "doc_id long, text string")
    monkeypatch.setattr(fixtures, "table", lambda *a: docs)
    out = q_models.topic_share(spark, "")
    assert [r.topic for r in out.orderBy("topic").collect()] == [1, 2, 3]
    # the words are counted from packed counts: no plan from here on makes them from the text again
    assert len(tokenized) == 1 and not hasattr(long[0], "rdd")
    assert "regexp_extract_all" not in out._jdf.queryExecution().toString()


def _shuffles(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    names = [files.apply(i).getName() for i in range(files.size())]
    return {x.split("_")[1] for x in names if x.startswith("shuffle_")}


def test_iterations_leave_no_shuffle_files(spark, monkeypatch):
    from pyspark.ml.linalg import Vectors
    from shoppulse.operators import topic_em
    from shoppulse.session import checkpoint_dir
    monkeypatch.setattr(topic_em, "BLOCK", 20)
    checkpoint_dir(spark)
    rows = [(d, Vectors.sparse(12, {(d + j) % 12: 1.0 + j for j in range(4)}) if d % 3 else
             Vectors.dense([float((d + j) % 3) for j in range(12)])) for d in range(40)]
    vec = spark.createDataFrame(rows, ["d", "tf"])
    before = _shuffles(spark)
    models = topic_em.fit_em(vec, [2, 3], seed=1, max_iter=5)
    assert len(_shuffles(spark) - before) <= 1  # that of counting the pairs; two for each iteration otherwise
    for model in models.values():
        for t in model.describeTopics(12).collect():
            assert sorted(t.termIndices) == list(range(12)) and abs(sum(t.termWeights) - 1) < 1e-9


def test_more_partitions_than_groups_give_the_same_topics(spark, monkeypatch):
    from pyspark import RDD
    from pyspark.ml.linalg import Vectors
    from shoppulse.operators import topic_em
    from shoppulse.session import checkpoint_dir
    monkeypatch.setattr(topic_em, "BLOCK", 20)
    checkpoint_dir(spark)
    rows = [(d, Vectors.sparse(12, {(d + j) % 12: 1.0 + j for j in range(4)})) for d in range(40)]
    vec = spark.createDataFrame(rows, ["d", "tf"])
    want = topic_em.fit_em(vec, [2], seed=1, max_iter=3)[2].describeTopics(12).collect()
    dealt = RDD.partitionBy
    monkeypatch.setattr(RDD, "partitionBy", lambda self, n, *a: dealt(self, max(n, 13), *a))
    assert topic_em.fit_em(vec, [2], seed=1, max_iter=3)[2].describeTopics(12).collect() == want


def test_random_start_in_pieces(monkeypatch):
    from shoppulse.operators import topic_em

    def java(seed, n):
        state, out = (seed ^ 0x5DEECE66D) & ((1 << 48) - 1), []
        for _ in range(n):
            bits = []
            for width in (26, 27):
                state = (state * 0x5DEECE66D + 0xB) & ((1 << 48) - 1)
                bits.append(state >> (48 - width))
            out.append(((bits[0] << 27) + bits[1]) * 2.0 ** -53)
        return out

    n = topic_em.DRAWS + 50
    want = java(7, 2 * n)
    assert topic_em.uniform(7, 0, 2 * n).tolist() == want
    assert topic_em.uniform(7, n, n).tolist() == want[n:]


def test_count_vectors_equal_the_matrix(spark):
    rows = [("a", "x", 2), ("a", "y", 1), ("b", "y", 4), ("c", "z", 1), ("c", "x", 1)]
    vec, vocab = TO.count_vectors(spark.createDataFrame(rows, "d string, word string, n long"), "d")
    assert [r.term for r in vocab.orderBy("term_index").collect()] == ["x", "y", "z"]
    assert {r.d: r.tf.toArray().tolist() for r in vec.collect()} == {"a": [2, 1, 0], "b": [0, 4, 0], "c": [1, 0, 1]}
    vec, vocab = TO.count_vectors(spark.createDataFrame([], "d string, word string, n long"), "d")
    assert vec.count() == vocab.count() == 0


def test_many_ranges_and_text_keys(spark):
    df = spark.range(6000).select((F.col("id") * 7919 % 6000).alias("k"))
    words = spark.range(500).select(F.concat(F.lit("it's\\"), F.md5(F.col("id").cast("string"))).alias("k"))
    rows = {r.k: r.row_idx for r in L.with_row_index(words, "k", ranges=16).collect()}
    assert [rows[k] for k in sorted(rows)] == list(range(500))
    got = {r.k: r.row_idx for r in L.with_row_index(df, "k", ranges=300).collect()}
    assert got == {k: k for k in range(6000)}


def test_row_index_splits_repeated_rows_and_orders_nulls_first(spark):
    rows = [(7, "same")] * 1500 + [(None, "n")] * 20 + [(k, f"v{k}") for k in range(1500)]
    df = spark.createDataFrame(rows, "k long, v string").repartition(6)
    out = sorted(L.with_row_index(df, "k", ranges=40).collect(), key=lambda r: r.row_idx)
    assert [r.row_idx for r in out] == list(range(len(rows)))
    assert [r.k for r in out] == [None] * 20 + sorted(k for k, _ in rows if k is not None)


def test_prefix_sums_of_crowded_keys(spark):
    """Most keys lie in a sliver of the span, so first-level cells are cut again."""
    keys = sorted({1e-9 * k for k in range(3000)} | {-50.0, 1.0, 4e6, 4e6 + 1e-3})
    df = spark.createDataFrame([(k, i % 7) for i, k in enumerate(keys)], "s double, n long").repartition(5)
    spark.sparkContext.setJobGroup("prefix", "")
    for inclusive in (False, True):
        plan = L.prefix_sums(df, "s", ["n"], inclusive, cells=16, cell_rows=50)
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup("prefix") or inclusive
        got = {r.s: r.n_before for r in plan.collect()}
        total = 0
        for i, k in enumerate(keys):
            assert got[k] == total + (i % 7 if inclusive else 0)
            total += i % 7
    spark.sparkContext._jsc.clearJobGroup()
    odd = spark.createDataFrame([(float("-inf"), 1), (2.0, 2), (float("inf"), 4), (float("nan"), 8)], "s double, n long")
    assert sorted(r.n_before for r in L.prefix_sums(odd, "s", ["n"]).collect()) == [0, 1, 3, 7]
    assert L.prefix_sums(odd.limit(0), "s", ["n"]).count() == 0


def test_areas_equal_pair_counting_and_build_no_job(spark):
    import random
    rng = random.Random(8)
    rows = [(rng.choice([0.5, 0.5, rng.random(), round(rng.random(), 1)]), int(rng.random() < .3)) for _ in range(700)]
    df = spark.createDataFrame(rows, "s double, label int")
    spark.sparkContext.setJobGroup("areas", "")
    roc, pr = ME.auc_roc(df, "s"), ME.auc_pr(df, "s")
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("areas")
    spark.sparkContext._jsc.clearJobGroup()
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    want = sum((p > n) + .5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert roc.first().auc == pytest.approx(want, rel=1e-12)
    assert pr.first().auc_pr == pytest.approx(ME.auc_evaluator(df, "s", metric="areaUnderPR"), rel=1e-9)


def test_single_file_export_is_one_file_or_an_error(spark, tmpdir_path):
    sinks.save_single_csv(spark.range(10), tmpdir_path + "/one", max_rows=10)
    assert len(glob.glob(tmpdir_path + "/one/part-*")) == 1
    with pytest.raises(ValueError):
        sinks.save_single_csv(spark.range(11), tmpdir_path + "/two", max_rows=10)


def test_parts_keep_their_order(spark, tmpdir_path):
    df = spark.range(400).select((F.col("id") * 37 % 400).alias("k")).repartition(5)
    sinks.write_parts(df, "k", 3, tmpdir_path + "/parts")
    for part in (1, 2, 3):
        for f in glob.glob(f"{tmpdir_path}/parts/part={part}/*.parquet"):
            rows = [r.k for r in spark.read.parquet(f).collect()]
            assert rows == sorted(rows)


def test_extraction_plans_run_no_job(spark, tmpdir_path):
    spark.createDataFrame([(1, "x")], "sku long, body string").write.parquet(tmpdir_path + "/bodies")
    spark.sparkContext.setJobGroup("plans", "")
    df = spark.read.parquet(tmpdir_path + "/bodies").repartition(3, "sku")
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup("plans"))
    T.extract_tags(df, "sku", "body")
    T.extract_qa(df, "sku", "body")
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("plans")) == before
    spark.sparkContext._jsc.clearJobGroup()
