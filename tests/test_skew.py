"""Operators stay exact on skewed input: one document holds a third of all
tokens, one source a third of all documents, one word a third of all
occurrences.  Results are compared with a brute-force pandas computation."""

import math
import random
import re
from collections import Counter

import pandas as pd

from shoppulse.operators import correlation as C
from shoppulse.operators import text as T

VOCAB = [f"w{a}{b}" for a in "abcdef" for b in "abcdefghij"]  # letters only: one token each


def _skewed_docs():
    rnd = random.Random(11)
    docs = []
    for d in range(150):
        n = 20 + rnd.randint(0, 30)
        words = [("hot" if rnd.random() < 0.33 else rnd.choice(VOCAB)) for _ in range(n)]
        src = "s0" if d % 3 == 0 else f"s{1 + d % 5}"
        docs.append((d, src, " ".join(words)))
    total = sum(len(t.split()) for _, _, t in docs)
    big = [rnd.choice(VOCAB + ["hot"]) for _ in range(total // 2)]  # ~1/3 of all tokens
    docs.append((999, "s0", " ".join(big)))
    return docs


def test_tf_idf_top_terms_under_skew(spark):
    docs = _skewed_docs()
    df = spark.createDataFrame(docs, "doc_id long, source string, text string").repartition(5)
    counts = T.doc_term_counts_from_text(df, "doc_id", "text")
    scored = T.tf_idf(counts, "doc_id", "word", "n", doc_total_col="doc_n")
    got = {(r.doc_id, r.word): r.tf_idf for r in T.top_terms(scored, "doc_id", "tf_idf", 3).collect()}
    # brute force
    per_doc = {d: Counter(t.split()) for d, _, t in docs}
    n_docs = len(per_doc)
    dfreq = Counter(w for c in per_doc.values() for w in c)
    want = {}
    for d, c in per_doc.items():
        tot = sum(c.values())
        s = {w: (k / tot) * math.log(n_docs / dfreq[w]) for w, k in c.items()}
        cut = sorted(s.values(), reverse=True)[:3][-1]
        for w, v in s.items():
            if v >= cut:
                want[(d, w)] = v
    assert set(got) == set(want)
    for k, v in want.items():
        assert math.isclose(got[k], v, rel_tol=1e-12, abs_tol=1e-15)


def test_item_correlation_under_skew(spark):
    docs = _skewed_docs()
    df = spark.createDataFrame(docs, "doc_id long, source string, text string").repartition(4)
    toks = T.tokenize(df, "source", "text")
    counts = toks.groupBy("source", "word").count().withColumnRenamed("count", "n")
    got = {(r.SKU1, r.SKU2): r.correlation for r in C.item_correlation(counts, "source", "word").collect()}
    rows = [(s, w) for _, s, t in docs for w in t.split()]
    m = pd.DataFrame(rows, columns=["s", "w"]).value_counts().unstack(0, fill_value=0)
    corr = m.corr()  # Pearson over the vocabulary, 0 where an item lacks a term
    for (a, b), v in got.items():
        assert math.isclose(v, corr.loc[a, b], rel_tol=1e-9, abs_tol=1e-12)
    assert len(got) == len(m.columns) * (len(m.columns) - 1)


def test_frequent_terms_are_not_shuffled_to_their_frequency(spark, monkeypatch):
    monkeypatch.setattr(T, "FREQUENT", 0.5)  # "hot" is frequent, most words are not
    docs = [(d, f"hot hot w{'abcdefghij'[d % 10]}" + (" rare" if d % 7 == 0 else "")) for d in range(40)]
    docs += [(3, "hot hot wd"), (None, "hot only"), (41, None), (42, "")]  # a repeated row, a null key, no words
    df = spark.createDataFrame(docs, "doc_id long, text string")
    scored = T.tf_idf(T.doc_term_counts_from_text(df, "doc_id", "text"), "doc_id", "word", "n", doc_total_col="doc_n")
    counts = Counter()
    for d, t in docs:
        words = (t or "").split()
        for w in words:
            counts[d, w, len(words)] += 1
    dfreq, n_docs = Counter(w for _, w, _ in counts), 40
    want = {(d, w): (n, n / total * math.log(n_docs / dfreq[w])) for (d, w, total), n in counts.items()}
    got = {(r.doc_id, r.word): (r.n, r.tf_idf) for r in scored.collect()}
    assert got.keys() == want.keys()
    assert all(got[k][0] == n and math.isclose(got[k][1], x, rel_tol=1e-12, abs_tol=1e-15) for k, (n, x) in want.items())
    plan = scored._jdf.queryExecution().executedPlan().toString()
    # the words are dealt by document and the counts have no exchange of their own
    assert "LeftAnti, BuildRight" in plan
    assert re.search(r"hashpartitioning\(doc_id#\d+L, \d", plan) and not re.search(r"hashpartitioning\(doc_id#\d+L, word", plan)
