"""The pipeline against its stages in plain Python."""

import llm_brute as B
import corpus_pipeline as P
from shoppulse.llm import quality_cnn, sentencepiece
from shoppulse.llm._labels import fold
from shoppulse.llm._spark import ship
from pyspark.sql import functions as F


def test_pipeline_equals_brute_force(spark):
    ship(spark)
    docs = spark.read.parquet(f"{B.SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{B.SMALL}/labels.parquet")
    model = quality_cnn.fit(docs, labels.filter(fold(F.col("doc_id"), 4) != 2))
    good = {r.doc_id for r in quality_cnn.score(docs, model).filter("score >= 0.7").collect()}
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect() if r.doc_id in good]
    lines = B.dedup_lines([(d, t) for d, t, _ in rows], short=True)
    rows = [(d, lines[(d, t)][0], s) for d, t, s in rows]
    heads = {c for _, c in B.classes([(d, B.shingle_set(t)) for d, t, _ in rows], B.similar)}
    rows = [r for r in rows if r[0] in heads]
    taken, _ = B.mix(rows)
    vocab = sentencepiece.pieces(sentencepiece.MODEL)
    text = {d: t for d, t, _ in rows}
    got = P.run(spark, B.SMALL).collect()
    assert sorted(r.doc_id for r in got) == sorted(d for d, n in taken.items() for _ in range(n))
    seen = set()
    for r in got:
        assert r.n_chars == len(text[r.doc_id]) and r.round_trip
        if r.doc_id not in seen and len(seen) < 12:
            assert list(r.token_ids) == B.viterbi(text[r.doc_id], vocab)
        seen.add(r.doc_id)


def test_stages_return_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{B.SMALL}/documents.parquet")
    for _, stage in P.STAGES[:-1]:
        out = stage(spark, docs, B.SMALL)
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]


def test_stages_take_odd_rows(spark):
    kind = spark.read.parquet(f"{B.SMALL}/documents.parquet").schema
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (None, "some text here", "en", "a", 14), (3, "some text here", "en", "b", 14),
            (3, "some text here", "en", "b", 14), (4, "x" * 9000, None, None, 9000)]
    for data in (rows, []):
        docs = spark.createDataFrame(data, kind)
        for _, stage in P.STAGES:
            assert stage(spark, docs, B.SMALL).count() <= 3 * len(data)
