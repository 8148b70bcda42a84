"""Corpus preparation: the stages are applied to ``documents`` in order.

Documents that the quality classifier rejects go; lines within one edit of an
earlier line go, lines of fewer than 16 code points if they equal one; of each group of near-duplicates (five-word shingles, Jaccard
similarity 0.8 or more) the first document stays; sources are mixed to their
target weights, so a document then stands in as many rows as it is taken; the
rest is encoded as SentencePiece ids.

Each stage gets what its predecessor kept, written as Parquet and read again,
and returns the columns of ``documents``; the last one returns the encoded
documents.  ``n_chars`` follows a text that a stage changes.

Defined cases: a null text is scored as the empty one, loses no line, is near
nothing and, having no words, is never taken into the mix; nor is an empty one.
Null ids and sources are values of their own; repeated rows are copies in one
group of near-duplicates; texts of any length go through every stage whole; an
empty table gives an empty result; further columns of ``documents`` pass
unchanged up to the last stage.

``run`` has no SQL form: a trained network and an encoder take part.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from shoppulse.llm import line_dedup, mixing, ngram_join, quality_cnn, sentencepiece
from shoppulse.llm._spark import materialise, ship, spread_rows, table


def quality(spark, docs, sf_dir):
    ship(spark)
    return quality_cnn.keep_good(spread_rows(docs), table(spark, sf_dir, "labels"))


def lines(spark, docs, sf_dir):
    ship(spark)
    out = line_dedup.dedup_lines(docs, short=True).select(docs.columns)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), "n_chars"))
    return out


def near_duplicates(spark, docs, sf_dir):
    ship(spark)
    return ngram_join.first_of_each(docs)


def mix(spark, docs, sf_dir):
    return mixing.mixed_rows(docs)


def encode(spark, docs, sf_dir):
    ship(spark)
    return sentencepiece.encode(spread_rows(docs))


STAGES = [("quality", quality), ("line_dedup", lines), ("near_duplicates", near_duplicates), ("mix", mix),
          ("sentencepiece", encode)]

ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for k, (_name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs)
    return docs
