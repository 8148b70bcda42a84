"""Bounded training samples of labelled documents, and the folds of the queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds`` (a null id counts as empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def class_counts(labels: DataFrame, label: str) -> dict:
    return {int(r[0]): r[1] for r in one_per_id(labels, label).groupBy("label").count().collect()}


def one_per_id(labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, label); repeated rows count once, contradicting ones as 1; nulls are left out."""
    return (labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
            .groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("label")))


def sample(labels: DataFrame, label: str, per_class: int) -> DataFrame:
    """At most ``per_class`` rows of each class, those with the smallest id hashes."""
    rows = one_per_id(labels, label).withColumn("h", F.xxhash64("doc_id"))
    parts = [rows.filter(F.col("label") == c).orderBy("h", "doc_id").limit(per_class) for c in (0, 1)]
    return parts[0].union(parts[1]).select("doc_id", "label")


def sampled_texts(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> DataFrame:
    """(doc_id, text, label) of the sample; its ids number 2 * per_class at most, so they are broadcast."""
    few = sample(labels, label, per_class).withColumnRenamed("doc_id", "label_id")
    d = docs.select("doc_id", "text")
    return d.join(F.broadcast(few), d.doc_id == few.label_id).select("doc_id", "text", "label")
