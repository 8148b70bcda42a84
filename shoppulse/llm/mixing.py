"""Mixing sources to target weights by capped water-filling (DataFrame functions only).

``mix(docs, ...)`` sizes every document in words, gives each source a target
share of the total by its weight, caps the target at ``max_epochs`` times the
source's own size and reshares the excess by weight until no source is above
its cap.  A source with target t and size s is then taken floor(t/s) whole
times, and the rest of t as a seeded sample of whole documents: in the order
of a hash, documents are taken while the running word count stays nearer to
the rest than without them.

Defined cases: a null text has size 0 and is never repeated or sampled in (its
``taken`` is 0); a null source is a source of its own, last; an empty table
gives an empty result; repeated rows are rows of their own (which of several
identical rows is taken does not change the result); extra columns are not
read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._spark import materialise

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = 17
#: Hex digits of the hash in the first and second histogram of the sampling cut.
COARSE, FINE = 3, 6


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _ranked_sources(sizes: DataFrame) -> DataFrame:
    """Number the sources by code point, null last, without one task seeing them all.

    Sources are range-partitioned once and written with their partition number;
    only the per-partition counts (one row a partition) are summed in order.
    """
    named = (sizes.withColumn("is_null", F.col("source").isNull())
             .repartitionByRange("is_null", "source")
             .withColumn("part", F.spark_partition_id()))
    named = materialise(named)
    before = (named.groupBy("part").count()
              .withColumn("before", F.coalesce(F.sum("count").over(
                  Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
              .select("part", "before"))
    return (named.join(before, "part")
            .withColumn("rank", F.col("before") + F.row_number().over(
                Window.partitionBy("part").orderBy("is_null", "source")) - 1)
            .drop("part", "before", "is_null"))


def targets(sizes: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``sizes(source, source_size)`` -> the same with ``target`` (double).

    Each round clamps every source whose share is above its cap; shares only
    grow, so a clamped source stays clamped.  A round is one small aggregate of
    the source table and moves two sums to the driver.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                          (F.col("rank") % len(weights) + 1).cast("int"))
    table = materialise(_ranked_sources(sizes)
                        .withColumn("weight", weight)
                        .withColumn("cap", (F.col("source_size") * max_epochs).cast("double")))
    total = table.agg(F.sum("source_size")).first()[0] or 0
    rest, open_weight, above = float(total), None, F.lit(False)
    while True:
        row = table.filter(~above).agg(F.sum("weight"), F.count("*")).first()
        clamped = table.filter(above).agg(F.sum("cap")).first()[0] or 0.0
        rest, now = float(total) - clamped, row[0]
        if now is None or now == open_weight:
            break
        open_weight = now
        above = F.col("weight") * F.lit(rest) / F.lit(open_weight) > F.col("cap")
    share = F.col("weight") * F.lit(rest) / F.lit(open_weight or 1.0)
    return table.select("source", "source_size",
                        F.when(above, F.col("cap")).otherwise(share).alias("target"))


def _cut(rows: DataFrame, digits: int, key: str) -> DataFrame:
    """The hash prefix of ``digits`` digits in which a source's sample ends, and the words before it."""
    bins = (rows.withColumn("bin", F.substring("h", 1, digits))
            .groupBy("sid", "rest", "prior", "bin").agg(F.sum("size").alias("words")))
    run = F.sum("words").over(Window.partitionBy("sid").orderBy("bin"))
    bins = bins.withColumn("upto", F.col("prior") + run)
    return (bins.filter(F.col("upto") >= F.col("rest")).groupBy("sid")
            .agg(F.min(F.struct("bin", (F.col("upto") - F.col("words")).alias("before"))).alias("c"))
            .select("sid", F.col("c.bin").alias(key), F.col("c.before").alias("before")))


def mix(docs: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """One row per document: doc_id, size, source, source_size, target, repeats, taken.

    The sample of a source ends inside one hash bin; two histograms find that
    bin, and only its documents are ordered in a window, so a source holding a
    third of all documents needs no task of its own.
    """
    sized = materialise(docs.select(
        "doc_id", "source", word_count(F.col("text")).alias("size"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("h")))
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = targets(sizes, weights, max_epochs)
    # the number of whole passes; the rest is what a sample has to reach
    goal = materialise(goal.withColumn("sid", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")))
                       .withColumn("whole", F.when(F.col("source_size") > 0, F.floor(
                           F.col("target") / F.col("source_size"))).otherwise(F.lit(0)))
                       .withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
                       .withColumnRenamed("source", "g_source"))
    rows = sized.join(goal, sized.source.eqNullSafe(goal.g_source)).drop("g_source")
    rows = materialise(rows)
    plain = rows.withColumn("prior", F.lit(0).cast("long"))
    coarse = materialise(_cut(plain, COARSE, "coarse"))
    inside = (plain.drop("prior").join(coarse, "sid").filter(F.substring("h", 1, COARSE) == F.col("coarse"))
              .withColumn("prior", F.col("before")).drop("before", "coarse"))
    fine = materialise(_cut(inside, FINE, "fine"))
    edge = (rows.join(fine, "sid").filter(F.substring("h", 1, FINE) == F.col("fine"))
            .withColumn("upto", F.col("before") + F.sum("size").over(
                Window.partitionBy("sid").orderBy("h", "doc_id", "size")
                .rowsBetween(Window.unboundedPreceding, 0))))
    edge = materialise(edge)
    # below the bin: in; above: out; inside: in while the middle of the document is within the rest
    ends = fine.select("sid", "fine")
    middle = F.col("upto") - F.col("size") / F.lit(2.0)
    edge = edge.withColumn("extra", (middle <= F.col("rest")).cast("long"))
    other = (rows.join(ends, "sid", "left")
             .filter(F.col("fine").isNull() | (F.substring("h", 1, FINE) != F.col("fine")))
             .withColumn("extra", F.when(F.col("fine").isNull(), F.lit(0))
                         .otherwise((F.substring("h", 1, FINE) < F.col("fine")).cast("int")).cast("long")))
    cols = ["doc_id", "source", "size", "source_size", "target", "whole", "extra"]
    every = other.select(cols).union(edge.select(cols))
    repeats = F.when(F.col("size") > 0, F.least(F.col("whole") + F.col("extra"), F.lit(max_epochs))).otherwise(F.lit(0))
    return (every.withColumn("repeats", repeats.cast("long"))
            .withColumn("taken", F.col("size") * F.col("repeats"))
            .select("doc_id", "size", "source", "source_size", "target", "repeats", "taken"))


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents: every row repeated as often as it is taken, the others gone."""
    taken = mix(docs, **options).select("doc_id", "source", "size", "repeats").distinct()
    taken = taken.groupBy("doc_id", "source", "size").agg(F.max("repeats").alias("mix_repeats"))
    t = taken.select(F.col("doc_id").alias("mix_id"), F.col("source").alias("mix_source"),
                     F.col("size").alias("mix_size"), "mix_repeats")
    src = docs.withColumn("mix_words", word_count(F.col("text")))
    on = (src.doc_id.eqNullSafe(t.mix_id) & src.source.eqNullSafe(t.mix_source) & (src.mix_words == t.mix_size))
    out = (src.join(t, on).filter("mix_repeats > 0")
           .withColumn("mix_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("mix_repeats")))))
    return out.select(*docs.columns)
