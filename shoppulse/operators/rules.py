"""Association rules over baskets.

:func:`pair_rules` counts item pairs only, the rules of the reference's report:
items below the support are pruned first, the others are numbered, and a
basket becomes vertical lists of at most ``block`` items.  Every two lists of a
basket meet under their pair of blocks, where tasks add up the product of the
basket x item matrices; no item pair of a basket is ever a row, and a basket of
any size is spread over its block pairs.  :func:`association_rules` mines
itemsets of any length with Spark ML's FP-growth, whose baskets are rows of
distinct items.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoppulse.operators.blocks import STATE, STREAMS, fold, state_batch
from shoppulse.operators.layout import with_row_index
from shoppulse.session import ship, written

#: Items in one list of a basket, and baskets in one matrix of a task.
ITEM_BLOCK, BASKET_ROWS = 128, 4096


def baskets(df: DataFrame, id_col: str, item_col: str, out_col: str = "items") -> DataFrame:
    """One row per transaction with its distinct, non-null items."""
    return (df.filter(F.col(item_col).isNotNull())
              .groupBy(id_col).agg(F.array_sort(F.collect_set(item_col)).alias(out_col)))


def association_rules(df: DataFrame, id_col: str, item_col: str, min_support: float = 0.8,
                      min_confidence: float = 0.1, num_partitions: int | None = None):
    """``(frequent itemsets, rules)`` with rules ``antecedent, consequent,
    confidence, lift, support`` sorted by confidence (then lift, support).
    Single-item consequents; empty antecedents never occur."""
    from pyspark.ml.fpm import FPGrowth
    b = baskets(df, id_col, item_col)
    fp = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence)
    if num_partitions:
        fp = fp.setNumPartitions(num_partitions)
    model = fp.fit(b)
    rules = model.associationRules.orderBy(F.col("confidence").desc(), F.col("lift").desc(),
                                           F.col("support").desc())
    return model.freqItemsets, rules


def _pair_counts(lists: DataFrame, block: int, least: int) -> DataFrame:
    """``(i, j, n)``: baskets with both items i < j, where at least ``least``.

    ``lists(p, q, b, ks)`` in the order (p, q, basket, b): the lists ``ks`` of
    blocks b = p and b = q of one basket follow each other; p = q has one."""

    def product(p, q, ks, sizes):
        lists_each = 1 if p == q else 2
        row = np.repeat(np.arange(len(sizes)) // lists_each, sizes)
        right = np.repeat(np.arange(len(sizes)) % lists_each == lists_each - 1, sizes)
        out = np.zeros((block, block))
        for lo in range(0, len(sizes) // lists_each, BASKET_ROWS):
            here = (row >= lo) & (row < lo + BASKET_ROWS)
            sides = []
            for side in (~right if p != q else right, right):
                m = np.zeros((BASKET_ROWS, block), np.float32)  # its sums stay below 2**24
                m[row[here & side] - lo, ks[here & side]] = 1
                sides.append(m)
            out += sides[0].T @ sides[1]
        return out

    def run(batches):
        held, total, rest = None, None, None
        for batch in batches:
            if rest is not None:
                batch = pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
            n = batch.num_rows
            p, q, b = (batch.column(c).to_numpy() for c in "pqb")
            # the list of the other block comes with the next batch
            rest = batch.slice(n - 1) if n and p[-1] != q[-1] and b[-1] == p[-1] else None
            n -= rest is not None
            lists = batch.column("ks").slice(0, n)
            ks, sizes = lists.flatten().to_numpy(), lists.value_lengths().to_numpy()
            ends = np.concatenate([[0], np.cumsum(sizes)])
            cut = np.flatnonzero((p[1:n] != p[:n - 1]) | (q[1:n] != q[:n - 1])) + 1 if n else []
            for lo, hi in zip([0, *cut], [*cut, n]) if n else []:
                if held is not None and (p[lo], q[lo]) != held:
                    yield state_batch(*held, total)
                    held = None
                part = product(p[lo], q[lo], ks[ends[lo]:ends[hi]], sizes[lo:hi])
                total = part if held is None else total + part
                held = int(p[lo]), int(q[lo])
        if held is not None:
            yield state_batch(*held, total)

    def finish(p, q, state):
        n = state.reshape(block, block)
        i, j = np.nonzero((np.triu(n, 1) if p == q else n) >= least)
        if len(i):
            yield pa.RecordBatch.from_arrays([pa.array(i + p * block), pa.array(j + q * block), pa.array(n[i, j].astype(np.int64))],
                                             names=["i", "j", "n"])

    return fold(lists.mapInArrow(run, STATE), np.add, finish, "i long, j long, n long")


def pair_rules(df: DataFrame, id_col: str, item_col: str, min_support: float = 0.8, min_confidence: float = 0.1,
               block: int = ITEM_BLOCK) -> DataFrame:
    """Rules with one item on each side: ``antecedent, consequent, support,
    confidence, lift``, for pairs in at least ``ceil(min_support * N)`` of the
    N baskets (repeated items count once, null items not at all)."""
    ship(df.sparkSession)
    seen = written(df.filter(F.col(item_col).isNotNull() & F.col(id_col).isNotNull())
                   .select(F.col(id_col).alias("id"), F.col(item_col).alias("item")).distinct())
    total = seen.agg(F.count_distinct("id")).first()[0]
    least = max(1, math.ceil(min_support * total))
    frequent = seen.groupBy("item").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") >= least)
    items = written(with_row_index(frequent, "item", "i"))
    parts = written(seen.join(items.select("item", "i"), "item")
                    .groupBy("id", F.floor(F.col("i") / block).cast("int").alias("b"))
                    .agg(F.collect_list((F.col("i") % block).cast("int")).alias("ks")))  # at most ``block`` items
    of = parts.groupBy("id").agg(F.collect_list("b").alias("bs"))  # one number per block of frequent items
    met = (parts.join(of, "id").withColumn("o", F.explode("bs"))
           .select(F.least("b", "o").alias("p"), F.greatest("b", "o").alias("q"), "id", "b", "ks"))
    dealt = met.repartition(F.col("p"), F.col("q"), F.pmod(F.xxhash64("id"), F.lit(STREAMS))) \
        .sortWithinPartitions("p", "q", "id", "b")
    pairs = _pair_counts(dealt.select("p", "q", "b", "ks"), block, least)
    one = items.select(F.col("i").alias("xi"), F.col("item").alias("x"), F.col("c").alias("cx"))
    two = items.select(F.col("i").alias("yi"), F.col("item").alias("y"), F.col("c").alias("cy"))
    both = pairs.select("i", "j", "n").union(pairs.select("j", "i", "n"))
    ruled = both.join(one, F.col("i") == F.col("xi")).join(two, F.col("j") == F.col("yi"))
    confidence = F.col("n") / F.col("cx")
    return (ruled.select(F.col("x").alias("antecedent"), F.col("y").alias("consequent"), (F.col("n") / F.lit(total)).alias("support"),
                         confidence.alias("confidence"), (confidence / (F.col("cy") / F.lit(total))).alias("lift"))
            .filter(F.col("confidence") >= min_confidence))


def rules_table(rules: DataFrame, sep: str = ",") -> DataFrame:
    """Rules with the antecedent as a sorted, ``sep``-joined string."""
    return rules.select(F.array_join(F.array_sort("antecedent"), sep).alias("antecedent"),
                        F.col("consequent")[0].alias("consequent"),
                        F.size("antecedent").alias("lhs_size"), "support", "confidence", "lift")
