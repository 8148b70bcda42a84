"""Pair rules equal brute force, whatever the size of a basket."""

import collections
import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from shoppulse.operators import rules as R


def brute(rows, min_support, min_confidence):
    baskets = collections.defaultdict(set)
    for b, x in rows:
        if b is not None and x is not None:
            baskets[b].add(x)
    n, one = len(baskets), collections.Counter(x for s in baskets.values() for x in s)
    two = collections.Counter(p for s in baskets.values() for p in itertools.permutations(sorted(s), 2))
    return {(x, y): (c / n, c / one[x], (c / one[x]) / (one[y] / n)) for (x, y), c in two.items()
            if c >= max(1, math.ceil(min_support * n)) and c / one[x] >= min_confidence}


@pytest.mark.parametrize("block", [2, 5, 128])
def test_pair_rules_equal_brute_force(spark, block):
    rng = random.Random(block)
    rows = [(b, f"i{int(rng.paretovariate(.7)) % 23}") for b in range(300) for _ in range(rng.randrange(1, 12))]
    rows += rows[:40] + [(None, "i1"), (7, None), (400, None)] + [(500, f"i{k}") for k in range(23)]
    df = spark.createDataFrame(rows, "b long, x string").repartition(5)
    for support, confidence in ((.05, .3), (0.0, 0.0), (.9, .1)):
        got = {(r.antecedent, r.consequent): tuple(r)[2:] for r in R.pair_rules(df, "b", "x", support, confidence, block=block).collect()}
        want = brute(rows, support, confidence)
        assert set(got) == set(want)
        assert all(got[k] == pytest.approx(v, rel=1e-12) for k, v in want.items())


def test_lists_of_a_basket_may_come_in_two_batches(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        rows = [(b, x) for b in range(40) for x in range(b % 5 + 4)]
        df = spark.createDataFrame(rows, "b long, x int")
        got = {(r.antecedent, r.consequent): tuple(r)[2:] for r in R.pair_rules(df, "b", "x", .1, .1, block=2).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = brute(rows, .1, .1)
    assert set(got) == set(want) and all(got[k] == pytest.approx(v) for k, v in want.items())


def test_basket_of_fifty_thousand_items(spark):
    """Its lists are spread over block pairs; nothing but frequent pairs is emitted."""
    big = spark.range(50_000).select(F.lit(0).cast("long").alias("b"), F.concat(F.lit("x"), "id").alias("x"))
    rest = spark.range(60_000).select((F.col("id") % 3000 + 1).alias("b"), F.concat(F.lit("x"), F.col("id") % 21).alias("x"))
    got = R.pair_rules(big.union(rest), "b", "x", 0.03, 0.0).collect()
    seen = collections.defaultdict(set)
    for k in range(60_000):
        seen[k % 3000 + 1].add(f"x{k % 21}")
    rows = [(b, x) for b, s in seen.items() for x in s] + [(0, f"x{k}") for k in range(21)]
    want = brute(rows, 0.03, 0.0)
    assert {(r.antecedent, r.consequent) for r in got} == set(want) and want
    assert all(r.lift == pytest.approx(want[r.antecedent, r.consequent][2]) for r in got)
    wide = R.pair_rules(spark.range(2).crossJoin(spark.range(3000).select(F.col("id").alias("x"))), "id", "x", 1.0, 0.0)
    assert wide.count() == 3000 * 2999


def test_pair_rules_of_an_empty_table(spark):
    assert R.pair_rules(spark.createDataFrame([], "b long, x string"), "b", "x").count() == 0
