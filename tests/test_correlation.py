"""Blocked correlations equal plain ones at every width, with nulls, constants and hot keys."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shoppulse.operators import correlation as C


def plain(rows, cols):
    """Pairwise-complete Pearson correlation of columns with None for null."""
    out = {}
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            if i == j:
                continue
            both = [(float(r[i]), float(r[j])) for r in rows if r[i] is not None and r[j] is not None]
            if len(both) < 2 or not all(map(math.isfinite, (v for p in both for v in p))):
                continue
            x, y = np.array(both).T
            if x.min() < x.max() and y.min() < y.max():
                out[a, b] = abs(np.corrcoef(x, y)[0, 1])
    return out


def agree(df, rows, cols, **options):
    got = {(r.level_0, r.level_1): r.corr_value for r in C.corr_pairs(df, cols, **options).collect()}
    want = plain(rows, cols)
    assert set(got) == set(want)
    for k, v in want.items():
        assert math.isclose(got[k], v, rel_tol=1e-9, abs_tol=1e-9), k
    return got


def odd_rows(width, n=400, seed=1):
    """Correlated columns far from zero, with nulls; c1 is constant where c0 is not null."""
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        r = [1e6 * (i % 3) + rng.random() * (i + 1) + (k % 5) * (i % 4) for i in range(width)]
        r = [None if rng.random() < .1 and i % 2 == 0 else v for i, v in enumerate(r)]
        r[1] = 123456.789 if r[0] is not None else 1.5 + k
        rows.append(tuple(r))
    return rows


@pytest.mark.parametrize("width,block", [(3, 48), (16, 48), (17, 48), (17, 5), (60, 48)])
def test_pairs_equal_plain_at_every_width(spark, width, block):
    cols = [f"c{i}" for i in range(width)]
    rows = odd_rows(width)
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in cols)).repartition(7)
    got = agree(df, rows, cols, block=block)
    assert ("c0", "c1") not in got and ("c1", "c0") not in got  # constant on the common rows only
    one_way = C.corr_pairs(df, cols, both_directions=False, block=block)
    assert sorted((r.level_0, r.level_1) for r in one_way.collect()) == sorted(k for k in got if cols.index(k[0]) < cols.index(k[1]))


def test_pairs_that_need_several_reads(spark, monkeypatch):
    monkeypatch.setattr(C, "HELD_PAIRS", 2)
    cols = [f"c{i}" for i in range(9)]
    rows = odd_rows(9)
    agree(spark.createDataFrame(rows, ", ".join(f"{c} double" for c in cols)), rows, cols, block=2)


def test_pairs_with_infinite_values_empty_and_single_tables(spark):
    rows = [(1.0, 2.0, float("nan"), 1), (2.0, float("inf"), 1.0, 2), (3.0, None, 2.0, 3), (4.0, None, 3.0, None), (None, 1.0, None, 7)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d int")
    agree(df, rows, ["a", "b", "c", "d"])
    assert C.corr_pairs(df.limit(0), ["a", "b"]).count() == 0
    assert C.corr_pairs(df, ["a"]).count() == 0
    assert C.corr_pairs(df.limit(1), ["a", "d"]).count() == 0


def test_moments_merge_far_from_the_common_mean(spark):
    """Values near 1e9 with a spread of 1 in one half, and near 0 in the other."""
    rows = [(1e9 + k % 3, 1e9 + (k % 3) * 2 + k % 2) if k < 300 else (float(k % 7), float(k % 5)) for k in range(600)]
    df = spark.createDataFrame(rows, "a double, b double").repartition(5)
    agree(df, rows, ["a", "b"])
    top = [r if k < 300 else (None, r[1]) for k, r in enumerate(rows)]  # common rows: the upper half alone
    agree(spark.createDataFrame(top, "a double, b double").repartition(5), top, ["a", "b"])


def plain_items(rows):
    items, terms = sorted({r[0] for r in rows}), sorted({r[1] for r in rows})
    m = np.zeros((len(items), len(terms)))
    for i, t, n in rows:
        m[items.index(i), terms.index(t)] += n
    out = {}
    with np.errstate(all="ignore"):
        r = np.corrcoef(m)
    for a, x in enumerate(items):
        for b, y in enumerate(items):
            if a != b and m[a].min() < m[a].max() and m[b].min() < m[b].max():
                out[x, y] = r[a, b]
    return out


@pytest.mark.parametrize("n_items,block,cells", [(6, 128, 1 << 21), (32, 128, 1 << 21), (33, 128, 1 << 21), (33, 4, 100), (33, 16, 1)])
def test_items_equal_plain_at_every_number(spark, n_items, block, cells):
    rng = random.Random(n_items + block)
    rows = [(f"s{i}", f"w{j}", rng.randrange(1, 9)) for i in range(n_items) for j in range(40) if j == 0 or rng.random() < .3]
    rows += [("s0", "w0", 5), ("s1", "only here", 10 ** 9)]
    df = spark.createDataFrame(rows + [(None, "w", 1), ("s0", None, 1)], "item string, term string, n long").repartition(6)
    got = {(r.SKU1, r.SKU2): r.correlation for r in C.item_correlation(df, "item", "term", block=block, cells=cells).collect()}
    want = plain_items(rows)
    assert set(got) == set(want)
    for k, v in want.items():
        assert math.isclose(got[k], v, rel_tol=1e-9, abs_tol=1e-9), k


def test_two_thousand_items(spark):
    """Every item uses the hot term; no list of items reaches the driver, and blocks without a common term count."""
    df = spark.range(2000).select(F.format_string("i%04d", "id").alias("item"), F.explode(F.array(
        F.lit("hot"), F.concat(F.lit("t"), F.col("id") % 50), F.concat(F.lit("u"), F.col("id") % 7))).alias("term"),
        (F.col("id") % 3 + 1).alias("n"))
    out = C.item_correlation(df, "item", "term").cache()
    assert out.count() == 2000 * 1999
    m = np.zeros((2000, 58))
    for k in range(2000):
        m[k, 0] = m[k, 1 + k % 50] = m[k, 51 + k % 7] = k % 3 + 1
    r = np.corrcoef(m)
    for row in out.sample(0.0005, seed=1).collect():
        assert math.isclose(row.correlation, r[int(row.SKU1[1:]), int(row.SKU2[1:])], rel_tol=1e-9, abs_tol=1e-9)


def test_items_of_an_empty_table(spark):
    df = spark.createDataFrame([], "item string, term string, n long")
    assert C.item_correlation(df, "item", "term").count() == 0
    one = spark.createDataFrame([("a", "t", 1), ("a", "u", 2)], "item string, term string, n long")
    assert C.item_correlation(one, "item", "term").count() == 0
