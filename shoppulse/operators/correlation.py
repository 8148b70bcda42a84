"""Correlation family: feature-pair correlations, item-pair correlations over
shared vocabulary, signed correlation weights, weighted-score labelling.

Pair statistics are blocked: columns (or items) are cut into blocks, every
pair of blocks is a key, tasks combine what they see of a block pair into one
partial result, and partial results are merged by key in streams.  No matrix
of all pairs is ever one row or one task's, none passes through the driver,
and the same route serves every width.
"""

from __future__ import annotations

from typing import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoppulse.operators.blocks import STATE, fold, state_batch
from shoppulse.operators.layout import with_row_index
from shoppulse.session import ship, written

#: Columns in one block of feature pairs, and block pairs that one task holds.
COLUMN_BLOCK, HELD_PAIRS = 48, 256
#: Squared mean over variance from which a pair's deviations are computed again about its own mean.
FAR = 1e5
#: Items in one block of item pairs, and cells of a task's dense term x item matrix.
ITEM_BLOCK, TERM_CELLS = 128, 1 << 21


# -------------------------------------------------------------- feature pairs --

#: Rows of a block pair's state, each a matrix: rows used, means, squared and
#: cross deviations, smallest and largest values, non-finite values met.
N, MEAN_A, MEAN_B, DEV_A, DEV_B, CROSS, LOW_A, LOW_B, HIGH_A, HIGH_B, BAD = range(11)


def _moments(x: np.ndarray, there: np.ndarray, y: np.ndarray, here: np.ndarray) -> np.ndarray:
    """State of all pairs of a column of ``x`` and one of ``y`` over their common non-null rows."""
    finite_x, finite_y = np.isfinite(x) & there, np.isfinite(y) & here
    mx, my = there.astype(float), here.astype(float)
    # moments about the batch's own column means: small sums, little cancellation
    centre = [np.divide(np.where(f, v, 0).sum(0), np.maximum(f.sum(0), 1)) for v, f in ((x, finite_x), (y, finite_y))]
    cx, cy = np.where(finite_x, x - centre[0], 0.0), np.where(finite_y, y - centre[1], 0.0)
    n = mx.T @ my
    safe = np.maximum(n, 1)
    sx, sy = cx.T @ my, mx.T @ cy
    out = np.empty((11, x.shape[1], y.shape[1]))
    out[N] = n
    out[MEAN_A], out[MEAN_B] = sx / safe + centre[0][:, None], sy / safe + centre[1][None, :]
    out[DEV_A], out[DEV_B] = (cx * cx).T @ my - sx * sx / safe, mx.T @ (cy * cy) - sy * sy / safe
    out[CROSS] = cx.T @ cy - sx * sy / safe
    # where the common rows lie far from the batch mean, digits were lost: centre those pairs on their own rows
    far = (sx * sx > FAR * safe * out[DEV_A]) | (sy * sy > FAR * safe * out[DEV_B])
    for i, j in zip(*np.nonzero(far)):
        both = there[:, i] & here[:, j]
        p, q = cx[both, i] - cx[both, i].mean(), cy[both, j] - cy[both, j].mean()
        out[DEV_A, i, j], out[DEV_B, i, j], out[CROSS, i, j] = p @ p, q @ q, p @ q
    out[BAD] = (there & ~finite_x).astype(float).T @ my + mx.T @ (here & ~finite_y).astype(float)
    # smallest and largest values on common rows: rows with the same nulls share them
    out[[LOW_A, LOW_B]], out[[HIGH_A, HIGH_B]] = np.inf, -np.inf
    pattern, of = np.unique(np.packbits(np.hstack([there, here]), axis=1), axis=0, return_inverse=True)
    order = np.argsort(of.ravel(), kind="stable")
    begin = np.searchsorted(of.ravel()[order], np.arange(len(pattern)))
    x, y = x[order], y[order]
    low = [np.minimum.reduceat(v, begin, axis=0) for v in (x, y)]
    high = [np.maximum.reduceat(v, begin, axis=0) for v in (x, y)]
    for k, row in enumerate(order[begin]):
        i, j = np.flatnonzero(there[row]), np.flatnonzero(here[row])
        if len(i) and len(j):
            cell = np.ix_(i, j)
            for at, f, v in ((LOW_A, np.minimum, low[0][k][i][:, None]), (LOW_B, np.minimum, low[1][k][j][None, :]),
                             (HIGH_A, np.maximum, high[0][k][i][:, None]), (HIGH_B, np.maximum, high[1][k][j][None, :])):
                out[at][cell] = f(out[at][cell], v)
    return out


def _merge_moments(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Moments of the union of two sets of rows (parallel formula)."""
    p, q = one.reshape(11, -1), two.reshape(11, -1)
    n = p[N] + q[N]
    share = q[N] / np.maximum(n, 1)
    da, db = q[MEAN_A] - p[MEAN_A], q[MEAN_B] - p[MEAN_B]
    weight = p[N] * share
    return np.stack([n, p[MEAN_A] + da * share, p[MEAN_B] + db * share,
                     p[DEV_A] + q[DEV_A] + da * da * weight, p[DEV_B] + q[DEV_B] + db * db * weight,
                     p[CROSS] + q[CROSS] + da * db * weight,
                     np.minimum(p[LOW_A], q[LOW_A]), np.minimum(p[LOW_B], q[LOW_B]),
                     np.maximum(p[HIGH_A], q[HIGH_A]), np.maximum(p[HIGH_B], q[HIGH_B]), p[BAD] + q[BAD]]).ravel()


def corr_pairs(df: DataFrame, cols: Sequence[str], absolute: bool = True,
               names: tuple[str, str, str] = ("level_0", "level_1", "corr_value"),
               both_directions: bool = True, block: int = COLUMN_BLOCK) -> DataFrame:
    """Long table of column-pair correlations: no self pairs, undefined
    pairs dropped, both directions, sorted descending by value then names.
    Always pairwise complete (a pair uses the rows where both are non-null).

    Every task keeps the co-moments of each pair (count, means, squared and
    cross deviations, smallest and largest values, all on the common rows) and
    merges them batch by batch with the parallel formula; Spark merges the
    tasks' states by block pair.  A column that is constant on the common rows
    is known exactly (smallest = largest) and gives no pair, nor does one with
    a NaN or infinite value there.  A table too wide for one task's memory is
    read once per ``HELD_PAIRS`` block pairs, each time only the columns
    needed."""
    ship(df.sparkSession)
    cols = list(cols)
    blocks = [list(range(i, min(i + block, len(cols)))) for i in range(0, len(cols), block)]
    pairs = [(a, b) for a in range(len(blocks)) for b in range(a, len(blocks))]
    a_name, b_name, value = names
    schema = f"`{a_name}` string, `{b_name}` string, `{value}` double"
    if len(cols) < 2:
        return df.sparkSession.createDataFrame([], schema)

    def task(chunk, used):
        def run(batches):
            held = {}
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = {k: batch.column(f"c{k}") for k in used}
                there = {k: np.ones(batch.num_rows, bool) if not v.null_count else v.is_valid().to_numpy(zero_copy_only=False)
                         for k, v in x.items()}
                x = {k: v.fill_null(0.0).to_numpy(zero_copy_only=False) for k, v in x.items()}
                for a, b in chunk:
                    one, two = ((np.stack([x[k] for k in blocks[s]], 1), np.stack([there[k] for k in blocks[s]], 1)) for s in (a, b))
                    new = _moments(*one, *two).ravel()
                    held[a, b] = _merge_moments(held[a, b], new) if (a, b) in held else new
            for (a, b), state in held.items():
                yield state_batch(a, b, state)
        return run

    parts = None
    for start in range(0, len(pairs), HELD_PAIRS):
        chunk = pairs[start:start + HELD_PAIRS]
        used = sorted({k for p in chunk for s in p for k in blocks[s]})
        part = df.select(*[F.col(cols[k]).cast("double").alias(f"c{k}") for k in used]).mapInArrow(task(chunk, used), STATE)
        parts = part if parts is None else parts.unionAll(part)

    def finish(a, b, state):
        s = state.reshape(11, len(blocks[a]), len(blocks[b]))
        with np.errstate(divide="ignore", invalid="ignore"):
            r = s[CROSS] / np.sqrt(s[DEV_A] * s[DEV_B])
        ok = (s[N] >= 2) & (s[LOW_A] < s[HIGH_A]) & (s[LOW_B] < s[HIGH_B]) & (s[BAD] == 0) & ~np.isnan(r)
        if a == b:
            ok &= np.triu(np.ones(ok.shape, bool), 1)
        i, j = np.nonzero(ok)
        left, right, r = [cols[blocks[a][k]] for k in i], [cols[blocks[b][k]] for k in j], r[i, j]
        r = np.abs(r) if absolute else r
        if both_directions:
            left, right, r = left + right, right + left, np.concatenate([r, r])
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array(left), pa.array(right), pa.array(r)], names=list(names))

    return fold(parts, _merge_moments, finish, schema).orderBy(F.col(value).desc(), F.col(a_name), F.col(b_name))


# ----------------------------------------------------------------- item pairs --

def item_correlation(counts: DataFrame, item: str, term: str, n: str = "n",
                     names: tuple[str, str, str] = ("SKU1", "SKU2", "correlation"),
                     block: int = ITEM_BLOCK, cells: int = TERM_CELLS) -> DataFrame:
    """Pearson correlation of every item pair over their term-count vectors
    (0 for a term an item never uses; one observation per distinct term):
    ``r = (V*Sxy - Sx*Sy) / sqrt((V*Sxx - Sx^2) * (V*Syy - Sy^2))``.

    A blocked Gram product: items are numbered inside Spark and their vectors
    cut into blocks of ``block`` items.  Tasks read the counts term by term;
    for a batch of terms (at most ``cells`` matrix cells) they add up the
    product of every two blocks that share a term, so a term of every item
    costs one row of the matrix and no item pairs.  Partial products are summed
    by block pair, exact for integer counts below 2^53 and in double, so a hot
    term cannot overflow.  Block pairs without a common term have product 0.
    Pairs with an item of constant counts are undefined and dropped."""
    ship(counts.sparkSession)
    a_name, b_name, value = names
    agg = counts.groupBy(F.col(item).cast("string").alias("item"), F.col(term).alias("term")).agg(F.sum(n).cast("double").alias("n"))
    agg = written(agg.filter("item IS NOT NULL AND term IS NOT NULL"))
    per_item = agg.groupBy("item").agg(F.sum("n").alias("sx"), F.sum(F.col("n") * F.col("n")).alias("sxx"))
    items = written(with_row_index(per_item, "item", "i"))
    top = items.count()
    terms = agg.agg(F.count_distinct("term").cast("double").alias("V"))
    last = (top - 1) // block
    at = agg.join(items.select("item", "i"), "item").select(
        "term", F.floor(F.col("i") / block).cast("int").alias("b"), (F.col("i") % block).cast("int").alias("k"), "n")

    def products(batches):
        held = {}
        most = max(1, cells // max(top, 1))  # terms in one batch

        def add(rows):
            term, b, k, n = rows  # ordered by term
            row = np.concatenate([[0], np.cumsum(term[1:] != term[:-1])]).astype(int)
            order = np.argsort(b, kind="stable")
            row, b, k, n = row[order], b[order], k[order], n[order]
            here, begin = np.unique(b, return_index=True)
            used = []
            for x, lo, hi in zip(here.tolist(), begin, [*begin[1:], len(b)]):
                full = np.zeros((row.max() + 1, block))
                full[row[lo:hi], k[lo:hi]] = n[lo:hi]
                used.append((x, full, np.bincount(row[lo:hi], minlength=len(full)) > 0))
            for p, (a, x, mx) in enumerate(used):
                for c, y, my in used[p:]:
                    both = mx & my
                    if both.any():
                        product = x[both].T @ y[both]
                        held[a, c] = held[a, c] + product if (a, c) in held else product

        def flush():
            for (a, c), product in held.items():
                yield state_batch(a, c, product)
            held.clear()

        def cut(rows, upto):
            return [x[:upto] for x in rows], [x[upto:] for x in rows]

        rest = None
        for batch in batches:
            rows = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("term", "b", "k", "n")]
            rest = rows if rest is None else [np.concatenate(z) for z in zip(rest, rows)]
            while len(rest[0]):
                change = np.flatnonzero(rest[0][1:] != rest[0][:-1]) + 1  # a term begins
                if len(change) < most:
                    break
                now, rest = cut(rest, change[most - 1])
                add(now)
                if len(held) > HELD_PAIRS:
                    yield from flush()
        if rest is not None and len(rest[0]):
            add(rest)
        yield from flush()

    dealt = at.repartition("term").sortWithinPartitions("term", "b")
    parts = dealt.mapInArrow(products, STATE)
    schema = f"`{a_name}` string, `{b_name}` string, `{value}` double"

    def total(a, b, state):
        yield state_batch(a, b, state)

    gram = fold(parts, np.add, total, STATE)
    tables = items.groupBy(F.floor(F.col("i") / block).cast("int").alias("b")).agg(
        F.sort_array(F.collect_list(F.struct("i", "item", "sx", "sxx"))).alias("of"))  # ``block`` items a row
    grid = tables.withColumn("c", F.explode(F.sequence("b", F.lit(max(last, 0)).cast("int")))) if top else tables.withColumn("c", F.col("b"))
    right = tables.select(F.col("b").alias("c"), F.col("of").alias("with"))
    every = (grid.join(right, "c").join(gram.select(F.col("a").alias("b"), F.col("b").alias("c"), "state"), ["b", "c"], "left")
             .crossJoin(F.broadcast(terms)))  # one row

    def pairs(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                b, c, V = (batch.column(x)[r].as_py() for x in ("b", "c", "V"))
                one, two = batch.column("of")[r].values, batch.column("with")[r].values
                (nx, sx, sxx), (ny, sy, syy) = ((t.field("item"), *(t.field(f).to_numpy() for f in ("sx", "sxx"))) for t in (one, two))
                raw = batch.column("state")[r]
                full = np.frombuffer(raw.as_buffer(), np.float64).reshape(block, block) if raw.is_valid else np.zeros((block, block))
                sxy = full[:len(sx), :len(sy)]
                den = np.sqrt(np.outer(V * sxx - sx * sx, V * syy - sy * sy))
                ok = den > 0
                if b == c:
                    ok &= ~np.eye(len(sx), dtype=bool)
                i, j = np.nonzero(ok)
                v = pa.array((V * sxy[i, j] - sx[i] * sy[j]) / den[i, j])
                left, right = nx.take(pa.array(i)), ny.take(pa.array(j))
                yield pa.RecordBatch.from_arrays([left, right, v], names=list(names))
                if b != c:
                    yield pa.RecordBatch.from_arrays([right, left, v], names=list(names))

    out = every.select("b", "c", "of", "with", "state", "V").mapInArrow(pairs, schema)
    return out.orderBy(F.col(value).desc(), F.col(a_name), F.col(b_name))


# ------------------------------------------------------------ signed weights --

def signed_weights(pairs: DataFrame, features: Sequence[str], pos_token: str, neg_token: str,
                   mode: str = "multiply", id1: str = "level_0", id2: str = "level_1",
                   corr: str = "corr_value") -> DataFrame:
    """Weight per feature from correlation pairs processed in descending
    correlation order (ties by id1, id2).  M = name contains ``pos_token``,
    F = contains ``neg_token``; the first matching case updates both names:

    ===========  ==================  ==================  ========  ========
    case         id1 (multiply)      id2 (multiply)      id1 add   id2 add
    ===========  ==================  ==================  ========  ========
    M1 & F2      +, x(1+c)           -, x(1+c)           +40c      -40c
    F1 & M2      -, x(1+c)           +, x(1+c)           -40c      +40c
    M1 & !F2     +, x(1+2c)          +, x(1+0.5c)        +70c      +40c
    F1 & !M2     -, x(1+2c)          -, x(1+0.5c)        -60c      -40c
    !M1 & F2     -, x(1+0.5c)        -, x(1+2c)          -40c      -60c
    !F1 & M2     +, x(1+0.5c)        +, x(1+2c)          +40c      +70c
    ===========  ==================  ==================  ========  ========

    A multiply update sets ``w = sign * |w * k|``, so the final weight is
    ``(sign of the last update) * product of k`` -- an ordinary aggregate
    (``exp(sum(ln k))`` and ``max_by(sign, order)``); add mode is a ``sum``.
    Features never updated keep 1 (multiply) or 0 (add)."""
    if mode not in ("multiply", "add"):
        raise ValueError(mode)
    c = F.col(corr)
    m1, f1 = F.col(id1).contains(pos_token), F.col(id1).contains(neg_token)
    m2, f2 = F.col(id2).contains(pos_token), F.col(id2).contains(neg_token)
    # Factors and summands of the six cases.
    # (condition, id1 sign, id1 factor mult, id2 sign, id2 factor mult, id1 add, id2 add)
    cases = [
        (m1 & f2, 1, 1.0, -1, 1.0, 40, -40),
        (f1 & m2, -1, 1.0, 1, 1.0, -40, 40),
        (m1 & ~f2, 1, 2.0, 1, 0.5, 70, 40),
        (f1 & ~m2, -1, 2.0, -1, 0.5, -60, -40),
        (~m1 & f2, -1, 0.5, -1, 2.0, -40, -60),
        (~f1 & m2, 1, 0.5, 1, 2.0, 40, 70),
    ]

    def pick(idx):
        expr = F.lit(None)
        for case in reversed(cases):
            expr = F.when(case[0], F.lit(case[idx])).otherwise(expr)
        return expr

    # a total order over rows: rank by (corr desc, id1, id2) -> larger = later
    order = F.struct((-c).alias("c"), F.col(id1), F.col(id2))
    base = pairs.select(id1, id2, c.alias("_c"), order.alias("_o"),
                        pick(1).alias("s1"), pick(2).alias("k1"), pick(3).alias("s2"),
                        pick(4).alias("k2"), pick(5).alias("a1"), pick(6).alias("a2"))
    base = base.filter(F.col("s1").isNotNull())
    upd = base.select(F.col(id1).alias("feature"), "_o", F.col("s1").alias("s"),
                      (1 + F.col("k1") * F.col("_c")).alias("k"), (F.col("a1") * F.col("_c")).alias("a")) \
        .unionByName(base.select(F.col(id2).alias("feature"), "_o", F.col("s2").alias("s"),
                                 (1 + F.col("k2") * F.col("_c")).alias("k"), (F.col("a2") * F.col("_c")).alias("a")))
    if mode == "multiply":
        w = upd.groupBy("feature").agg(
            (F.max_by("s", "_o") * F.exp(F.sum(F.log("k")))).alias("weight"))
        start = 1.0
    else:
        w = upd.groupBy("feature").agg(F.sum("a").alias("weight"))
        start = 0.0
    feats = pairs.sparkSession.createDataFrame([(f,) for f in features], "feature string")
    return feats.join(w, "feature", "left").select(
        "feature", F.coalesce(F.col("weight"), F.lit(start)).cast("double").alias("weight"))


def weights_to_map(weights: DataFrame) -> dict[str, float]:
    """Weights as a dict (one value per feature column: schema-sized)."""
    return {r["feature"]: r["weight"] for r in weights.collect()}


def apply_weights(df: DataFrame, weights: dict[str, float], keep: Sequence[str] = ()) -> DataFrame:
    """Multiply each weighted feature by its weight; drop weight-0 features;
    columns in ``keep`` pass through."""
    cols = [F.col(k) for k in keep]
    for f, w in weights.items():
        if f in keep or f not in df.columns or w == 0:
            continue
        cols.append((F.col(f).cast("double") * F.lit(float(w))).alias(f))
    return df.select(*cols)


def weighted_label(df: DataFrame, weights: dict[str, float], alpha: float = 0.5,
                   keep: Sequence[str] = ("user_pin",), score_col: str = "score",
                   label_col: str = "label_int") -> DataFrame:
    """Weights x features -> row total -> min-max over the table -> ``>= alpha``
    -> 0/1 label.  Weight-0 features drop out; evaluate the result with
    :func:`shoppulse.operators.metrics.classification_report`."""
    from shoppulse.operators.scoring import label_by_threshold, min_max, weighted_score
    scored = min_max(weighted_score(df, weights, score_col), score_col)
    return label_by_threshold(scored, score_col, alpha, label_col).select(*keep, score_col, label_col)
