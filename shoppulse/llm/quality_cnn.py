"""Quality classifier: a byte-level convolutional network trained and run in numpy.

The symbols of a text are its UTF-8 bytes, each marked if the six bytes from it
on have also begun within the 48 bytes before.  ``FILTERS`` learned filters of
``TAPS`` taps, ``DILATION`` apart, run over every position of the whole text; a
filter's response is max-pooled over chunks of 256 positions that overlap by
half, the chunks are pooled by maximum and by mean, and a logistic unit joins
both into one probability.  Training (Adam, gradients only through the maxima)
uses at most ``per_class`` labelled documents of each class and at most
``TRAIN_CHUNKS`` evenly spread chunks of each; classes are weighed by their
shares among all labels given.

Defined cases: null and empty texts are one chunk of padding and get the score
that the network gives that; labels without document or value are not used; a
table without labels of both classes gives every document the share of label 1
(0.5 without labels; ``keep_good`` then keeps all); repeated rows are scored alike; extra columns are not
read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._labels import class_counts, fold, sampled_texts
from ._text import mix64, text_slices

FILTERS, TAPS, DILATION = 16, 8, 2
REACH = (TAPS - 1) * DILATION
BLOCK = 128
CHUNK = 2 * BLOCK
PAD = 512
GRAM, NEAR = 6, 48
TRAIN_CHUNKS = 12
PER_CLASS = 1500
THRESHOLD = 0.7


def symbols(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bytes 0-255, plus 256 where the next ``GRAM`` bytes began within ``NEAR`` bytes before in the same row."""
    out = data.astype(np.int16)
    n = len(data) - GRAM + 1
    if n <= 1:
        return out
    key = np.zeros(n, np.uint64)
    for k in range(GRAM):
        key |= data[k:k + n].astype(np.uint64) << np.uint64(8 * k)
    key = (mix64(key) >> np.uint64(48)).astype(np.uint16)
    order = np.argsort(key, kind="stable")
    again = np.zeros(n, bool)
    again[1:] = (key[order[1:]] == key[order[:-1]]) & (order[1:] - order[:-1] <= NEAR)
    at, before = order[again], order[np.flatnonzero(again) - 1]
    row = np.searchsorted(offsets, at, "right")
    same = (offsets[row - 1] <= before) & (at + GRAM <= offsets[np.minimum(row, len(offsets) - 1)])
    out[at[same]] += 256
    return out


def start_taps(rng) -> np.ndarray:
    return (rng.standard_normal((TAPS, PAD + 1, FILTERS)) * 0.3).astype(np.float32)


class Network:
    def __init__(self, taps, bias, weight, offset):
        self.taps, self.bias, self.weight, self.offset = taps, bias, weight, offset

    def block_maxima(self, syms: np.ndarray) -> np.ndarray:
        """Largest response of every filter in every block of positions."""
        n = len(syms) - REACH
        out = np.empty((n // BLOCK, FILTERS), np.float32)
        step = 256 * BLOCK
        for a in range(0, n, step):
            b = min(n, a + step)
            total = self.taps[0].take(syms[a:b], axis=0)
            for k in range(1, TAPS):
                total += self.taps[k].take(syms[a + k * DILATION:b + k * DILATION], axis=0)
            out[a // BLOCK:b // BLOCK] = total.reshape(-1, BLOCK, FILTERS).max(axis=1)
        return np.maximum(out + self.bias, 0)

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Probability of label 1 for every row."""
        syms, first = padded(data, offsets)
        top = self.block_maxima(syms)
        lone = np.diff(first) == 1
        pair = np.maximum(top[:-1], top[1:]) if len(top) > 1 else top
        n = np.maximum(np.diff(first) - 1, 1)
        begin = first[:-1]
        high = np.empty((len(n), FILTERS), np.float32)
        mean = np.empty((len(n), FILTERS), np.float32)
        high[lone] = mean[lone] = top[begin[lone]]
        many = np.flatnonzero(~lone)
        if len(many):
            # pairs that straddle two rows are cut out by the bounds
            edges = np.stack((begin[many], begin[many] + n[many]), 1).ravel()
            edges = np.minimum(edges, len(pair) - 1)
            high[many] = np.maximum.reduceat(pair, edges, axis=0)[::2]
            sums = np.concatenate((np.zeros((1, FILTERS)), np.cumsum(pair, axis=0, dtype=np.float64)))
            last = begin[many] + n[many]
            mean[many] = (sums[last] - sums[begin[many]]) / n[many][:, None]
            tail = last - 1 == len(pair) - 1  # the clipped edge leaves out the last pair
            high[many[tail]] = np.maximum(high[many[tail]], pair[-1])
        z = np.concatenate((high, mean), axis=1) @ self.weight + self.offset
        return 1.0 / (1.0 + np.exp(-np.clip(z.astype(np.float64), -30, 30)))


def padded(data, offsets):
    """Symbols of every row in whole blocks: (symbols, first block).

    A row begins with as much padding as the taps reach, so the last positions of
    the row before look at padding only.
    """
    size = np.diff(offsets)
    blocks = np.maximum(1, -(-(size + REACH) // BLOCK))
    first = np.concatenate(([0], np.cumsum(blocks)))
    out = np.full(first[-1] * BLOCK + REACH, PAD, np.int16)
    shift = np.repeat(first[:-1] * BLOCK + REACH - offsets[:-1], size)
    out[np.arange(len(data)) + shift] = symbols(data, offsets)
    return out, first


def chunks_of(data: np.ndarray, offsets: np.ndarray, most: int = TRAIN_CHUNKS) -> list[np.ndarray]:
    """Up to ``most`` chunks of every row, evenly spread from its start to its end."""
    syms, first = padded(data, offsets)
    out = []
    for a, b in zip(first, first[1:]):
        n = max(1, b - a - 1)
        pick = np.unique(np.linspace(0, n - 1, min(n, most)).round().astype(int))
        take = (a + pick)[:, None] * BLOCK + np.arange(CHUNK + REACH)
        grid = syms[np.minimum(take, len(syms) - 1)]
        if b - a == 1:  # one block alone: nothing of the next row
            grid[:, BLOCK:] = PAD
        else:  # beyond the row's last block lies the next row
            grid[take >= b * BLOCK] = PAD
        out.append(grid)
    return out


def train(chunks: list[np.ndarray], labels: np.ndarray, weights: np.ndarray, epochs: int = 10,
          batch: int = 64, rate: float = 0.01, seed: int = 7) -> Network:
    """Fit the network by Adam on the weighted log loss."""
    rng = np.random.default_rng(seed)
    taps = start_taps(rng)
    bias = np.zeros(FILTERS, np.float32)
    weight = (rng.standard_normal(2 * FILTERS) * 0.1).astype(np.float32)
    offset = np.zeros(1, np.float32)
    params = [taps, bias, weight, offset]
    first = [np.zeros_like(p) for p in params]
    second = [np.zeros_like(p) for p in params]
    turn = 0
    for epoch in range(epochs):
        step_size = rate * (0.5 ** (epoch / 4))
        order = rng.permutation(len(chunks))
        for i in range(0, len(order), batch):
            rows = order[i:i + batch]
            grid = np.concatenate([chunks[r] for r in rows])
            owner = np.repeat(np.arange(len(rows)), [len(chunks[r]) for r in rows])
            begin = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            total = taps[0][grid[:, :CHUNK]]
            for k in range(1, TAPS):
                total += taps[k][grid[:, k * DILATION:k * DILATION + CHUNK]]
            where = total.argmax(axis=1)
            top = np.take_along_axis(total, where[:, None], axis=1)[:, 0] + bias
            act = np.maximum(top, 0)
            count = np.diff(np.append(begin, len(owner)))
            high = np.maximum.reduceat(act, begin, axis=0)
            mean = np.add.reduceat(act, begin, axis=0) / count[:, None]
            both = np.concatenate((high, mean), axis=1)
            z = both @ weight + offset
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            gz = ((p - labels[rows]) * weights[rows] / weights[rows].sum()).astype(np.float32)
            g_both = gz[:, None] * weight
            g_act = g_both[owner, FILTERS:] / count[owner][:, None]
            is_high = act == high[owner]
            g_act = g_act + np.where(is_high, g_both[owner, :FILTERS], 0)
            g_act = np.where(top > 0, g_act, 0).astype(np.float32)
            g_taps = np.zeros_like(taps)
            lines = np.arange(len(grid))[:, None]
            f = np.broadcast_to(np.arange(FILTERS), where.shape)
            for k in range(TAPS):
                sym = grid[lines, where + k * DILATION]
                flat = np.bincount((sym * FILTERS + f).ravel(), g_act.ravel(), (PAD + 1) * FILTERS)
                g_taps[k] = flat.reshape(PAD + 1, FILTERS)
            g_taps += 1e-5 * taps
            grads = [g_taps, g_act.sum(axis=0), both.T @ gz + 1e-4 * weight, gz.sum(keepdims=True)]
            turn += 1
            for p_, g, m, v in zip(params, grads, first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p_ -= step_size * (m / (1 - 0.9 ** turn)) / (np.sqrt(v / (1 - 0.999 ** turn)) + 1e-8)
    return Network(*params)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS):
    """A Network, or a constant probability if one class has no document."""
    shares = class_counts(labels, label)
    few = sampled_texts(docs, labels, label, per_class)

    def run(batches):
        for batch in batches:
            for i, j, off, data in text_slices(batch):
                grids = chunks_of(data, off)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, j - i), batch.column("label").slice(i, j - i),
                     pa.array([g.tobytes() for g in grids], pa.binary())], names=["doc_id", "label", "grid"])

    got = few.mapInArrow(run, "doc_id long, label int, grid binary").orderBy("doc_id", "grid").toArrow()
    y = got.column("label").to_numpy().astype(np.float32)
    if len(set(y.tolist())) < 2:
        total = sum(shares.values())
        return (shares.get(1, 0) / total) if total else 0.5
    chunks = [np.frombuffer(b, np.int16).reshape(-1, CHUNK + REACH) for b in got.column("grid").to_pylist()]
    total = sum(shares.values())
    each = np.where(y == 1, shares[1] / total / (y == 1).sum(), shares[0] / total / (y == 0).sum())
    return train(chunks, y, (each * len(y)).astype(np.float32))


def score(docs: DataFrame, model) -> DataFrame:
    """(doc_id, score) of every document, in the task that reads it."""
    if not isinstance(model, Network):
        return docs.select("doc_id", F.lit(float(model)).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed size: the filters

    def run(batches):
        for batch in batches:
            for i, j, off, data in text_slices(batch):
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, j - i), pa.array(shared.value.score(data, off))],
                    names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def keep_good(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 4, held: int = 2,
              per_class: int = PER_CLASS, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more, scored in the task that reads them."""
    model = fit(docs, labels.filter(fold(F.col("doc_id"), folds) != held), label, per_class)
    if not isinstance(model, Network):
        return docs  # nothing was learned: nothing is rejected
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for i, j, off, data in text_slices(batch, "row_text"):
                part = batch.column("row").slice(i, j - i)
                good = pa.array(shared.value.score(data, off) >= threshold)
                yield pa.RecordBatch.from_arrays([part.filter(good)], names=["row"])

    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("text").alias("row_text"))
    return rows.mapInArrow(run, T.StructType([rows.schema["row"]])).select("row.*")


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 4, held: int = 2,
             per_class: int = PER_CLASS) -> DataFrame:
    """doc_id, held_out, score, predicted; labels of the held-out fold are not used."""
    model = fit(docs, labels.filter(fold(F.col("doc_id"), folds) != held), label, per_class)
    return (score(docs, model)
            .withColumn("held_out", fold(F.col("doc_id"), folds) == held)
            .withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
            .select("doc_id", "held_out", "score", "predicted"))
