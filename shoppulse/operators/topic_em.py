"""EM topic model (LDA by maximum a posteriori) over blocks of documents.

The updates, priors (``50/k + 1`` and ``1.1``) and random start are those of Spark
ML's EM optimiser, so both find the same topics; what differs is what is shuffled.
Spark's optimiser sends a vector of topics for every (document, term) pair to the
pair's document and term in every iteration.  Here the pairs are packed into
blocks that are dealt to groups once and cached there, next to the topic counts
of their documents; an iteration shuffles one vector for each term of a group,
to the task that adds up the term over all groups, and the sum back.  The files of
both shuffles are removed as soon as the iteration is done.

Nothing passes through the driver but the number of terms.  A task holds the terms
of its group and one block at a time; fits for several k share one pass as long as
their term tables stay below ``TABLE`` numbers, so an iteration has at most twice
that on disk for each group.  Documents without a term are in no block, as in
Spark's optimiser.
"""

from __future__ import annotations

import functools
from typing import Iterable, Sequence

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoppulse.session import frugal, ship, written

BLOCK = 1 << 17   # pairs of a block
SLICE = 1 << 14   # pairs of a block's documents that are shared out at a time, about
GROUP = 1 << 25   # pairs of a group, about
TABLE = 1 << 22   # numbers in the term tables of one pass
ETA = 0.1         # topic concentration 1.1, less one
# Java's generator, which Spark draws its start from
FACTOR, ADD, MASK = 0x5DEECE66D, 0xB, (1 << 48) - 1
DRAWS = 1 << 14   # doubles drawn at a time


def _place(key: int) -> int:
    return key


@functools.cache
def _jumps():
    """Factors and summands of the generator's next ``2 * DRAWS`` states."""
    factors = np.multiply.accumulate(np.full(2 * DRAWS, FACTOR, np.uint64))
    return factors, np.cumsum(np.concatenate((np.ones(1, np.uint64), factors[:-1])), dtype=np.uint64) * np.uint64(ADD)


def uniform(seed: int, skip: int, n: int) -> np.ndarray:
    """The ``n`` doubles that ``java.util.Random(seed)`` draws after its first ``skip``."""
    jump = pow(FACTOR, 2 * skip, (MASK + 1) * (FACTOR - 1))  # two states a double
    state = (((seed ^ FACTOR) & MASK) * jump + (jump - 1) // (FACTOR - 1) * ADD) & MASK
    factors, summands = _jumps()
    out = np.empty(n)
    for lo in range(0, n, DRAWS):
        states = factors[:2 * (n - lo)] * np.uint64(state)
        states += summands[:len(states)]
        states &= np.uint64(MASK)
        out[lo:lo + DRAWS] = (states[0::2] >> np.uint64(22) << np.uint64(27)) + (states[1::2] >> np.uint64(21))
        state = int(states[-1])
    out *= 2.0 ** -53
    return out


def _least(x: np.ndarray) -> np.ndarray:
    """The numbers in the smallest type that holds them as they are."""
    for kind in (np.uint8, np.uint16, np.float32):
        small = x.astype(kind)
        if (small == x).all():
            return small
    return x


def _listed(index: np.ndarray):
    """The distinct terms in order, and the place of each."""
    top = int(index.max()) + 1
    if top > 4 * len(index):
        return np.unique(index, return_inverse=True)
    seen = np.zeros(top, bool)  # no sort
    seen[index] = True
    terms, place = np.flatnonzero(seen), np.empty(top, np.int64)
    place[terms] = np.arange(len(terms))
    return terms, place[index]


def _pack(number: int, first: int, docs: list) -> pa.RecordBatch:
    terms, place = _listed(np.concatenate([i for i, _ in docs]))
    n = _least(np.concatenate([v for _, v in docs]))
    place = place.astype(np.uint16 if len(terms) <= 1 << 16 else np.int32)
    lengths = np.array([len(i) for i, _ in docs], np.int64)
    parts = (lengths, terms.astype(np.int32), place, n)
    return pa.RecordBatch.from_arrays(
        [pa.array([TaskContext.get().partitionId()]), pa.array([number]), pa.array([first]), pa.array([n.dtype.str]),
         pa.array([place.dtype.str]), *(pa.array([x.tobytes()], pa.binary()) for x in parts)],
        names=["part", "number", "first", "kind", "places", "lengths", "terms", "place", "n"])


def _blocks(vectors: DataFrame, groups: int):
    """(group, block): the pairs of whole documents, in the order of their partition."""
    def entries(batches):
        for batch in batches:
            tf = batch.column(0)
            if tf.null_count:
                raise ValueError("null vector")
            sparse = tf.field("type").to_numpy(zero_copy_only=False) == 0
            ends = [(x.offsets.to_numpy(), x.values.to_numpy()) for x in (tf.field("indices"), tf.field("values"))]
            for row, is_sparse in enumerate(sparse):
                index, values = (at[ends_[row]:ends_[row + 1]] for ends_, at in ends)
                if not is_sparse:
                    index = np.arange(len(values), dtype=np.int32)
                some = values != 0
                yield (index, values) if some.all() else (index[some], values[some])

    def run(batches):
        docs, held, number, first = [], 0, 0, 0
        for index, values in entries(batches):
            if not len(index):
                continue
            if docs and held + len(index) > BLOCK:
                yield _pack(number, first, docs)
                docs, held, number, first = [], 0, number + 1, first + held
            docs.append((index, values))
            held += len(index)
        if docs:
            yield _pack(number, first, docs)

    def dealt(r):
        return (r.part + r.number) % groups, (
            "block", (r.part, r.number), r.first, np.frombuffer(r.lengths, np.int64), np.frombuffer(r.terms, np.int32),
            np.frombuffer(r.place, r.places), np.frombuffer(r.n, r.kind))

    packed = vectors.select(F.unwrap_udt("tf").alias("tf")).mapInArrow(
        run, "part long, number long, first long, kind string, places string, lengths binary, terms binary, place binary, n binary")
    with frugal(vectors.sparkSession):
        return _dealt(packed.rdd.map(dealt), groups)


def _dealt(rdd, groups: int):
    """By group.  Shuffled rows are batches of pickled rows, as mapped ones are, and are
    read as such: a union of both would else map them once more in every iteration."""
    out = rdd.partitionBy(groups, _place)
    out._jrdd_deserializer = rdd.ctx.serializer
    return out


def _forget_shuffles(rdd) -> None:
    """Remove the shuffle files that ``rdd``, which is kept or written, was made from."""
    rdd._jrdd.rdd().cleanShuffleDependencies(True)


def _messages(ranges: int, width: int, terms: np.ndarray, sums: np.ndarray, total: np.ndarray):
    """One message to each range of terms: this group's sums of its terms, and of all its pairs."""
    cuts = np.searchsorted(terms, np.arange(ranges + 1) * width)
    for t in range(ranges):
        part = slice(cuts[t], cuts[t + 1])
        yield ("terms", t, terms[part], sums[part], total)


def _columns(ks: Sequence[int]):
    ends = np.cumsum(ks)
    return [(int(k), int(e - k), int(e)) for k, e in zip(ks, ends)]


def _starter(ks, seed, groups, width):
    columns = _columns(ks)

    def run(group, rows):
        own, sums = np.empty(0, np.int32), np.empty((0, columns[-1][2]))
        total = np.zeros(columns[-1][2])
        for _, (_, key, first, lengths, terms, place, n) in rows:
            starts = np.cumsum(lengths) - lengths
            docs, words = np.empty((len(lengths), columns[-1][2])), np.empty((len(terms), columns[-1][2]))
            for k, lo, hi in columns:
                share = uniform(key[0] + seed, first * k, len(n) * k).reshape(-1, k)
                scale = n / share.sum(axis=1)
                for j in range(k):
                    x = share[:, j] * scale
                    docs[:, lo + j] = np.add.reduceat(x, starts)
                    words[:, lo + j] = np.bincount(place, x, len(terms))
            total += docs.sum(axis=0)
            both = np.union1d(own, terms)
            if len(both) > len(own):
                own, sums, before = both, np.zeros((len(both), len(total))), (own, sums)
                sums[np.searchsorted(own, before[0])] = before[1]
            sums[np.searchsorted(own, terms)] += words
            yield group, ("docs", key, docs)
        for message in _messages(groups, width, own, sums, total):
            yield group, message

    return run


def _adder(groups: int, width: int):
    """Sums of one range of terms over all groups; each group gets back those of its own terms."""
    def run(t, rows):
        # in group order, so that sums do not depend on the order of arrival
        got = sorted(((g, m[2], m[3], m[4]) for _, (g, m) in rows), key=lambda x: x[0])
        if not got:
            return
        total = sum(x[3] for x in got)
        sums = np.zeros((width, len(total)))
        for _, terms, values, _ in got:
            sums[terms - t * width] += values
        for g, terms, _, _ in got:
            yield g, ("sums", t, terms, sums[terms - t * width], total)

    return run


def _stepper(ks, groups, width, size):
    columns = _columns(ks)

    def run(group, rows):
        docs, parts, total, own, values, new = {}, [], None, None, None, None
        room, shares = np.empty(0, np.int64), None  # kept from block to block
        for _, row in rows:
            if row[0] == "terms":  # sent, and back in the sums
                continue
            if row[0] == "docs":
                docs[row[1]] = row[2]
                continue
            if row[0] == "sums":
                parts.append(row[1:])
                continue
            if own is None:  # the blocks come last
                parts.sort(key=lambda x: x[0])
                own, values, total = np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts]), parts[0][3]
                parts = None
                values += ETA
                values /= total + size * ETA
                new, sent = np.zeros_like(values), np.zeros_like(total)
            _, key, _, lengths, terms, place, n = row
            at = np.searchsorted(own, terms)
            if len(room) < len(place):
                room, shares = np.empty(len(place), np.int64), np.empty((max(ks), len(place)))
            doc, ends, share = docs.pop(key), np.concatenate((np.zeros(1, np.int64), np.cumsum(lengths))), shares[:, :len(place)]
            room[:len(place)] = place
            place, word, words = room[:len(place)], np.ascontiguousarray(values[at].T), np.empty((len(terms), len(total)))
            cuts = [*np.unique(np.searchsorted(ends[:-1], np.arange(0, len(place), SLICE))).tolist(), len(lengths)]
            for k, lo, hi in columns:
                for a, b in zip(cuts, cuts[1:]):
                    part, mine, starts = slice(ends[a], ends[b]), doc[a:b], ends[a:b] - ends[a]
                    scale = np.zeros(ends[b] - ends[a])
                    for x, j in zip(share[:, part], range(lo, hi)):
                        np.take(word[j], place[part], out=x, mode="clip")  # all are in range
                        x *= np.repeat(mine[:, j] + 50.0 / k, lengths[a:b])
                        scale += x
                    np.divide(n[part], scale, out=scale)
                    for x, j in zip(share[:, part], range(lo, hi)):
                        x *= scale
                        mine[:, j] = np.add.reduceat(x, starts)
                for x, j in zip(share, range(lo, hi)):
                    words[:, j] = np.bincount(place, x, len(terms))
            new[at] += words
            sent += doc.sum(axis=0)
            yield group, ("docs", key, doc)
        if own is None:  # a group without blocks takes part with nothing
            own, new, sent = np.empty(0, np.int32), np.zeros((0, columns[-1][2])), np.zeros(columns[-1][2])
        for message in _messages(groups, width, own, new, sent):
            yield group, message

    return run


def _to_ranges(out, groups):
    return _dealt(out.filter(lambda r: r[1][0] == "terms").map(lambda r: (r[1][1], r)), groups)


class TopicModel:
    """Topic counts of all terms, in one written row for each range of terms."""

    def __init__(self, tables: DataFrame, k: int, first: int, size: int):
        self.tables, self.k, self.first, self.size = tables, k, first, size

    def isDistributed(self) -> bool:
        return True

    def vocabSize(self) -> int:
        return self.size

    def describeTopics(self, n: int = 10) -> DataFrame:
        """``(topic, termIndices, termWeights)``: the n heaviest terms of each topic."""
        k, first = self.k, self.first

        def run(batches):
            for batch in batches:
                for lo, raw, all_ in zip(*(batch.column(c).to_pylist() for c in ("first", "counts", "total"))):
                    total = np.frombuffer(all_)
                    counts = np.frombuffer(raw).reshape(-1, len(total))
                    for j in range(k):
                        x = counts[:, first + j]
                        best = np.lexsort((np.arange(len(x)), -x))[:n]
                        yield pa.RecordBatch.from_arrays([
                            pa.array(np.full(len(best), j, np.int32)), pa.array((best + lo).astype(np.int32)),
                            pa.array(x[best] / total[first + j])], names=["topic", "i", "w"])

        some = self.tables.mapInArrow(run, "topic int, i int, w double")
        # at most n rows of each range of terms
        row = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("w")).alias("w"), "i"))), 1, n)
        return some.groupBy("topic").agg(row.alias("e")).select(
            "topic", F.col("e.i").alias("termIndices"), F.transform("e.w", lambda w: -w).alias("termWeights")).orderBy("topic")


def fit_em(vectors: DataFrame, ks: Iterable[int], seed: int = 0, max_iter: int = 10) -> dict[int, TopicModel]:
    """One :class:`TopicModel` for each k, over every document in each iteration."""
    spark = vectors.sparkSession
    ship(spark)
    head = vectors.select("tf").first()
    if head is None:
        raise ValueError("no documents")
    size, ks = head.tf.size, list(dict.fromkeys(ks))
    tf = F.unwrap_udt("tf")
    entries = vectors.agg(F.sum(F.size(tf["values"]).cast("long"))).first()[0] or 0
    groups = max(1, min(spark.sparkContext.defaultParallelism, entries // BLOCK), -(-entries // GROUP))
    width = -(-size // groups)
    blocks = _blocks(vectors, groups).persist(StorageLevel.MEMORY_AND_DISK)
    models = {}
    try:
        blocks.count()
        _forget_shuffles(blocks)
        while ks:
            some = [ks.pop(0)]
            while ks and (sum(some) + ks[0]) * size <= TABLE:
                some.append(ks.pop(0))
            tables = _fit(blocks, some, seed, max_iter, groups, width, size)
            models.update({k: TopicModel(tables, k, lo, size) for k, lo, _ in _columns(some)})
    finally:
        blocks.unpersist()
    return models


def _fit(blocks, ks, seed, max_iter, groups, width, size) -> DataFrame:
    spark = blocks.ctx
    out = blocks.mapPartitionsWithIndex(_starter(ks, seed, groups, width), True).persist(StorageLevel.MEMORY_AND_DISK)
    out.count()
    step, add = _stepper(ks, groups, width, size), _adder(groups, width)
    for _ in range(max_iter):
        sums = _dealt(_to_ranges(out, groups).map(lambda r: (r[0], (r[1][0], r[1][1])), True).mapPartitionsWithIndex(add), groups)
        # all three are dealt alike: a group's partitions follow each other, blocks last, unshuffled
        joined = sums.union(out).union(blocks)
        if joined.getNumPartitions() != blocks.getNumPartitions():
            raise RuntimeError("the groups are not dealt alike")
        new = joined.mapPartitionsWithIndex(step, True).persist(StorageLevel.MEMORY_AND_DISK)
        new.count()
        _forget_shuffles(new)
        out.unpersist()
        out = new

    def table(t, rows):
        got = sorted(((g, m) for _, (g, m) in rows), key=lambda x: x[0])
        if got:
            total = sum(m[4] for _, m in got)
            sums = np.zeros((max(0, min(width, size - t * width)), len(total)))
            for _, m in got:
                sums[m[2] - t * width] += m[3]
            yield t * width, bytearray(sums.tobytes()), bytearray(total.tobytes())

    from pyspark.sql import SparkSession
    rows = _to_ranges(out, groups).mapPartitionsWithIndex(table)
    tables = written(SparkSession.active().createDataFrame(rows, "first long, counts binary, total binary"))
    _forget_shuffles(rows)
    out.unpersist()
    return tables
