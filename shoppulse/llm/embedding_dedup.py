"""Embedding near-dedup: product quantisation with exact cosine rerank.

Vectors are scaled to length one, so a cosine of ``THRESHOLD`` is a distance of
``r = sqrt(2 - 2 * THRESHOLD)``.  Equal vectors are taken together first.  Coarse
centroids and, for the residuals, one codebook of 256 entries per subspace are
fitted on at most ``SAMPLE`` distinct vectors (those with the smallest hashes);
every vector is indexed: it stands in the inverted list of its nearest centroid
with its codes and its own quantisation error.

Probes are sufficient rather than a fixed number: a vector x can have a neighbour
in list b if for every other centroid c it is near enough to the half space that
is nearer to b, (|x-b|^2 - |x-c|^2) / (2|b-c|) <= margin (tested for the ``NEAREST``
centroids nearest to x).  A margin of r would lose nothing; but a neighbour's
displacement lies along the line from b to c only in part.  How much of it does is
measured on the sample for every pair of lists: the share of the variance of the
residuals along that line.  The margin is ``DEVIATIONS`` standard deviations of a
displacement of length r with that share, r at most; so it is r wherever vectors
differ in few directions (low rank, padded or correlated dimensions).  All pairs of
the sample that reach the threshold are then looked up; if fewer than ``RECALL`` of
them are probed, the margin is widened and measured again, up to r.
Links are symmetric, so x probes only lists after its own.  In a probed list the
asymmetric distance of x to the codes of y, summed from the lookup tables of x,
keeps y if it is at most r plus y's quantisation error (the triangle inequality:
this step loses nothing); the cosine in double precision decides.

Lists are dealt in blocks of ``BLOCK`` vectors; a block of probing vectors meets
a block of the list in a row group of its own, which returns counts of links and
a spanning forest, never the pairs.

Defined cases: null and zero vectors and those with null or non-finite
components link with nothing and are their own component; vectors of different
lengths are compared within their length only; repeated rows of one id are
copies that link; a null vec_id counts as the smallest id, and
component_id is then null; extra columns are not
read; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._graph import forest
from ._spark import NULL_ID, components, materialise
from ._text import ints

THRESHOLD = 0.95
SAMPLE = 20_000
MOST_LISTS = 4096
SUBSPACES = 8
CODES = 256
NEAREST = 8
#: Margin in standard deviations of a neighbour's displacement, and the recall required of it on the sample.
DEVIATIONS, RECALL = 4.0, 0.999
BLOCK = 2048
EPS = 1e-6
OUT_BYTES = 8 << 20


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """Lloyd's centroids of ``x`` (k of them, fewer if there are fewer rows); empty ones are reseeded."""
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = nearest(x, c)
        count = np.bincount(near, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        full = count > 0
        c[full] = total[full] / count[full][:, None]
        if not full.all():
            c[~full] = x[rng.choice(len(x), (~full).sum())]
    return c


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x to all rows of c."""
    return np.maximum((x * x).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2 * (x @ c.T), 0)


def nearest(x: np.ndarray, c: np.ndarray, block: int = 4096) -> np.ndarray:
    return np.concatenate([distances(x[i:i + block], c).argmin(1) for i in range(0, len(x), block)]) if len(x) else np.zeros(0, int)


class Index:
    """Coarse centroids and residual codebooks, fitted on a sample."""

    def __init__(self, sample: np.ndarray, lists: int):
        self.dim = sample.shape[1]
        self.lists = kmeans(sample, lists)
        residual = sample - self.lists[nearest(sample, self.lists)]
        self.parts = [p for p in np.array_split(np.arange(self.dim), min(SUBSPACES, self.dim)) if len(p)]
        self.books = [kmeans(residual[:, p], CODES, 8) for p in self.parts]
        self.gaps = np.sqrt(distances(self.lists, self.lists)).astype(np.float32)
        self.slack = None

    def encode(self, x: np.ndarray, own: np.ndarray):
        """(codes, quantisation errors) of vectors in their lists."""
        residual = x - self.lists[own]
        codes = np.stack([nearest(residual[:, p], b) for p, b in zip(self.parts, self.books)], 1).astype(np.uint8)
        back = np.concatenate([b[codes[:, k]] for k, b in enumerate(self.books)], 1)
        return codes, np.sqrt(((residual - back) ** 2).sum(1))

    def fit_probes(self, sample: np.ndarray, threshold: float) -> float:
        """Set the margins of all pairs of lists from the sample; the recall measured on its pairs."""
        r = probe_margin(self.dim, threshold)
        residual = sample - self.lists[nearest(sample, self.lists)]
        scatter = residual.T @ residual
        along = self.lists @ scatter @ self.lists.T
        along = np.diag(along)[:, None] + np.diag(along)[None, :] - 2 * along
        total = np.trace(scatter) * np.square(self.gaps, dtype=np.float64)
        share = np.sqrt(np.clip(np.divide(along, total, out=np.ones_like(along), where=total > 0), 0, 1))
        deviations = DEVIATIONS
        while True:
            margin = np.minimum(deviations * share, 1.0) * r
            self.slack = (2 * (margin + EPS) * self.gaps).astype(np.float32)
            recall = self.recall(sample, threshold)
            if recall >= RECALL or (margin >= r).all():
                return recall
            deviations *= 1.5

    def recall(self, sample: np.ndarray, threshold: float, step: int = 1024) -> float:
        """Share of the sample's pairs at the threshold that lie in one list or are probed."""
        own = np.concatenate([self.probes(sample[i:i + step])[0] for i in range(0, len(sample), step)])
        found = pairs = 0
        for i in range(0, len(sample), step):
            rows, (at, other) = self.probes(sample[i:i + step])
            a, b = np.nonzero(sample[i:i + step] @ sample.T >= threshold)
            later = own[b] > rows[a]  # the vector of the earlier list probes
            same = (own[b] == rows[a]) & (b > a + i)
            probed = np.zeros((len(rows), len(self.lists)), bool)
            probed[at, other] = True
            found += int(same.sum()) + int(probed[a[later], own[b[later]]].sum())
            pairs += int(same.sum()) + int(later.sum())
        return found / pairs if pairs else 1.0

    def probes(self, x: np.ndarray, margin: float | None = None):
        """(own list, pairs (row, list) of the later lists that can hold a neighbour), by the fitted margins or one for all."""
        d = distances(x, self.lists)
        own = d.argmin(1)
        close = np.argsort(d, axis=1)[:, :min(NEAREST, d.shape[1])]
        can = np.ones(d.shape, bool)
        for k in range(close.shape[1]):
            c = close[:, k]
            slack = self.slack[c] if margin is None else 2 * (margin + EPS) * self.gaps[c]
            need = (d - d[np.arange(len(x)), c][:, None]) <= slack + EPS
            can &= need
        can &= np.arange(d.shape[1])[None, :] > own[:, None]
        return own, np.nonzero(can)

    def tables(self, x: np.ndarray, which: int) -> np.ndarray:
        """Squared subspace distances of queries to all codes, in the list ``which``."""
        residual = x - self.lists[which]
        out = np.zeros((len(x), len(self.parts), CODES))
        for k, (p, b) in enumerate(zip(self.parts, self.books)):
            out[:, k, :len(b)] = distances(residual[:, p], b)
        return out


def unit(flat: np.ndarray, dim: int) -> np.ndarray:
    x = flat.reshape(-1, dim).astype(np.float64)
    return x / np.sqrt((x * x).sum(1))[:, None]


def links(index: Index, which: int, base, query, threshold: float):
    """Boolean (query, base) matrix rows in blocks of queries: (first query, hits)."""
    radius = math.sqrt(2 - 2 * threshold)
    vectors, codes, errors = base
    step = max(1, (1 << 20) // max(1, len(vectors)))
    for i in range(0, len(query), step):
        q = query[i:i + step]
        table = index.tables(q, which)
        dist = np.zeros((len(q), len(vectors)))
        for k in range(codes.shape[1]):
            dist += table[:, k][:, codes[:, k]]
        near = np.sqrt(dist) <= radius + errors[None, :] + EPS
        hit = np.zeros(near.shape, bool)
        if near.mean() > 0.05:
            hit = near & (q @ vectors.T >= threshold)
        else:
            a, b = np.nonzero(near)
            hit[a, b] = np.einsum("ij,ij->i", q[a], vectors[b]) >= threshold
        yield i, hit


def _valid(batch, name: str, dtype):
    """(row numbers, lengths, flat values) of the usable vectors of a batch."""
    col = batch.column(name)
    n = pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = col.flatten()
    bad = flat.is_null().to_numpy(zero_copy_only=False)
    values = flat.fill_null(0).to_numpy(zero_copy_only=False).astype(dtype)
    row = np.repeat(np.arange(len(n)), n)
    bad |= ~np.isfinite(values)
    size = np.bincount(row, values.astype(np.float64) ** 2, minlength=len(n)) if len(row) else np.zeros(len(n))
    ok = (n > 0) & (np.bincount(row[bad], minlength=len(n)) == 0) & (size > 0)
    return np.flatnonzero(ok), n, values, np.concatenate(([0], np.cumsum(n)))


def _vectors(rows: DataFrame, dtype) -> DataFrame:
    """(vec_id, dim, raw) of every row; raw is null for a vector that links with nothing."""
    def run(batches):
        for batch in batches:
            ok, n, values, at = _valid(batch, "embedding", dtype)
            values = values + 0.0  # -0.0 is 0.0
            raw = [None] * len(n)
            for k in ok:
                raw[k] = values[at[k]:at[k + 1]].tobytes()
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(n.astype(np.int32)), pa.array(raw, pa.binary())],
                                             names=["vec_id", "dim", "raw"])

    return rows.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(run, "vec_id long, dim int, raw binary")


def probe_margin(dim: int, threshold: float) -> float:
    """The distance at the threshold, in any number of dimensions."""
    return math.sqrt(2 - 2 * threshold)


def _assign(batch, index: Index, dtype):
    t = ints(batch.column("t"))
    raw = batch.column("raw")
    if not len(t):
        return None
    flat = np.frombuffer(b"".join(raw.to_pylist()), dtype)
    x = unit(flat, index.dim)
    own, (row, other) = index.probes(x)
    return t, raw, x, own, row, other


def _found(one: DataFrame, index: Index, dtype, threshold: float) -> DataFrame:
    """Links among the distinct vectors ``one(t, copies, raw)`` of one length: (t, links, other)."""
    spark = one.sparkSession
    shared = spark.sparkContext.broadcast(index)  # MOST_LISTS centroids at most

    def count(batches):
        k = len(shared.value.lists)
        base, query = np.zeros(k, np.int64), np.zeros(k, np.int64)
        for batch in batches:
            got = _assign(batch, shared.value, dtype)
            if got:
                base += np.bincount(got[3], minlength=k)
                query += np.bincount(got[5], minlength=k)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k)), pa.array(base), pa.array(query)], names=["list", "base", "query"])

    sizes = one.mapInArrow(count, "list long, base long, query long").groupBy("list").agg(
        F.sum("base").alias("base"), F.sum("query").alias("query")).collect()
    k = len(index.lists)
    n_base, n_query = np.ones(k, np.int64), np.zeros(k, np.int64)
    for r in sizes:  # as many rows as lists
        n_base[r["list"]], n_query[r["list"]] = max(1, -(-r["base"] // BLOCK)), -(-r["query"] // BLOCK)

    def seats(batches):
        ix = shared.value
        for batch in batches:
            got = _assign(batch, ix, dtype)
            if not got:
                continue
            t, raw, x, own, row, other = got
            copies = ints(batch.column("copies"))
            codes, errors = ix.encode(x, own)
            spot = (t.view(np.uint64) >> np.uint64(20)).astype(np.int64)
            out, size = [], 0
            width = len(raw[0].as_py()) + 64 if len(raw) else 1
            for i in range(len(t)):  # in its own list: the blocks before and after, and those that probe
                c = int(own[i])
                b = int(spot[i] % n_base[c])
                for j in range(int(n_base[c])):
                    lo, hi = min(b, j), max(b, j)
                    out.append((c, 0, lo, hi, int(b == hi and lo != hi), i))
                for q in range(int(n_query[c])):
                    out.append((c, 1, b, q, 0, i))
            for i, c in zip(row.tolist(), other.tolist()):  # in a list it probes
                q = int(spot[i] % n_query[c])
                for b in range(int(n_base[c])):
                    out.append((c, 1, b, q, 1, i))
            step = max(1, OUT_BYTES // width)
            for a in range(0, len(out), step):
                part = np.array(out[a:a + step], np.int64)
                who = part[:, 5]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part[:, 0]), pa.array(part[:, 1]), pa.array(part[:, 2]), pa.array(part[:, 3]), pa.array(part[:, 4]),
                     pa.array(t[who]), pa.array(copies[who]), raw.take(pa.array(who)),
                     pa.array([codes[w].tobytes() for w in who], pa.binary()), pa.array(errors[who])],
                    names=["list", "kind", "b", "q", "side", "t", "copies", "raw", "codes", "error"])

    def compare(batches):
        now, held = None, []
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("list", "kind", "b", "q"))))
            cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if keys[a] != now:
                    yield from _block(shared.value, now, held, dtype, threshold)
                    now, held = keys[a], []
                held.append(batch.slice(a, b - a))
        yield from _block(shared.value, now, held, dtype, threshold)

    schema = ("list long, kind long, b long, q long, side long, t long, copies long, raw binary, codes binary, error double")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return (one.mapInArrow(seats, schema).repartition(parts, "list", "kind", "b", "q")
            .sortWithinPartitions("list", "kind", "b", "q").mapInArrow(compare, "t long, links long, other long"))


def _block(index: Index, key, held, dtype, threshold: float):
    if not held:
        return
    rows = pa.Table.from_batches(held).combine_chunks()
    t, copies, side = (rows.column(c).to_numpy() for c in ("t", "copies", "side"))
    x = unit(np.frombuffer(b"".join(rows.column("raw").to_pylist()), dtype), index.dim)
    codes = np.frombuffer(b"".join(rows.column("codes").to_pylist()), np.uint8).reshape(len(t), -1)
    errors = rows.column("error").to_numpy()
    base, query = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    same = key[1] == 0 and key[2] == key[3]
    if same:
        query = base
    if not len(base) or not len(query):
        return
    total = np.zeros(len(t), np.int64)
    src, dst = [], []
    for i, hit in links(index, key[0], (x[base], codes[base], errors[base]), x[query], threshold):
        q = query[i:i + len(hit)]
        if same:
            hit[np.arange(len(hit)), np.arange(i, i + len(hit))] = False
        total[q] += hit @ copies[base]
        if not same:
            total[base] += copies[q] @ hit
        a, b = np.nonzero(hit)
        u, v = forest(t[q[a]], t[base[b]])
        src.append(u)
        dst.append(v)
    u, v = forest(np.concatenate(src), np.concatenate(dst))
    some = np.flatnonzero(total)
    ids = np.concatenate((t[some], u))
    if len(ids):
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids), pa.array(np.concatenate((total[some], np.zeros(len(u), np.int64)))),
             pa.array(np.concatenate((np.zeros(len(some), np.int64), v)), mask=np.arange(len(ids)) < len(some))],
            names=["t", "links", "other"])


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of ``vectors(vec_id, embedding)``."""
    spark = vectors.sparkSession
    kind = vectors.schema["embedding"].dataType.elementType.typeName()
    dtype = np.dtype(np.float32 if kind == "float" else np.float64)
    rows = (_vectors(vectors, dtype).withColumn("vec", F.coalesce("vec_id", F.lit(NULL_ID)))
            .withColumn("t", F.when(F.col("raw").isNotNull(), F.xxhash64("dim", "raw"))))
    rows = materialise(rows)
    one = materialise(rows.filter("t is not null").groupBy("t").agg(
        F.min("vec").alias("first"), F.count("*").alias("copies"), F.first("dim").alias("dim"), F.first("raw").alias("raw")))
    found = None
    for r in one.groupBy("dim").count().orderBy("dim").collect():  # one row for each vector length
        part = one.filter(F.col("dim") == r.dim).select("t", "copies", "raw")
        few = part.orderBy("t").limit(sample).toArrow()
        x = unit(np.frombuffer(b"".join(few.column("raw").to_pylist()), dtype), r.dim)
        index = Index(x, int(min(MOST_LISTS, max(1, round(math.sqrt(r["count"]))))))
        index.fit_probes(x, threshold)
        more = materialise(_found(part, index, dtype, threshold))
        found = more if found is None else found.union(more)
    if found is None:
        found = spark.createDataFrame([], "t long, links long, other long")
    totals = found.filter("other is null").groupBy("t").agg(F.sum("links").alias("links"))
    joined = components(found.filter("other is not null").select(F.col("t").alias("src"), F.col("other").alias("dst")))
    each = materialise(one.select("t", "first", "copies").join(totals, "t", "left")
                       .join(joined.withColumnRenamed("id", "t"), "t", "left")
                       .select("t", "first", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
                               F.coalesce("component", "t").alias("c")))
    heads = materialise(each.groupBy("c").agg(F.min("first").alias("head")))
    result = materialise(each.join(heads, "c").select(F.col("t").alias("rt"), "n_links", "head"))
    component = F.when(F.coalesce("head", "vec") != NULL_ID, F.coalesce("head", "vec"))
    return (rows.select("vec_id", "vec", "t").join(result, F.col("t") == F.col("rt"), "left")
            .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                    component.alias("component_id"), (F.coalesce("head", "vec") == F.col("vec")).alias("kept")))
