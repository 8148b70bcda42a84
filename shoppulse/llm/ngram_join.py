"""N-gram Jaccard join by MinHash banding, verified on the full n-gram sets.

A document is the set of its five-word shingles (words between white space; a
text of fewer words is one shingle, a text without words has none).  Equal texts
are taken together first.  Each distinct text gets ``bands`` hashes of ``rows``
minima; ``choose_bands`` finds the number of bands that reaches the target
recall at the threshold.  Texts are shuffled on (band, hash) and each bucket
links its members to its smallest id, so candidate groups come out as connected
components and no bucket emits its pairs.  The full shingle sets of a candidate
group then meet.  Groups are cut into blocks ordered by set size, and every pair of blocks whose sizes allow the threshold is a row of its
own; in it, the sizes of all intersections come from products of 0/1 matrices.
Only counts of links and a spanning forest of each block pair leave the task.

``join`` returns one row per document: doc_id, n_links (other documents with a
similarity of ``threshold`` or more, copies included) and component_id (smallest
doc_id reachable).

Defined cases: null, empty and blank texts have no shingle and link with
nothing, not even each other; equal texts link whatever their length; repeated
rows of one id are copies that link, and the id is listed once for each; a null
doc_id counts as the smallest id, and component_id is then null; extra columns are not read;
an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._graph import forest
from ._spark import NULL_ID, components, materialise, thinned
from ._text import U64, ints, mix64, shingles, text_slices

THRESHOLD = 0.8
WORDS = 5
RECALL = 0.9999
ROWS = 8
#: A block takes about so many texts, or so many shingles.
BLOCK_TEXTS, BLOCK_GRAMS = 1024, 1 << 19
OUT_BYTES = 8 << 20
#: Shingles compared in one matrix product.
WIDTH = 4096


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, rows: int = ROWS) -> int:
    """Fewest bands of ``rows`` minima that find a pair at the threshold with probability ``recall``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold ** rows))


def _multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240501)
    return (rng.integers(1, 1 << 32, n, dtype=np.uint64) | U64(1)).astype(np.uint32), \
        rng.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32)


def band_hashes(grams: np.ndarray, begin: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Band hashes of every set; ``begin`` are the first positions of the (non-empty) sets in ``grams``."""
    a, b = _multipliers(bands * rows)
    low = (grams >> U64(32)).astype(np.uint32)
    out = np.zeros((len(begin), bands), U64)
    for k in range(bands):
        h = np.full(len(begin), k, U64)
        for r in range(rows):
            x = low * a[k * rows + r]
            x ^= x >> np.uint32(15)
            x *= np.uint32(0x2C1B3C6D)
            x += b[k * rows + r]
            h = mix64(h ^ np.minimum.reduceat(x, begin).astype(U64))
        out[:, k] = h
    return out


def _rows(docs: DataFrame) -> DataFrame:
    """(doc, digest, t, text): t numbers equal texts by 64 bits of their digest."""
    return (docs.select(F.col("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc"),
                        F.md5("text").alias("digest"), "text")
            .withColumn("t", F.xxhash64("digest")))


def _signatures(rows: DataFrame, bands: int, n_rows: int) -> DataFrame:
    """(t, n, hashes) of every distinct text that has a shingle."""
    def run(batches):
        for batch in batches:
            t = ints(batch.column("t"))
            for i, j, off, data in text_slices(batch):
                grams, row = shingles(data, off, WORDS)
                if not len(grams):
                    continue
                begin = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
                h = band_hashes(grams, begin, bands, n_rows)
                size = np.diff(np.append(begin, len(grams)))
                at = pa.array(np.arange(0, len(begin) * bands + 1, bands, dtype=np.int32))
                cols = [pa.array(t[i:j][row[begin]]), pa.array(size.astype(np.int32)),
                        pa.ListArray.from_arrays(at, pa.array(h.ravel().view(np.int64)))]
                _, one = np.unique(t[i:j][row[begin]], return_index=True)
                yield pa.RecordBatch.from_arrays([c.take(pa.array(one)) for c in cols], names=["t", "n", "hashes"])

    return (rows.filter("text is not null").select("t", "text").mapInArrow(run, "t long, n int, hashes array<long>")
            .dropDuplicates(["t"]))


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of two lists of sorted sets, through 0/1 matrices of shared shingles."""
    a, b = np.concatenate(left), np.concatenate(right)
    ra = np.repeat(np.arange(len(left)), [len(x) for x in left])
    rb = np.repeat(np.arange(len(right)), [len(x) for x in right])
    both = np.intersect1d(a, b)
    out = np.zeros((len(left), len(right)), np.float32)
    pa_, pb_ = np.searchsorted(both, a), np.searchsorted(both, b)
    if len(both):
        ha = both[np.minimum(pa_, len(both) - 1)] == a
        hb = both[np.minimum(pb_, len(both) - 1)] == b
        pa_, ra, pb_, rb = pa_[ha], ra[ha], pb_[hb], rb[hb]
    for k in range(0, len(both), WIDTH):
        x = np.zeros((len(left), WIDTH), np.float32)
        y = np.zeros((len(right), WIDTH), np.float32)
        use = (pa_ >= k) & (pa_ < k + WIDTH)
        x[ra[use], pa_[use] - k] = 1
        use = (pb_ >= k) & (pb_ < k + WIDTH)
        y[rb[use], pb_[use] - k] = 1
        out += x @ y.T
    return out


def linked(left, right, threshold: float) -> np.ndarray:
    """Which pairs of sets reach the threshold."""
    shared = overlaps(left, right).astype(np.float64)
    n = np.array([len(x) for x in left])[:, None]
    m = np.array([len(x) for x in right])[None, :]
    return shared >= threshold * (n + m - shared) - 1e-9


def verify(left, right, threshold: float):
    """Links of one block pair: (ids, counts by the other side's copies, forest edges).

    ``left`` and ``right`` are lists of (id, copies, set), or the same list.
    """
    hit = linked([x[2] for x in left], [x[2] for x in right], threshold)
    same = left is right
    if same:
        np.fill_diagonal(hit, False)
    lid, rid = (np.array([x[0] for x in side], np.int64) for side in (left, right))
    lc, rc = (np.array([x[1] for x in side], np.int64) for side in (left, right))
    ids = lid if same else np.concatenate((lid, rid))
    counts = hit @ rc if same else np.concatenate((hit @ rc, hit.T @ lc))
    i, j = np.nonzero(hit)
    return ids, counts, forest(lid[i], rid[j])


def _seats(members: DataFrame, threshold: float) -> DataFrame:
    """(t, seats): the block pairs (pair, side) in which a text of a candidate group is compared.

    ``members(t, g, n)``.  Texts of a group are laid out by set size; a block
    takes about ``BLOCK_TEXTS`` texts or ``BLOCK_GRAMS`` shingles, and a size with
    more texts than that is dealt to several by hash.  Blocks meet unless the
    largest set of the lower one is too small for the smallest of the upper one.
    """
    cost = F.greatest(F.lit(1.0 / BLOCK_TEXTS), F.col("n") / F.lit(float(BLOCK_GRAMS)))
    sizes = members.groupBy("g", "n").agg(F.count("*").alias("c")).withColumn("cost", cost * F.col("c"))
    run = F.sum("cost").over(Window.partitionBy("g").orderBy("n"))
    sizes = (sizes.withColumn("upto", run).withColumn("from", F.col("upto") - F.col("cost"))
             .withColumn("low", F.floor(F.col("from") + 1e-9))
             .withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("upto") - 1e-9) - F.col("low")))
             .select("g", "n", "low", "parts"))
    sizes = materialise(sizes)
    placed = (members.join(sizes, ["g", "n"])
              .withColumn("block", (F.col("low") + F.pmod(F.xxhash64("t"), F.col("parts"))).cast("long"))
              .select("t", "g", "n", "block"))
    placed = materialise(placed)
    blocks = materialise(placed.groupBy("g", "block").agg(F.min("n").alias("low"), F.max("n").alias("high")))
    other = blocks.select(F.col("g").alias("og"), F.col("block").alias("other"), F.col("low").alias("olow"), F.col("high").alias("ohigh"))
    pairs = (blocks.join(other, (blocks.g == other.og) & (F.col("block") <= F.col("other"))
                         & (F.col("high") >= F.lit(threshold) * F.col("olow") - 1e-6)
                         & (F.col("ohigh") >= F.lit(threshold) * F.col("low") - 1e-6))
             .withColumn("pair", F.xxhash64("g", "block", "other")))
    sides = (pairs.select("g", "block", F.struct("pair", F.lit(0).alias("side")).alias("seat"))
             .union(pairs.filter("block < other").select("g", F.col("other").alias("block"), F.struct("pair", F.lit(1).alias("side")))))
    seats = materialise(sides.groupBy("g", "block").agg(F.collect_list("seat").alias("seats")))
    return placed.join(seats, ["g", "block"]).select("t", "seats")


def _compare(rows: DataFrame, threshold: float) -> DataFrame:
    """Links of all block pairs: rows (t, links, other); other is null in counts, links 0 in forest edges.

    ``rows(t, copies, seats, text)``: every candidate text once (or more often, which changes nothing).
    """
    def sets(batches):
        for batch in batches:
            t, copies = ints(batch.column("t")), ints(batch.column("copies"))
            seats = batch.column("seats")
            at = seats.offsets.to_numpy()
            flat = seats.values
            pair, side = (flat.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for i, j, off, data in text_slices(batch):
                grams, row = shingles(data, off, WORDS)
                begin = np.searchsorted(row, np.arange(j - i + 1))
                got, size = [], 0
                for k in range(j - i):
                    raw = grams[begin[k]:begin[k + 1]].tobytes()
                    for s in range(at[i + k], at[i + k + 1]):
                        got.append((int(pair[s]), int(side[s]), int(t[i + k]), int(copies[i + k]), raw))
                        size += len(raw)
                        if size > OUT_BYTES:
                            yield _seat_batch(got)
                            got, size = [], 0
                if got:
                    yield _seat_batch(got)

    def compare(batches):
        now, held = None, ({}, {})
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("pair", "side", "t", "copies", "grams")]
            for pair, side, t, copies, grams in zip(*cols):
                if pair != now:
                    yield from _block_links(held, threshold)
                    now, held = pair, ({}, {})
                held[side][t] = (t, copies, np.frombuffer(grams, U64))
        yield from _block_links(held, threshold)

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    seated = rows.select("t", "copies", "seats", "text").mapInArrow(sets, "pair long, side int, t long, copies long, grams binary")
    return (seated.repartition(parts, "pair").sortWithinPartitions("pair")
            .mapInArrow(compare, "t long, links long, other long"))


def _seat_batch(got) -> pa.RecordBatch:
    pair, side, t, copies, grams = zip(*got)
    return pa.RecordBatch.from_arrays([pa.array(pair, pa.int64()), pa.array(side, pa.int32()), pa.array(t, pa.int64()),
                                       pa.array(copies, pa.int64()), pa.array(grams, pa.binary())],
                                      names=["pair", "side", "t", "copies", "grams"])


def _block_links(held, threshold):
    left = list(held[0].values())
    if not left:
        return
    right = list(held[1].values()) or left
    if right is left and len(left) == 1:
        return
    ids, counts, (src, dst) = verify(left, right, threshold)
    some = counts > 0
    t = np.concatenate((ids[some], src))
    links = np.concatenate((counts[some], np.zeros(len(src), np.int64)))
    other = pa.array(np.concatenate((np.zeros(some.sum(), np.int64), dst)), mask=np.arange(len(t)) < some.sum())
    yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(links.astype(np.int64)), other], names=["t", "links", "other"])


def classes(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, rows: int = ROWS) -> DataFrame:
    """doc_id, doc, digest, n_links, component_id, component_digest of every row.

    (component_id, component_digest) name the smallest (doc, digest) of the row's component.
    """
    # the two large joins are sort-merge joins at every size: their small side grows with the copies
    bands = choose_bands(threshold, recall, rows)
    keyed = _rows(docs)
    who = materialise(keyed.select("doc_id", "doc", "digest", "t"))
    distinct = materialise(who.filter("digest is not null").groupBy("t").agg(
        F.min(F.struct("doc", "digest")).alias("first"), F.count("*").alias("copies")))
    signed = materialise(_signatures(keyed, bands, rows))
    buckets = signed.select("t", F.explode("hashes").alias("key"))
    hubs = materialise(buckets.groupBy("key").agg(F.min("t").alias("hub"), F.max("t").alias("top"))
                       .filter("hub < top").select("key", "hub"))
    edges = materialise(buckets.join(hubs.hint("merge"), "key").filter("t <> hub").select(F.col("t").alias("src"), F.col("hub").alias("dst")).distinct())
    groups = components(thinned(edges)).select(F.col("id").alias("t"), F.col("component").alias("g"))
    members = materialise(groups.join(signed.select("t", "n"), "t"))
    seats = materialise(_seats(members, threshold).join(distinct, "t")
                        .select("t", "seats", "copies", F.col("first.doc").alias("at")))
    text = keyed.select("doc", F.col("t").alias("text_t"), "text")
    chosen = text.join(seats.hint("merge"), (text.text_t == seats.t) & (text.doc == seats["at"])).select("t", "copies", "seats", "text")
    found = materialise(_compare(chosen, threshold))
    links = found.filter("other is null").groupBy("t").agg(F.sum("links").alias("links"))
    joined = components(thinned(found.filter("other is not null").select(F.col("t").alias("src"), F.col("other").alias("dst"))))
    each = materialise(signed.select("t").join(distinct, "t").join(links, "t", "left")
                       .join(joined.withColumnRenamed("id", "t"), "t", "left")
                       .select("t", "first", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
                               F.coalesce("component", "t").alias("c")))
    heads = materialise(each.groupBy("c").agg(F.min("first").alias("head")))
    result = materialise(each.join(heads, "c").select("t", "n_links", "head"))
    none = F.struct("doc", "digest")
    return (who.join(result.withColumnRenamed("t", "rt"), who.t == F.col("rt"), "left")
            .withColumn("head", F.coalesce("head", none))
            .select("doc_id", "doc", "digest", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                    F.col("head.doc").alias("component_id"), F.col("head.digest").alias("component_digest")))


def join(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_links, component_id of every document."""
    component = F.when(F.col("component_id") != NULL_ID, F.col("component_id"))
    return classes(docs, **options).select("doc_id", "n_links", component.alias("component_id"))


def first_of_each(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` whose document is the smallest of its component; of equal rows one.

    Rows without a shingle all stay.
    """
    found = materialise(classes(docs, **options))
    keep = (found.filter("digest is not null and doc = component_id and digest = component_digest")
            .groupBy(F.col("doc").alias("_nj_doc"), F.col("digest").alias("_nj_digest")).agg(F.count("*").alias("_nj_rows"),
                                                                                            F.max("n_links").alias("_nj_links")))
    keep = materialise(keep)
    rows = docs.select(F.struct(*docs.columns).alias("_nj_row"),
                       F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("_nj_key"), F.md5("text").alias("_nj_md5"))
    stay = rows.join(keep, (F.col("_nj_key") == F.col("_nj_doc")) & (F.col("_nj_md5") == F.col("_nj_digest")))
    repeated = (F.col("_nj_rows") > 1) & (F.col("_nj_links") > 0)
    once = stay.filter(~repeated).select("_nj_row")
    again = stay.filter(repeated).dropDuplicates(["_nj_doc", "_nj_digest"]).select("_nj_row")
    null = rows.filter("_nj_md5 is null").select("_nj_row")
    return once.union(again).union(null).select("_nj_row.*")
