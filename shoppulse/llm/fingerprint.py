"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A paragraph is a line, cut further where its words say so: after a word whose
hash, taken with that of the word before it, is below 1 / ``PIECE_WORDS`` of all
values.  An inserted word thus changes the pieces around it and no others.  Its
digest is a 64-bit hash, the n-th repetition within a document having a digest
of its own, so a document is a set of digests.  A sketch adds every digest to
three of its cells, each holding a count, the xor of the digests and the xor of
their check sums.

The published fingerprint is the number of digests and a sketch in base64, of
the smallest size ``CELLS`` * 2**k with ``ROOM`` cells a digest that peels; one
that does not is made again with twice the cells.  Cells of a larger sketch fold
into those of a smaller one, so any two fingerprints can be subtracted cell by
cell.  Peeling then takes digests out of cells that hold just one, which recovers
all digests in which the two versions differ, or fails if the sketch is too small
for them.  Then the two are compared at their full sizes, each peeled by itself.
From the differing digests and the set sizes follows the likeness, shared digests
by all digests.  ``likeness_of`` gives it for two published fingerprints, and
``near_edited`` and ``near_next`` are its values.

Defined cases: null counts as the empty text, whose sketch is empty; two empty
texts have likeness 1; equal texts have equal fingerprints and likeness 1; in
``with_next`` repeated ids are ordered by text, a null id comes first, and a
single row is its own successor; an empty table gives an empty result; extra
columns are not read.
"""

import base64
import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import NULL_ID
from ._text import U64, mix64, prefix, span, text_slices, utf8, word_bounds

PIECE_WORDS = 16
CELLS = 24
ROOM = 1.5
GROWTH = 2
ROUNDS = 400
SEEDS = np.array([0x8CB92BA72F3D8DD7, 0xABF7A5E1D9C3B24F, 0x5851F42D4C957F2D], U64)
CHECK = U64(0xD6E8FEB86659FD93)
BATCH_BYTES = 1 << 20


def digests(offsets: np.ndarray, data: np.ndarray):
    """(digest, row) of every paragraph of every row."""
    start, end, row = word_bounds(data, offsets)
    if not len(start):
        return np.zeros(0, U64), np.zeros(0, np.int64)
    line = np.cumsum(data == 0x0A)[start]
    fresh = np.ones(len(start), bool)
    fresh[1:] = (line[1:] != line[:-1]) | (row[1:] != row[:-1])
    p = prefix(data)
    word = span(p, start, end)
    before = np.where(fresh, U64(0), np.append(U64(0), word[:-1]))
    fresh[1:] |= (mix64(word + before * CHECK) < U64((1 << 64) // PIECE_WORDS))[:-1]
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(start)) - 1
    h, row = span(p, start[first], end[last]), row[first]
    order = np.lexsort((h, row))
    hs, rs = h[order], row[order]
    new = np.ones(len(hs), bool)
    new[1:] = (hs[1:] != hs[:-1]) | (rs[1:] != rs[:-1])
    at = np.arange(len(hs))
    nth = at - np.maximum.accumulate(np.where(new, at, 0))
    return mix64(hs + nth.astype(U64) * CHECK), rs


def check_sum(keys: np.ndarray) -> np.ndarray:
    return (mix64(keys * CHECK) >> U64(32)).astype(np.uint32)


def cell_numbers(keys: np.ndarray, cells: int) -> np.ndarray:
    """Three cells of every digest, one in each third of the sketch."""
    third = U64(cells // 3)
    return np.stack([((mix64(keys ^ s) >> U64(32)) * third >> U64(32)).astype(np.int64) + k * int(third)
                     for k, s in enumerate(SEEDS)])


class Sketches:
    """Sketches of ``cells`` cells for ``n`` sets."""

    def __init__(self, n: int, cells: int):
        self.n, self.cells = n, cells
        self.count = np.zeros(n * cells, np.int32)
        self.keys = np.zeros(n * cells, U64)
        self.sums = np.zeros(n * cells, np.uint32)

    def add(self, keys: np.ndarray, row: np.ndarray, sign=1) -> np.ndarray:
        at = cell_numbers(keys, self.cells) + row * self.cells
        sums = check_sum(keys)
        for cell in at:
            np.add.at(self.count, cell, sign)
            np.bitwise_xor.at(self.keys, cell, keys)
            np.bitwise_xor.at(self.sums, cell, sums)
        return at

    def minus(self, other: "Sketches") -> "Sketches":
        out = Sketches(0, self.cells)
        out.n = self.n
        out.count, out.keys, out.sums = self.count - other.count, self.keys ^ other.keys, self.sums ^ other.sums
        return out

    def pick(self, rows: np.ndarray) -> "Sketches":
        out = Sketches(0, self.cells)
        out.n = len(rows)
        for name in ("count", "keys", "sums"):
            setattr(out, name, getattr(self, name).reshape(self.n, self.cells)[rows].ravel())
        return out

    def fold(self, cells: int) -> "Sketches":
        """The same sets in fewer cells: neighbours within a third add up."""
        if cells == self.cells:
            return self
        out = Sketches(0, cells)
        out.n, shape = self.n, (self.n * cells, self.cells // cells)
        out.count = self.count.reshape(shape).sum(1, dtype=np.int32)
        out.keys = np.bitwise_xor.reduce(self.keys.reshape(shape), axis=1)
        out.sums = np.bitwise_xor.reduce(self.sums.reshape(shape), axis=1)
        return out

    def peel(self):
        """Take all digests out: (row, digest, sign, failed rows).  The sketches are used up."""
        rows, keys, signs = [], [], []
        look = np.flatnonzero(self.count)
        for _ in range(ROUNDS):
            pure = look[(np.abs(self.count[look]) == 1) & (check_sum(self.keys[look]) == self.sums[look])]
            if not len(pure):
                break
            row, key, sign = pure // self.cells, self.keys[pure], self.count[pure]
            order = np.lexsort((key, row))
            row, key, sign = row[order], key[order], sign[order]
            one = np.ones(len(row), bool)
            one[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1])
            row, key, sign = row[one], key[one], sign[one]
            rows.append(row)
            keys.append(key)
            signs.append(sign)
            look = np.unique(self.add(key, row, -sign))
        left = (self.count != 0) | (self.keys != 0) | (self.sums != 0)
        failed = np.unique(np.flatnonzero(left) // self.cells)
        if not rows:
            return np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(0, np.int32), failed
        return np.concatenate(rows), np.concatenate(keys), np.concatenate(signs), failed


def sketch(keys, row, n: int, cells: int = CELLS) -> Sketches:
    out = Sketches(n, cells)
    out.add(keys, row)
    return out


def rows_of(keys, row, rows, n):
    """The digests of chosen rows, renumbered."""
    place = np.full(n, -1)
    place[rows] = np.arange(len(rows))
    got = place[row]
    return keys[got >= 0], got[got >= 0]


class Prints:
    """The published sketches of ``n`` sets, in groups of one size, and what peels out of them."""

    def __init__(self, keys: np.ndarray, row: np.ndarray, n: int):
        self.sizes = np.bincount(row, minlength=n)
        self.group, self.place, self.groups = np.zeros(n, np.int64), np.zeros(n, np.int64), []
        level = np.ceil(np.log2(np.maximum(self.sizes * ROOM / CELLS, 1))).astype(np.int64)
        todo, got_rows, got_keys = np.arange(n), [], []
        while len(todo):
            again = []
            for k in np.unique(level[todo]):
                rows = todo[level[todo] == k]
                s = sketch(*rows_of(keys, row, rows, n), len(rows), CELLS * GROWTH ** int(k))
                at, key, _, failed = s.pick(np.arange(len(rows))).peel()
                fine = np.setdiff1d(np.arange(len(rows)), failed)
                self.group[rows[fine]], self.place[rows[fine]] = len(self.groups), np.arange(len(fine))
                self.groups.append(s.pick(fine))
                whole = np.isin(at, fine)
                got_rows.append(rows[at[whole]])
                got_keys.append(key[whole])
                again.append(rows[failed])
            todo = np.concatenate(again)
            level[todo] += 1
        self.row = np.concatenate(got_rows) if got_rows else np.zeros(0, np.int64)
        self.keys = np.concatenate(got_keys) if got_keys else np.zeros(0, U64)

    def texts(self) -> list[str]:
        out = np.empty(len(self.sizes), object)
        for g, s in enumerate(self.groups):
            rows = np.flatnonzero(self.group == g)
            rows = rows[np.argsort(self.place[rows])]
            out[rows] = to_text(s, self.sizes[rows])
        return out.tolist()


def nearness(a: Prints, i: np.ndarray, b: Prints, j: np.ndarray) -> np.ndarray:
    """Likeness of the i-th sketches of ``a`` and the j-th of ``b``, pair by pair."""
    diff, far = np.zeros(len(i), np.int64), []
    kind = a.group[i] * len(b.groups) + b.group[j]
    for k in np.unique(kind):
        at = np.flatnonzero(kind == k)
        x, y = a.groups[k // len(b.groups)].pick(a.place[i[at]]), b.groups[k % len(b.groups)].pick(b.place[j[at]])
        cells = min(x.cells, y.cells)
        row, _, _, failed = x.fold(cells).minus(y.fold(cells)).peel()
        diff[at] = np.bincount(row, minlength=len(at))
        far.append(at[failed])
    far = np.concatenate(far) if far else np.zeros(0, np.int64)
    if len(far):
        shared = common(a, i[far], b, j[far])
        diff[far] = a.sizes[i[far]] + b.sizes[j[far]] - 2 * shared
    return likeness(diff, a.sizes[i], b.sizes[j])


def common(a: Prints, i: np.ndarray, b: Prints, j: np.ndarray) -> np.ndarray:
    """Digests that both of a pair peel to, at their full sizes."""
    sides = []
    for prints, rows in ((a, i), (b, j)):
        order = np.argsort(prints.row, kind="stable")
        begin = np.searchsorted(prints.row[order], rows)
        n = np.searchsorted(prints.row[order], rows, "right") - begin
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        sides.append((np.repeat(np.arange(len(rows)), n), prints.keys[order][np.repeat(begin, n) + within]))
    pair, key = (np.concatenate([one, two]) for one, two in zip(*sides))
    order = np.lexsort((key, pair))
    pair, key = pair[order], key[order]
    twice = (pair[1:] == pair[:-1]) & (key[1:] == key[:-1])
    return np.bincount(pair[1:][twice], minlength=len(i))


def difference(left: str | None, right: str | None):
    """(digests only in left, digests only in right) of two texts, as sorted lists."""
    a, b = (digests(*utf8(pa.array([t or ""], pa.string()))) for t in (left, right))
    cells = CELLS
    while True:
        _, key, sign, failed = sketch(*a, 1, cells).minus(sketch(*b, 1, cells)).peel()
        if not len(failed):
            return sorted(key[sign > 0].tolist()), sorted(key[sign < 0].tolist())
        cells *= GROWTH


def likeness(diff, size_a, size_b):
    """Shared digests by all digests; 1 for two empty sets."""
    shared = (size_a + size_b - diff) / 2
    both = shared + diff
    return np.where(both > 0, shared / np.maximum(both, 1), 1.0)


def to_text(s: Sketches, sizes: np.ndarray) -> list[str]:
    """Published form: number of digests, ':' and the cells in base64."""
    cells = np.zeros((s.n, s.cells), np.dtype([("count", "<u2"), ("keys", "<u8"), ("sums", "<u4")]))
    for name in ("count", "keys", "sums"):
        cells[name] = getattr(s, name).reshape(s.n, s.cells)
    return [f"{n}:{base64.b64encode(c.tobytes()).decode()}" for n, c in zip(sizes.tolist(), cells)]


def from_text(value: str) -> tuple[Sketches, int]:
    n, _, raw = value.partition(":")
    cells = np.frombuffer(base64.b64decode(raw), np.dtype([("count", "<u2"), ("keys", "<u8"), ("sums", "<u4")]))
    out = Sketches(1, len(cells))
    out.count = cells["count"].astype(np.int32)
    out.keys, out.sums = cells["keys"].astype(U64), cells["sums"].astype(np.uint32)
    return out, int(n)


def alone(s: Sketches, n: int) -> set:
    """The digests of one published sketch."""
    s.count = s.count.astype(np.int16).astype(np.int32)
    _, key, _, failed = s.peel()
    if len(failed) or len(key) != n:
        raise ValueError("not a published fingerprint")
    return set(key.tolist())


def likeness_of(a: str, b: str) -> float:
    """Likeness of two published fingerprints."""
    (x, n), (y, m) = from_text(a), from_text(b)
    cells = min(x.cells, y.cells)
    d = x.fold(cells).minus(y.fold(cells))
    d.count = d.count.astype(np.int16).astype(np.int32)  # published counts are modulo 65536
    row, _, _, failed = d.peel()
    diff = len(alone(x, n) ^ alone(y, m)) if len(failed) else len(row)
    return float(likeness(np.array(diff), n, m))


def edit(text: str, following: str) -> str:
    """The second half replaced by the first half's length of the following text."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def prints_of(texts: list[str]) -> Prints:
    return Prints(*digests(*utf8(pa.array(texts, pa.large_string()))), len(texts))


def compare(ids, texts: list[str], own: np.ndarray, digest) -> pa.RecordBatch:
    """The results of the texts ``own``, each of which is followed by its successor."""
    edited = [edit(texts[k], texts[k + 1]) for k in own]
    before, after = prints_of(texts), prints_of(edited)
    published = before.texts()
    return pa.RecordBatch.from_pydict({
        "doc_id": ids, "n_chars": pa.array([len(texts[k]) for k in own], pa.int64()),
        "edited_sha256": pa.array([digest(e.encode()) for e in edited], pa.string()),
        "fingerprint": pa.array([published[k] for k in own], pa.string()),
        "edited_fingerprint": pa.array(after.texts(), pa.string()),
        "near_edited": pa.array(nearness(before, own, after, np.arange(len(own))), pa.float64()),
        "near_next": pa.array(nearness(before, own, before, own + 1), pa.float64())})


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_paragraphs, fingerprint) of every document, in the task that reads it."""
    def run(batches):
        for batch in batches:
            for i, j, off, data in text_slices(batch):
                prints = Prints(*digests(off, data), j - i)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, j - i), pa.array(prints.sizes), pa.array(prints.texts(), pa.string())],
                    names=["doc_id", "n_paragraphs", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_paragraphs long, fingerprint string")


def in_order(docs: DataFrame) -> DataFrame:
    """Rows in id order in ranges, each range followed by a copy of the next one's first id.

    The ids alone are range-partitioned to find the ranges; the smallest id of
    each (one number a range) comes to the driver.  Texts are shuffled once.
    Columns: bucket, guest, sort_id, doc_id, text.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"),
                    F.coalesce("doc_id", F.lit(NULL_ID)).alias("sort_id"))
    heads = (d.select("sort_id").repartitionByRange(4 * parts, "sort_id")
             .groupBy(F.spark_partition_id().alias("p")).agg(F.min("sort_id").alias("head")).collect())
    heads = np.array(sorted(r.head for r in heads), np.int64)

    n = len(heads)

    @F.pandas_udf("own int, first boolean")
    def place(ids: pd.Series) -> pd.DataFrame:
        x = ids.to_numpy()
        own = np.searchsorted(heads, x, "right") - 1
        return pd.DataFrame({"own": own.astype(np.int32), "first": heads[own] == x})

    d = d.withColumn("place", place("sort_id")).select("*", "place.own", "place.first").drop("place")
    before = F.pmod(F.col("own") - 1 + F.lit(n), F.lit(max(n, 1)))
    seats = F.when(F.col("first"), F.array(F.struct(F.col("own").alias("bucket"), F.lit(0).alias("guest")),
                                  F.struct(before.alias("bucket"), F.lit(1).alias("guest")))) \
        .otherwise(F.array(F.struct(F.col("own").alias("bucket"), F.lit(0).alias("guest"))))
    return (d.withColumn("seat", F.explode(seats))
            .select("seat.bucket", "seat.guest", "sort_id", "doc_id", "text")
            .repartition(parts, "bucket").sortWithinPartitions("bucket", "guest", "sort_id", "text"))


def with_next(docs: DataFrame) -> DataFrame:
    """Every document beside its edited text and its successor in ascending doc_id.

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    """
    def run(batches):
        def digest(b):
            return hashlib.sha256(b).hexdigest()

        held: list = []  # rows (bucket, guest, id, text) still without their successor
        size = 0

        def flush(rows):
            own = [k for k, (a, b) in enumerate(zip(rows, rows[1:])) if not a[1] and a[0] == b[0]]
            if own:
                yield compare(pa.array([rows[k][2] for k in own], pa.int64()), [r[3] for r in rows], np.array(own), digest)

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("bucket", "guest", "doc_id", "text"))):
                held.append(row)
                size += len(row[3])
                if size > BATCH_BYTES and len(held) > 1:
                    yield from flush(held)
                    held, size = held[-1:], len(held[-1][3])
        yield from flush(held)

    schema = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
              "edited_fingerprint string, near_edited double, near_next double")
    return in_order(docs).mapInArrow(run, schema)
