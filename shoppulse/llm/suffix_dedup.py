"""Suffix-array dedup: bytes covered by a 100-byte string that also starts earlier go.

Earlier is a smaller doc_id, or an earlier start in the same document; strings
never cross documents.  Four steps:

1. *Regions.*  Of every 100-byte string the 50-byte piece with the smallest hash
   is its anchor (equal strings have equal anchors in equal places).  Anchors are
   shuffled by hash; only strings whose anchor occurs twice can repeat, so the
   suffix arrays are built over the bytes around such anchors.  No string that
   repeats is lost by this.
2. *Shards.*  The regions of a few megabytes of documents make a shard.  Its
   suffix array is refined by Larsson and Sadakane's doubling, eight bytes first,
   until strings of 100 bytes are told apart; Kasai's rule (along a diagonal the
   common prefix shrinks by one a byte) gives the common prefixes of neighbours,
   and neighbours with 100 bytes in common form a class.  All but the earliest
   start of a class are repeats.
3. *Merging.*  Each shard sends the starts that are first in it, beside their
   anchor, sorted; shards that share an anchor meet, and their sorted keys are
   merged by binary search, so all but the earliest start of a string over all
   shards are repeats too.  An anchor with many first starts in one shard is hot:
   its strings are dealt by their own hash instead, from every shard.
4. *Cut.*  The repeated starts of a document come together and its covered bytes
   are removed.

Defined cases: null counts as the empty text; texts under 100 bytes have no
string; repeated rows (same id, same text) count as one document, all its rows
get the same result; equal ids with different texts are ordered by a hash; a
null id comes first; extra columns are not read; an empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import NULL_ID, materialise, release
from ._text import BYTE, INVERSE, U64, ints, mix64, powers, prefix, text_slices, utf8

LENGTH = 100
PIECE = 50
#: Anchor positions of one string.
REACH = LENGTH - PIECE + 1
SHARD_BYTES = 2 << 20
#: Anchors whose strings are merged at once.
MERGE_ROWS = 1 << 14
HOT = 8
NONE = np.uint32(0xFFFFFFFF)


def sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """Minimum or maximum of every ``width`` neighbours."""
    out, have = x, 1
    while have * 2 <= width:
        out = pick(out[:len(out) - have], out[have:])
        have *= 2
    rest = width - have
    return pick(out[:len(out) - rest], out[rest:]) if rest else out


def anchors(off: np.ndarray, data: np.ndarray):
    """(position, hash, smallest) of all anchors, and the smallest piece hash of every string start.

    Positions count from the start of ``data``; ``low[s]`` is 0 where no whole
    string starts.
    """
    n = len(data) - PIECE + 1
    if len(data) < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(0, np.uint32), np.zeros(len(data), np.uint32)
    p = prefix(data)
    h = mix64((p[PIECE:] - p[:-PIECE]) * powers(len(p), INVERSE)[:n])
    s = np.minimum((h >> U64(32)).astype(np.uint32), NONE - np.uint32(1)) | np.uint32(1)
    end = np.repeat(off[1:], np.diff(off))
    inside = np.arange(n) + PIECE <= end[:n]
    s[~inside] = NONE
    low = sliding(s, REACH, np.minimum)
    low = np.where(np.arange(len(low)) + LENGTH <= end[:len(low)], low, 0)
    wide = np.zeros(n + REACH - 1, np.uint32)
    wide[REACH - 1:REACH - 1 + len(low)] = low
    at = np.flatnonzero((sliding(wide, REACH, np.maximum) == s) & inside)
    full = np.zeros(len(data), np.uint32)
    full[:len(low)] = low
    return at, h[at], s[at], full


def owners(at: np.ndarray, small: np.ndarray, low: np.ndarray) -> np.ndarray:
    """For every start the number of its anchor, the first that has its smallest hash; -1 without one."""
    out = np.full(len(low), -1, np.int64)
    left = np.flatnonzero(low)
    k = np.searchsorted(at, left)
    while len(left):
        found = small[k] == low[left]
        out[left[found]] = k[found]
        left, k = left[~found], k[~found] + 1
    return out


def _by_bucket(bucket: np.ndarray, columns: dict, kind: int):
    """One row of packed columns for each bucket."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    cut = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.zeros(0, np.int64)
    zip_ = zstandard.ZstdCompressor(level=1)
    out = {"bucket": bucket[cut].astype(np.int32), "kind": np.full(len(cut), kind, np.int32)}
    for name in PACKED:
        if name in columns:
            c = columns[name][order]
            out[name] = [zip_.compress(x.tobytes()) for x in np.split(c, cut[1:])] if len(cut) else []
        else:
            out[name] = [None] * len(cut)
    return pa.RecordBatch.from_pydict({k: pa.array(v, pa.binary() if k in PACKED else pa.int32()) for k, v in out.items()})


#: Packed columns: anchor or string key, document order and key, position, mask of starts, bytes around.
PACKED = ("key", "doc", "dkey", "pos", "mask", "bytes")
TYPES = {"key": np.uint64, "doc": np.int64, "dkey": np.int64, "pos": np.int32, "mask": np.uint64, "bytes": np.uint8}
SCHEMA = "bucket int, kind int, " + ", ".join(f"{c} binary" for c in PACKED)


def _unpack(rows: list) -> dict:
    """Columns of several packed rows, one after the other."""
    plain = zstandard.ZstdDecompressor()
    out = {}
    for name in PACKED:
        if rows[0][name] is not None:
            out[name] = np.concatenate([np.frombuffer(plain.decompress(r[name]), TYPES[name]) for r in rows])
    return out


def _buckets_of(keys: np.ndarray, n: int) -> np.ndarray:
    return ((keys >> U64(32)) * U64(n) >> U64(32)).astype(np.int32)


def _rows_by_bucket(batches):
    """Lists of packed rows of one bucket from batches sorted by bucket."""
    now, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if row["bucket"] != now:
                if held:
                    yield held
                now, held = row["bucket"], []
            held.append(row)
    if held:
        yield held


def _send(anchor_rows: DataFrame, run, schema: str) -> DataFrame:
    """Apply ``run`` to the packed rows of each bucket."""
    parts = int(anchor_rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return anchor_rows.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(run, schema)


# -- step 1 -----------------------------------------------------------------

def _anchor_rows(docs: DataFrame, buckets: int) -> DataFrame:
    """Anchors by hash bucket: kind 0 asks whether others have it; kind 1 repeats within the slice already."""
    def run(batches):
        for batch in batches:
            key = ints(batch.column("dkey"))
            for i, j, off, data in text_slices(batch):
                at, h, _, _ = anchors(off, data)
                if not len(at):
                    continue
                row = np.searchsorted(off, at, "right") - 1
                order = np.lexsort((at, h))
                at, h, row = at[order], h[order], row[order]
                new = np.append(True, h[1:] != h[:-1])
                new_row = new | np.append(True, row[1:] != row[:-1])
                keep = np.flatnonzero(new_row)  # one for each document
                within = np.diff(np.append(keep, len(at))) > 1
                at, h, row, new = at[keep], h[keep], row[keep], new[keep]
                dkey, pos = key[i:j][row], (at - off[row]).astype(np.int32)
                many = ~new | np.append(~new[1:], False) | within
                yield _by_bucket(_buckets_of(h[new], buckets), {"key": h[new], "dkey": dkey[new], "pos": pos[new]}, 0)
                if many.any():
                    # known to repeat: passed on as they are
                    yield _by_bucket(_buckets_of(mix64(dkey[many].view(U64)), buckets),
                                     {"dkey": dkey[many], "pos": pos[many]}, 1)

    return docs.mapInArrow(run, SCHEMA)


def _repeated(batches):
    for rows in _rows_by_bucket(batches):
        asked = [r for r in rows if r["kind"] == 0]
        known = [r for r in rows if r["kind"] == 1]
        dkey, pos = [], []
        if asked:
            c = _unpack(asked)
            order = np.argsort(c["key"])
            k = c["key"][order]
            same = k[1:] == k[:-1]
            two = np.append(False, same) | np.append(same, False)
            dkey.append(c["dkey"][order][two])
            pos.append(c["pos"][order][two])
        if known:
            c = _unpack(known)
            dkey.append(c["dkey"])
            pos.append(c["pos"])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(dkey)), pa.array(np.concatenate(pos))], names=["dkey", "pos"])


# -- step 2 -----------------------------------------------------------------

def suffix_array(data: np.ndarray, depth: int = LENGTH):
    """(order, class of each position): positions sorted by their first ``depth`` bytes (zeros beyond the end).

    Classes are numbered by their first place in the order.  Refinement doubles
    the sorted length and touches only classes of several positions.
    """
    n = len(data)
    wide = np.concatenate((data, np.zeros(depth + 8, np.uint8))).astype(U64)
    key = np.zeros(n, U64)
    for k in range(8):
        key = (key << U64(8)) | wide[k:k + n]
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    new = np.append(True, sorted_key[1:] != sorted_key[:-1])
    start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n + depth + 1, np.int64)
    rank[n:] = -1
    rank[order] = start
    have = 8
    while have < depth:
        ahead = min(have, depth - have)
        single = new & np.append(new[1:], True)
        open_ = np.flatnonzero(~single)
        if not len(open_):
            break
        pos = order[open_]
        first = rank[pos]
        second = rank[pos + ahead] + 1
        by = np.argsort(first * (n + 1) + second, kind="stable")
        pos, first, second = pos[by], first[by], second[by]
        order[open_] = pos
        fresh = np.append(True, (first[1:] != first[:-1]) | (second[1:] != second[:-1]))
        new[open_] = fresh
        begin = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        rank[pos] = begin[open_]
        have += ahead
    return order, rank[:n]


def common_prefixes(data: np.ndarray, order: np.ndarray, most: int = LENGTH) -> np.ndarray:
    """Common prefix, ``most`` at most, of each place of the suffix order with the place before it.

    By Kasai's rule: while a position and its predecessor in the order both move
    on by one byte, the common prefix shrinks by one.  Bytes are compared only at
    the last position of such a diagonal.
    """
    n = len(order)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    at = np.arange(n)
    last = np.ones(n, bool)
    last[:-1] = (before[1:] != before[:-1] + 1) | (before[:-1] < 0)
    ends = np.flatnonzero(last & (before >= 0))
    wide = np.concatenate((data, np.zeros(most + 8, np.uint8)))
    length = np.zeros(len(ends), np.int64)
    alive = np.arange(len(ends))
    for k in range(0, most, 4):  # four bytes a time while they agree
        a, b = ends[alive] + k, before[ends[alive]] + k
        for _ in range(4):
            ok = wide[a] == wide[b]
            length[alive[ok]] += 1
            alive, a, b = alive[ok], a[ok] + 1, b[ok] + 1
        if not len(alive):
            break
    found = np.zeros(n, np.int64)
    found[ends] = np.minimum(length, most)
    next_end = np.full(n, n, np.int64)
    next_end[last] = at[last]
    next_end = np.minimum.accumulate(next_end[::-1])[::-1]
    prefix_ = np.where(before >= 0, np.minimum(found[np.minimum(next_end, n - 1)] + next_end - at, most), 0)
    return prefix_[order]


def repeats(data: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Starts (of those marked in ``whole``) whose string starts earlier in ``data`` too."""
    order, _ = suffix_array(data)
    common = common_prefixes(data, order)
    head = np.append(True, common[1:] < LENGTH) if len(order) else np.zeros(0, bool)
    first = np.flatnonzero(head)
    marked = np.where(whole[order], order, len(data))
    early = np.minimum.reduceat(marked, first)
    out = np.zeros(len(data), bool)
    out[order] = marked > np.repeat(early, np.diff(np.append(first, len(order))))
    return out & whole


def _runs(mask: np.ndarray):
    """(first, length) of the runs of True."""
    edge = np.diff(np.concatenate(([0], mask.view(np.int8), [0])))
    first = np.flatnonzero(edge == 1)
    return first, np.flatnonzero(edge == -1) - first


def _run_batch(dkey, start, n) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(dkey), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32))],
                                      names=["dkey", "start", "n"])


class Shard:
    """Regions of documents, gathered until there are ``SHARD_BYTES`` of them."""

    def __init__(self, buckets: int):
        self.buckets, self.docs, self.size = buckets, {}, 0

    def add(self, doc: int, dkey: int, raw: np.ndarray, repeated: np.ndarray) -> None:
        if dkey not in self.docs:
            self.docs[dkey] = (doc, dkey, raw, repeated)
            self.size += len(raw)

    def finish(self):
        """(runs of repeats within the shard, packed rows of the starts that are first here)."""
        docs = [self.docs[k] for k in sorted(self.docs, key=lambda k: self.docs[k][:2])]
        self.docs, self.size = {}, 0
        off = np.concatenate(([0], np.cumsum([len(d[2]) for d in docs])))
        data = np.concatenate([d[2] for d in docs])
        at, h, small, low = anchors(off, data)
        row = np.searchsorted(off, at, "right") - 1
        # an anchor is suspect if it was asked for, or stands twice in its document or shard
        named = np.concatenate([d[3].astype(np.int64) + off[k] for k, d in enumerate(docs)])
        suspect = np.isin(at, named)
        order = np.argsort(h, kind="stable")
        twice = np.zeros(len(h), bool)
        if len(h) > 1:
            same = h[order][1:] == h[order][:-1]
            twice[order] = np.append(False, same) | np.append(same, False)
        suspect |= twice
        if not suspect.any():
            return None, []
        cover = np.zeros(len(data) + 1, np.int32)
        lo = np.maximum(at - (REACH - 1), off[row])[suspect]
        hi = np.minimum(at + LENGTH, off[row + 1])[suspect]
        np.add.at(cover, lo, 1)
        np.add.at(cover, hi, -1)
        region = np.cumsum(cover[:-1]) > 0
        # starts whose anchor is suspect
        owner = owners(at, small, low)
        mine = owner >= 0
        mine[mine] = suspect[owner[mine]]
        back = np.flatnonzero(region)
        part = data[back]
        # a start is whole within its region by construction of the regions
        gone = np.zeros(len(data), bool)
        gone[back] = repeats(part, mine[back])
        alive = np.flatnonzero(mine & ~gone)
        first, n = _runs(gone)
        # a run may not cross documents
        first, n = _split(first, n, off)
        place = np.searchsorted(off, first, "right") - 1
        dkeys = np.array([d[1] for d in docs], np.int64)
        ids = np.array([d[0] for d in docs], np.int64)
        runs = _run_batch(dkeys[place], first - off[place], n) if len(first) else None
        return runs, self._first_starts(data, off, at, h, row, alive, owner[alive], ids, dkeys)

    def _first_starts(self, data, off, at, h, row, alive, owner, ids, dkeys):
        """Packed rows of the anchors of the starts ``alive``."""
        if not len(alive):
            return []
        mask = np.zeros(len(at), U64)
        np.bitwise_or.at(mask, owner, U64(1) << (alive - at[owner] + REACH - 1).astype(U64))
        some = np.flatnonzero(mask)
        at, h, row, mask = at[some], h[some], row[some], mask[some]
        pos = (at - (REACH - 1) - off[row]).astype(np.int32)  # of the first possible start
        order = np.argsort(h, kind="stable")
        h, mask, pos, row, at = h[order], mask[order], pos[order], row[order], at[order]
        _, which, count = np.unique(h, return_inverse=True, return_counts=True)
        hot = count[which] > HOT
        wide = np.concatenate((np.zeros(REACH, np.uint8), data, np.zeros(LENGTH, np.uint8)))
        out = []
        for chosen in (~hot, hot):
            k = np.flatnonzero(chosen)
            for a in range(0, len(k), 1 << 15):
                b = k[a:a + (1 << 15)]
                around = wide[at[b][:, None] + np.arange(1, 1 + REACH - 1 + LENGTH)[None, :]]
                cols = {"key": h[b], "doc": ids[row[b]], "dkey": dkeys[row[b]], "pos": pos[b], "mask": mask[b], "bytes": around}
                if chosen is hot:
                    out.append(_strings(cols, self.buckets))
                else:
                    out.append(_by_bucket(_buckets_of(h[b], self.buckets), cols, 3))
        if hot.any():  # a mark for the other shards: no starts
            marks = np.unique(h[hot])
            none = np.zeros(len(marks), np.int64)
            out.append(_by_bucket(_buckets_of(marks, self.buckets), {
                "key": marks, "doc": none, "dkey": none, "pos": none.astype(np.int32), "mask": none.view(U64),
                "bytes": np.zeros((len(marks), REACH - 1 + LENGTH), np.uint8)}, 3))
        return out


def _split(first, n, off):
    """Cut runs at document bounds."""
    inner = off[1:-1]
    a = np.searchsorted(inner, first, "right")
    b = np.searchsorted(inner, first + n, "left")
    pieces = np.maximum(b - a, 0) + 1
    start = np.repeat(first, pieces)
    end = np.repeat(first + n, pieces)
    nth = np.arange(len(start)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    base = np.repeat(a, pieces)
    bounds = np.append(inner, np.iinfo(np.int64).max)
    lo = np.where(nth > 0, bounds[np.maximum(base + nth - 1, 0)], start)
    hi = np.minimum(end, bounds[np.minimum(base + nth, len(bounds) - 1)])
    keep = hi > lo
    return lo[keep], (hi - lo)[keep]


# -- step 3 -----------------------------------------------------------------

def _string_keys(cols: dict, block: int = 1 << 13):
    """(key, row, start within the row's mask) of every string named by the masks."""
    keys, rows, steps = [], [], []
    width = REACH - 1 + LENGTH
    table = cols["bytes"].reshape(-1, width)
    step, inv = powers(width + 1), powers(width + 1, INVERSE)
    for a in range(0, len(table), block):
        p = np.zeros((min(block, len(table) - a), width + 1), U64)
        np.cumsum(BYTE[table[a:a + block]] * step[None, :width], axis=1, out=p[:, 1:])
        h = (p[:, LENGTH:] - p[:, :-LENGTH]) * inv[None, :REACH]
        on = (cols["mask"][a:a + block, None] >> np.arange(REACH, dtype=U64)[None, :]) & U64(1) > 0
        r, j = np.nonzero(on)
        keys.append(mix64(h[r, j] ^ cols["key"][a:a + block][r]))
        rows.append(r + a)
        steps.append(j)
    return np.concatenate(keys), np.concatenate(rows), np.concatenate(steps)


def _strings(cols: dict, buckets: int) -> pa.RecordBatch:
    """The strings of packed anchors, dealt by their own keys (kind 4)."""
    key, row, j = _string_keys(cols)
    return _by_bucket(_buckets_of(key, buckets), {"key": key, "doc": cols["doc"][row], "dkey": cols["dkey"][row],
                                                  "pos": cols["pos"][row] + j.astype(np.int32)}, 4)


def later(key, doc, dkey, pos) -> np.ndarray:
    """Which entries have an earlier one of the same key: shards' entries, merged by binary search.

    Keys are sorted once; every entry finds the bounds of its key in them, and the
    earliest place between the bounds decides.
    """
    order = np.argsort(key, kind="stable")
    k = key[order]
    out = np.zeros(len(key), bool)
    shared = np.zeros(len(k), bool)
    same = k[1:] == k[:-1]
    shared[1:] |= same
    shared[:-1] |= same
    few = order[shared]
    if not len(few):
        return out
    few = few[np.lexsort((pos[few], dkey[few], doc[few], key[few]))]
    k = key[few]
    first = few[np.searchsorted(k, k, "left")]
    out[few] = (doc[few] != doc[first]) | (dkey[few] != dkey[first]) | (pos[few] != pos[first])
    return out


def _key_blocks(key: np.ndarray, most: int):
    """Ranges of about ``most`` sorted keys that tear no equal ones apart."""
    a = 0
    while a < len(key):
        b = min(a + most, len(key))
        b = int(np.searchsorted(key, key[b - 1], "right"))
        yield a, b
        a = b


def _as_runs(dkey, pos):
    order = np.lexsort((pos, dkey))
    d, p = dkey[order], pos[order].astype(np.int64)
    new = np.append(True, (d[1:] != d[:-1]) | (p[1:] > p[:-1] + 1))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(d)) - 1
    return d[first], p[first], p[last] - p[first] + 1


RUNS = "dkey long, start int, n int"
BOTH = ("bucket int, kind int, key binary, doc binary, dkey_ binary, pos binary, mask binary, bytes binary, "
        "run_dkey long, run_start int, run_n int")


def _both(packed: pa.RecordBatch | None = None, runs: pa.RecordBatch | None = None) -> pa.RecordBatch:
    """A row batch of the two kinds, the other's columns null."""
    n = (packed if packed is not None else runs).num_rows
    cols = {}
    for name, kind in [("bucket", pa.int32()), ("kind", pa.int32()), *((c, pa.binary()) for c in PACKED)]:
        cols[f"{name}_" if name == "dkey" else name] = packed.column(name) if packed is not None else pa.nulls(n, kind)
    for name, kind in (("dkey", pa.int64()), ("start", pa.int32()), ("n", pa.int32())):
        cols[f"run_{name}"] = runs.column(name) if runs is not None else pa.nulls(n, kind)
    return pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))


def _packed_rows(both: DataFrame, kind: int) -> DataFrame:
    return both.filter(F.col("kind") == kind).select("bucket", "kind", "key", "doc", F.col("dkey_").alias("dkey"), "pos", "mask", "bytes")


def _run_rows(both: DataFrame) -> DataFrame:
    return both.filter("run_n is not null").select(F.col("run_dkey").alias("dkey"), F.col("run_start").alias("start"), F.col("run_n").alias("n"))


def repeated_starts(docs: DataFrame) -> DataFrame:
    """(dkey, start, n): runs of repeated starts of ``docs(doc, dkey, text)``."""
    spark = docs.sparkSession
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    asked = _send(_anchor_rows(docs.select("dkey", "text"), buckets), _repeated, "dkey long, pos int")
    wanted = materialise(asked.groupBy(F.col("dkey").alias("w")).agg(F.collect_set("pos").alias("places")))
    release(spark)

    def shards(batches):
        shard = Shard(buckets)

        def done():
            runs, packed = shard.finish()
            if runs is not None:
                yield _both(runs=runs)
            for batch in packed:
                yield _both(packed=batch)

        for batch in batches:
            off, data = utf8(batch.column("text"))
            doc, dkey = ints(batch.column("doc")), ints(batch.column("dkey"))
            places = batch.column("places")
            for k in range(len(doc)):
                shard.add(int(doc[k]), int(dkey[k]), data[off[k]:off[k + 1]], places[k].values.to_numpy())
                if shard.size >= SHARD_BYTES:
                    yield from done()
        if shard.docs:
            yield from done()

    def merge(batches):
        for rows in _rows_by_bucket(batches):
            c = _unpack(rows)
            c["bytes"] = c["bytes"].reshape(-1, REACH - 1 + LENGTH)
            hot = np.isin(c["key"], c["key"][c["mask"] == 0])
            for chosen in (~hot, hot):
                k = np.flatnonzero(chosen & (c["mask"] != 0))
                k = k[np.argsort(c["key"][k], kind="stable")]
                for a, b in _key_blocks(c["key"][k], MERGE_ROWS):
                    part = {x: v[k[a:b]] for x, v in c.items()}
                    if chosen is hot:
                        yield _both(packed=_strings(part, buckets))
                        continue
                    key, row, j = _string_keys(part)
                    d, at = part["dkey"][row], part["pos"][row] + j.astype(np.int32)
                    again = later(key, part["doc"][row], d, at)
                    if again.any():
                        yield _both(runs=_run_batch(*_as_runs(d[again], at[again])))

    def merge_strings(batches):
        for rows in _rows_by_bucket(batches):
            c = _unpack(rows)
            again = later(c["key"], c["doc"], c["dkey"], c["pos"])
            if again.any():
                yield _run_batch(*_as_runs(c["dkey"][again], c["pos"][again]))

    within = materialise(docs.join(wanted, docs.dkey == wanted.w).select("doc", "dkey", "text", "places").mapInArrow(shards, BOTH))
    release(spark)
    across = materialise(_send(_packed_rows(within, 3), merge, BOTH))
    release(spark)
    strings = _packed_rows(within, 4).union(_packed_rows(across, 4))
    hot = _send(strings, merge_strings, RUNS)
    return _run_rows(within).union(_run_rows(across)).union(hot)


# -- step 4 -----------------------------------------------------------------

def cut(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray):
    """(kept bytes, number removed, maximal removed runs)."""
    cover = np.zeros(len(raw) + 1, np.int32)
    np.add.at(cover, starts, 1)
    np.add.at(cover, np.minimum(starts + lengths + LENGTH - 1, len(raw)), -1)
    gone = np.cumsum(cover[:-1]) > 0
    return raw[~gone], int(gone.sum()), len(_runs(gone)[0])


def dedup(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document (and ``kept``, the bytes, if asked)."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc"),
                       F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("dkey", F.xxhash64("doc", "text"))
    runs = materialise(repeated_starts(rows.filter(F.octet_length("text") >= LENGTH).select("doc", "dkey", "text"))
                       .groupBy(F.col("dkey").alias("r")).agg(F.collect_list(F.struct("start", "n")).alias("runs")))
    release(spark)
    both = rows.join(runs, rows.dkey == runs.r, "left").select("doc_id", "text", "runs")
    extra = ", kept binary" if with_text else ""

    def run(batches):
        for batch in batches:
            off, data = utf8(batch.column("text"))
            runs_ = batch.column("runs")
            n, out = len(off) - 1, {"n_removed": [], "n_spans": [], "kept_sha256": [], "kept": []}
            for k in range(n):
                raw = data[off[k]:off[k + 1]]
                got, removed, spans = raw, 0, 0
                if runs_[k].is_valid:
                    value = runs_[k].values
                    got, removed, spans = cut(raw, *(value.field(f).to_numpy().astype(np.int64) for f in (0, 1)))
                got = got.tobytes()
                out["n_removed"].append(removed)
                out["n_spans"].append(spans)
                out["kept_sha256"].append(hashlib.sha256(got).hexdigest())
                if with_text:
                    out["kept"].append(got)
            cols = [batch.column("doc_id"), pa.array(np.diff(off)), pa.array(out["n_removed"], pa.int64()),
                    pa.array(out["n_spans"], pa.int64()), pa.array(out["kept_sha256"], pa.string())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if with_text:
                cols, names = cols + [pa.array(out["kept"], pa.binary())], names + ["kept"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return both.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + extra)
