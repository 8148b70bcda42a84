"""Periodic runs of words in every document, by a dictionary of basic factors.

A run is a stretch of words with smallest period q, at least ``least`` words
and two periods long, that no neighbouring word extends.  For each power of two
L the factors of L words are named: two have one name if and only if they are
equal (the names of L words come from pairs of names of L/2).  A run of period
p with L <= p < 2L holds equal factors of L words p apart, so it is enough to
look at occurrences of a name within 2L words.  Successive occurrences at most
L/2 apart form an arithmetic progression (the factor then has that period);
between progressions the gaps are larger, so at most three further ones begin
within 2L.  The periods proposed are the distances from an occurrence to the
first of each following progression, and from the last of each preceding one to
it.  Those are all periods needed: either an end of the progression at one place
is mapped onto the same end of the one a period later, or the run begins where
the later progression begins less one period.  A proposal is extended to both
sides by names of falling length; equal stretches keep their smallest period.

The texts of a slice are named together with names of their own, numbered by
document, so no factor crosses documents.  Factors that occur once in a
document need no name at greater lengths, which leaves little after the first
few lengths of ordinary text.

Defined cases: a null or empty text, or one of separators alone, has no words
and no runs; a null doc_id is never edited by :func:`stretched`; equal texts and
repeated rows are handled row by row; an empty table gives an empty result;
extra columns are not read, whatever their names.  Runs may overlap; of equally
long ones the one that starts first counts as the longest, then the one of
smaller period.  A document is one unit of work: a very long text needs memory
for its words and for each length at which factors still repeat.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import text_slices, word_bounds

LEAST = 12
#: Progressions that can begin within twice the factor length.
HOPS = 3


class Names:
    """Names of all factors of one length: -1 where the factor occurs only once."""

    def __init__(self, at: np.ndarray, keys: np.ndarray, n: int):
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        group = np.cumsum(new) - 1
        again = np.bincount(group, minlength=1)[group] > 1 if len(group) else np.zeros(0, bool)
        self.at, self.group = at[order[again]], group[again]  # by name, then by place
        self.of = np.full(n + 1, -1, np.int32)
        self.of[self.at] = self.group


def _proposed(names: Names, length: int):
    """(place, period) proposed by the progressions of factors of this length."""
    at, group = names.at, names.group
    head = np.ones(len(at), bool)
    head[1:] = (group[1:] != group[:-1]) | (2 * (at[1:] - at[:-1]) > length)
    series = np.cumsum(head) - 1
    begin = np.flatnonzero(head)
    first, last = at[begin], at[np.append(begin[1:], len(at)) - 1]
    name = group[begin]
    places, periods = [], []
    for hop in range(1, HOPS + 1):
        other = np.minimum(series + hop, len(begin) - 1)
        p = first[other] - at
        ok = (name[other] == group) & (p >= length) & (p < 2 * length)
        places.append(at[ok])
        periods.append(p[ok])
        other = np.maximum(series - hop, 0)
        p = at - last[other]
        ok = (name[other] == group) & (p >= length) & (p < 2 * length)
        places.append(last[other[ok]])
        periods.append(p[ok])
    place, period = np.concatenate(places), np.concatenate(periods)
    order = np.lexsort((place, period))
    place, period = place[order], period[order]
    keep = np.ones(len(place), bool)  # overlapping proposals of one period are one stretch
    keep[1:] = (period[1:] != period[:-1]) | (place[1:] - place[:-1] > length)
    return place[keep], period[keep]


def _extended(levels: list, place: np.ndarray, period: np.ndarray, length: int, n: int):
    """(start, end) of the stretches that keep the period around equal factors."""
    a, b = place + length, place + period + length
    lo, hi = place.copy(), place + period
    for k in range(len(levels) - 1, -1, -1):
        of, step = levels[k].of, 1 << k
        while True:
            x = of[np.minimum(a, n)]
            on = (x >= 0) & (x == of[np.minimum(b, n)])
            a, b = a + on * step, b + on * step
            y = of[np.where(lo >= step, lo - step, n)]
            back = (y >= 0) & (y == of[np.where(lo >= step, hi - step, n)])
            lo, hi = lo - back * step, hi - back * step
            if k < len(levels) - 1 or not (on.any() or back.any()):
                break
    return lo, b


def find_runs(words: np.ndarray, doc: np.ndarray, least: int = LEAST):
    """(start, length, period) of all runs of word numbers ``words`` (>= 0), ``doc`` being each word's document.

    Places count over all documents; the result is ordered by start, then period.
    """
    n = len(words)
    empty = np.zeros(0, np.int64)
    if not n:
        return empty, empty, empty
    levels = [Names(np.arange(n), doc.astype(np.int64) * (int(words.max()) + 1) + words, n)]
    longest = int(np.bincount(doc).max())
    found = []
    while len(levels[-1].at):
        k = len(levels) - 1
        length = 1 << k
        if 2 * length <= longest:
            place, period = _proposed(levels[k], length)
            found.append((place, period, np.full(len(place), length)))
        of = levels[k].of
        left = np.flatnonzero(of[:max(n - length, 0)] >= 0)
        right = of[left + length]
        left, right = left[right >= 0], right[right >= 0]
        levels.append(Names(left, of[left].astype(np.int64) * (n + 1) + right, n))
    levels.pop()
    if not found:
        return empty, empty, empty
    place, period, length = (np.concatenate(x) for x in zip(*found))
    start, end = _extended(levels, place, period, length, n)
    ok = (end - start >= least) & (end - start >= 2 * period)
    start, end, period = start[ok], end[ok], period[ok]
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    keep = np.ones(len(start), bool)
    keep[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, period = start[keep], end[keep], period[keep]
    order = np.lexsort((period, start))
    return start[order], (end - start)[order], period[order]


def kept_words(n: int, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """False for every word that a run holds after its first period."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, start + period, 1)
    np.add.at(edge, start + length, -1)
    return np.cumsum(edge[:-1]) == 0


def joined(data: np.ndarray, start: np.ndarray, end: np.ndarray, counts: np.ndarray) -> list:
    """The words of each document joined by one space, as bytes."""
    size = end - start + 1  # the word and the byte after it
    upto = np.cumsum(size)
    out = np.append(data, np.uint8(0x20))[np.repeat(start - (upto - size), size) + np.arange(upto[-1])] if len(size) else data[:0]
    out[upto - 1] = 0x20
    ends = np.concatenate([[0], upto])[np.concatenate([[0], np.cumsum(counts)])]
    raw = out.tobytes()
    return [raw[a:max(b - 1, a)] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]


def stretched(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """(a, p): from word a on, the words repeat with period p; None for a text left as it is."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def collapse(docs: DataFrame, least: int = LEAST, edit=None) -> DataFrame:
    """Runs and collapsed text of every document.

    ``edit(doc_id, n)`` may give (a, p) for a text to be stretched before.
    Columns: doc_id, n_words, runs (array of start, length, period by start,
    then period), collapsed (the kept words joined by one space).
    """
    def run(batches):
        for batch in batches:
            ids_of = batch.column("doc_id")
            for i, j, off, data in text_slices(batch):
                start, end, doc = word_bounds(data, off)
                counts = np.bincount(doc, minlength=j - i)
                begin = np.cumsum(counts) - counts
                source = np.arange(len(start))
                if edit is not None:
                    for k, d in enumerate(ids_of.slice(i, j - i).to_pylist()):
                        cut = edit(d, int(counts[k]))
                        if cut:
                            a, p = cut
                            source[begin[k] + a:begin[k] + counts[k]] = begin[k] + a + np.arange(counts[k] - a) % p
                size = end - start
                inside = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())
                bounds = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
                strings = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(bounds), pa.py_buffer(data[inside])])
                words = strings.dictionary_encode().indices.to_numpy()[source]
                at, length, period = find_runs(words, doc, least)
                kept = kept_words(len(words), at, length, period)
                left = source[kept]
                texts = joined(data, start[left], end[left], np.bincount(doc[kept], minlength=j - i))
                of = doc[at] if len(at) else np.zeros(0, np.int64)
                ends = np.searchsorted(of, np.arange(j - i + 1)).astype(np.int32)
                runs = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(
                    [pa.array(at - begin[of], pa.int64()), pa.array(length, pa.int64()), pa.array(period, pa.int64())],
                    names=["start", "length", "period"]))
                yield pa.RecordBatch.from_arrays(
                    [ids_of.slice(i, j - i), pa.array(counts, pa.int64()), runs, pa.array(texts, pa.binary()).cast(pa.string(), safe=False)],
                    names=["doc_id", "n_words", "runs", "collapsed"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run and the digests of ``collapse``'s result."""
    best = F.expr("""array_max(transform(runs, r -> struct(r.length, -r.start AS start, -r.period AS period)))""")
    listed = F.expr("""concat_ws('', transform(runs, r -> concat_ws(',', r.start, r.length, r.period) || '\n'))""")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
