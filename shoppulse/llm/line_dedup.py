"""Line dedup by a deletion-neighbourhood join: lines within one edit of an earlier line go.

A line is the text between newlines, compared without white space at its ends;
lines of fewer than ``MIN_CHARS`` code points then left are compared for equality
only, if ``short`` is set (the query sets it), and kept otherwise.
Its order is (doc_id, line number).  A line is dropped if an earlier line is
equal or at edit distance one (code points).

Equal lines meet by hash, and a distinct line goes on with its earliest place.
Two lines one edit apart agree in their first or their second half (of the
shorter one's length), so only lines that share such a half with another line
emit variants: themselves and each text with one character left out, as hashed
keys.  Equal lengths join on the key with the place of the deletion (they differ
there at most), lengths one apart on the whole line and the deletions of the
longer one.  Distinct lines under one such key number no more than the
characters of the alphabet, however often a line is repeated.  Each line's
earliest partner is verified by its edit distance.

Defined cases: null text stays null and has no lines; repeated rows (same id,
same text) count as one document and lose the same lines; equal ids with
different texts are ordered by a hash of the text; a null id comes first; the
order of kept lines and all other columns stay as they are, also those named
like columns used inside; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import NULL_ID, materialise
from ._text import INVERSE, U64, ints, mix64, powers, prefix, span, text_slices, word_bounds

MIN_CHARS = 16
TAG = U64(0x9E6C63D0876A9A47)


def tagged(h: np.ndarray, *tags) -> np.ndarray:
    for t in tags:
        h = mix64(h ^ (np.atleast_1d(t).astype(U64) + U64(1)) * TAG)
    return h


def content_lines(off: np.ndarray, data: np.ndarray, least: int):
    """row, line number, hash, length and half keys of every line of at least ``least`` code points."""
    start, end, row = word_bounds(data, off)
    newline = np.concatenate(([0], np.cumsum(data == 0x0A)))
    line = newline[start] - newline[off[row]]
    first = np.ones(len(start), bool)
    first[1:] = (line[1:] != line[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(first)
    s, e = start[at], end[np.append(at[1:], len(start)) - 1] if len(at) else end
    row, line = row[at], line[at]
    lead = (data & 0xC0) != 0x80
    chars = np.concatenate(([0], np.cumsum(lead)))
    place = np.append(np.flatnonzero(lead), len(data))
    c, n = chars[s], chars[e] - chars[s]
    keep = n >= least
    s, e, row, line, c, n = (x[keep] for x in (s, e, row, line, c, n))
    p = prefix(data)
    half, less = place[c + n // 2], (n - 1) // 2
    keys = [tagged(span(p, s, half), n, 1), tagged(span(p, half, e), n, 2),
            tagged(span(p, s, place[c + less]), n - 1, 1), tagged(span(p, place[c + less + 1], e), n - 1, 2)]
    return row, line, span(p, s, e), n, keys


def variants(text: str):
    """(key, role) of a line: 0 the whole line, 1 deletions (for a shorter line), 2 deletions with their place."""
    data = np.frombuffer(text.encode(), np.uint8)
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    stop = np.append(lead[1:], len(data))
    p = prefix(data)
    # the hash of the bytes without [lead, stop): what follows moves left by that width
    inv = powers(len(data) + 1, INVERSE)
    raw = (p[lead] - p[0]) + (p[-1] - p[stop]) * inv[stop - lead]
    cut = mix64(raw + (len(data) - (stop - lead)).astype(U64))
    whole = span(p, np.array([0]), np.array([len(data)]))
    n = len(lead)
    deleted = np.unique(tagged(cut, n - 1, 3))
    keys = np.concatenate((tagged(whole, n, 3), deleted, tagged(cut, n, np.arange(n) + 8)))
    return keys, np.concatenate(([0], np.full(len(deleted), 1), np.full(n, 2)))


def _line_rows(docs: DataFrame, least: int, short: bool) -> DataFrame:
    """Lines with their half keys, which are null for lines too short for one-edit matches."""
    def run(batches):
        for batch in batches:
            doc, tie = ints(batch.column("doc")), ints(batch.column("tie"))
            for i, j, off, data in text_slices(batch):
                row, line, h, n, keys = content_lines(off, data, 1 if short else least)
                cols = [h.view(np.int64), doc[i:j][row], tie[i:j][row], line.astype(np.int32)]
                cols = [pa.array(c) for c in cols] + [pa.array(k.view(np.int64), mask=n < least) for k in keys]
                yield pa.RecordBatch.from_arrays(cols, names=["h", "doc", "tie", "line", "k1", "k2", "k3", "k4"])

    return docs.mapInArrow(run, "h long, doc long, tie long, line int, k1 long, k2 long, k3 long, k4 long")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc"),
                       F.xxhash64("text").alias("tie"), "text").filter("text is not null")


def near_lines(keyed: DataFrame, distinct: DataFrame) -> DataFrame:
    """(h) of the distinct lines that are one edit from an earlier one."""
    distinct = distinct.filter("k1 is not null")
    halves = distinct.select("h", F.explode(F.array("k1", "k2", "k3", "k4")).alias("key"))
    shared = materialise(halves.groupBy("key").count().filter("count > 1").select("key"))
    some = materialise(halves.join(shared, "key").select("h").distinct())
    wanted = (distinct.join(some, "h").select("h", "first")
              .groupBy(F.col("first.doc").alias("w_doc"), F.col("first.tie").alias("w_tie"))
              .agg(F.collect_list(F.struct("h", "first")).alias("wanted")))
    texts = (keyed.join(wanted, (keyed.doc == wanted.w_doc) & (keyed.tie == wanted.w_tie))
             .select(F.split("text", "\n").alias("lines"), F.explode("wanted").alias("w"))
             .select("w.h", "w.first", F.regexp_replace(
                 F.element_at("lines", F.col("w.first.line") + 1), r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "").alias("line")))
    texts = materialise(texts.dropDuplicates(["h"]))

    def emit(batches):
        for batch in batches:
            h = ints(batch.column("h"))
            keys, rows, roles, size = [], [], [], 0
            lines = batch.column("line")
            for k in range(len(h)):
                key, role = variants(lines[k].as_py())
                keys.append(key)
                roles.append(role)
                rows.append(np.full(len(key), k))
                size += len(key)
                if size > 1 << 18 or k == len(h) - 1:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(keys).view(np.int64)), pa.array(h[np.concatenate(rows)]),
                         pa.array(np.concatenate(roles).astype(np.int32))], names=["key", "h", "role"])
                    keys, rows, roles, size = [], [], [], 0

    rows = texts.select("h", "line").mapInArrow(emit, "key long, h long, role int")
    joint = materialise(rows.groupBy("key").count().filter("count > 1").select("key"))
    members = materialise(rows.join(joint, "key").join(texts.select("h", "first"), "h"))
    who = F.struct("first", "h")
    best = materialise(members.groupBy("key").agg(*[F.min(F.when(F.col("role") == r, who)).alias(f"m{r}") for r in (0, 1, 2)]))
    partner = F.when(F.col("role") == 2, F.col("m2")).when(F.col("role") == 1, F.col("m0")).otherwise(F.col("m1"))
    pairs = (members.join(best, "key").withColumn("other", partner)
             .filter(F.col("other").isNotNull() & (F.col("other.first") < F.col("first")))
             .groupBy("h").agg(F.min("other").alias("other")).select("h", F.col("other.h").alias("other_h")))
    pairs = materialise(pairs)
    a = texts.select("h", F.col("line").alias("a"))
    b = texts.select(F.col("h").alias("other_h"), F.col("line").alias("b"))
    checked = materialise(pairs.join(a, "h")).join(b, "other_h")
    return checked.filter(F.levenshtein("a", "b", 1) >= 0).select("h")


def drops(docs: DataFrame, least: int = MIN_CHARS, short: bool = False) -> DataFrame:
    """(doc, tie, dropped): the line numbers that go, ascending, of every document that loses any."""
    keyed = _keyed(docs)
    lines = materialise(_line_rows(keyed, least, short))
    place = F.struct("doc", "tie", "line")
    distinct = materialise(lines.groupBy("h").agg(
        F.min(place).alias("first"), F.count("*").alias("n"), *[F.first(k).alias(k) for k in ("k1", "k2", "k3", "k4")]))
    near = materialise(near_lines(keyed, distinct).withColumn("near", F.lit(True)))
    gone = materialise(distinct.select("h", "first", "n").join(near, "h", "left")
                       .filter("n > 1 or near").select("h", "first", "near"))
    rows = (lines.select("h", "doc", "tie", "line").join(gone, "h")
            .filter(F.col("near").isNotNull() | (F.struct("doc", "tie", "line") != F.col("first"))))
    return rows.groupBy("doc", "tie").agg(F.sort_array(F.collect_set("line")).alias("dropped"))


def dedup_lines(docs: DataFrame, least: int = MIN_CHARS, short: bool = False) -> DataFrame:
    """``docs`` with the kept lines as ``text``, and ``n_lines`` and ``n_dropped`` behind its columns."""
    gone = materialise(drops(docs, least, short)).select(F.col("doc").alias("_ld_doc"), F.col("tie").alias("_ld_tie"),
                                                  F.col("dropped").alias("_ld_dropped"))
    names = docs.columns
    rows = docs.select(F.struct(*names).alias("_ld_row"),
                       F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("_ld_key"),
                       F.xxhash64("text").alias("_ld_hash"))
    both = rows.join(gone, (F.col("_ld_key") == F.col("_ld_doc")) & (F.col("_ld_hash") == F.col("_ld_tie")), "left")
    lines = F.split(F.col("_ld_row.text"), "\n", -1)
    rest = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_ld_dropped"))
    text = F.when(F.col("_ld_dropped").isNull(), F.col("_ld_row.text")).otherwise(
        F.array_join(F.transform(rest, lambda i: F.get(lines, i)), "\n"))
    added = {"n_lines": F.when(F.col("_ld_row.text").isNull(), 0).otherwise(F.size(lines)).cast("long"),
             "n_dropped": F.coalesce(F.size("_ld_dropped"), F.lit(0)).cast("long")}
    out = [text.alias(c) if c == "text" else F.col("_ld_row").getField(c).alias(c) for c in names if c not in added]
    return both.select(*out, *[v.alias(k) for k, v in added.items()])
