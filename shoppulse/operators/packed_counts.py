"""Term counts of documents, packed by chunks of documents.

A row of :func:`pack` holds the counts of some hundred documents: their terms are
listed once, and a count names its term by its place in that list.  The lists are
kept by buckets of terms (a hash), and what is added up, numbered and looked up for
each bucket are those lists, not the counts, which are shuffled twice: by document,
so that all of a document's rows are added up, and by chunk, as small numbers.

A task holds one batch of tokens, one chunk or the lists of one bucket at a time; a
document is in one chunk and bounded by its own distinct terms.
"""

from __future__ import annotations

from typing import NamedTuple
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import monotonically_increasing_id as serial

from shoppulse.session import frugal, ship, written

CHUNK = 1 << 18   # counts of a chunk, about
BUCKETS = 256     # of terms


class PackedCounts(NamedTuple):
    """``chunks(chunk, docs, lengths, place, n)``: the documents of a chunk, how many
    counts each has, and of each count the place of its term in the chunk's list and n;
    ``lists(chunk, bucket, text, sizes, df, n)``: that list by buckets, with the number
    of documents and tokens of each term in the chunk; ``terms(bucket, <term>, df, n)``:
    the same over all chunks.  Counts of terms that are not in ``terms`` are left out."""

    chunks: DataFrame
    lists: DataFrame
    terms: DataFrame


def _least(x: np.ndarray) -> np.ndarray:
    """Counts or places in the smallest type that holds them."""
    top = int(x.max(initial=0))
    return x.astype(next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if top <= np.iinfo(t).max))


def _numbers(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, f"u{len(raw) // n}" if n else "u1")


def _rows_of(bounds: np.ndarray, data) -> pa.Array:
    """A binary value for each span of ``data``."""
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(data)])


def _counted(batches):
    """The distinct tokens of each document, with their sizes in bytes and counts."""
    for batch in batches:
        doc, lists = batch.column(0).dictionary_encode(null_encoding="encode"), batch.column(1)
        lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        tokens = lists.flatten().dictionary_encode()
        if not len(tokens):
            continue
        known = len(tokens.dictionary)
        key = np.repeat(doc.indices.to_numpy().astype(np.int64), lengths) * known + tokens.indices.to_numpy()
        key, n = np.unique(key, return_counts=True)
        row, code = np.divmod(key, known)
        first = np.flatnonzero(np.diff(row, prepend=-1))
        bounds = np.append(first, len(row))
        words = tokens.dictionary.cast(pa.binary()).take(pa.array(code))
        offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset:words.offset + len(words) + 1]
        yield pa.RecordBatch.from_arrays([
            doc.dictionary.take(pa.array(row[first])), _rows_of(offsets[bounds], words.buffers()[2]),
            _rows_of(bounds * 4, np.diff(offsets).astype(np.int32)), _rows_of(bounds * 4, n.astype(np.int32))],
            names=["doc", "text", "sizes", "n"])


def _chunk(kind: pa.DataType, rows: list) -> pa.RecordBatch:
    """Rows (doc, text, sizes, n) in the order of their documents."""
    docs, row_doc = [], np.empty(len(rows), np.int64)
    for at, (doc, *_) in enumerate(rows):
        if not docs or doc != docs[-1]:
            docs.append(doc)
        row_doc[at] = len(docs) - 1
    text = b"".join(r[1] for r in rows)
    sizes, n = (np.frombuffer(b"".join(r[c] for r in rows), np.int32).astype(np.int64) for c in (2, 3))
    offsets = np.concatenate((np.zeros(1, np.int64), np.cumsum(sizes)))
    words = pa.Array.from_buffers(pa.large_string(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(text)]).dictionary_encode()
    terms, place = words.dictionary, words.indices.to_numpy().astype(np.int64)
    doc = np.repeat(row_doc, [len(r[2]) // 4 for r in rows])
    if len(docs) < len(rows):  # rows of one document are added up
        key, at = np.unique(doc * len(terms) + place, return_inverse=True)
        total = np.zeros(len(key), np.int64)
        np.add.at(total, at, n)
        n, (doc, place) = total, np.divmod(key, len(terms))
    df, of_term = np.bincount(place, minlength=len(terms)), np.zeros(len(terms), np.int64)
    np.add.at(of_term, place, n)
    words = terms.cast(pa.large_binary())
    bucket = np.fromiter((crc32(w) for w in words.to_pylist()), np.int64, len(words)) % BUCKETS
    order = np.argsort(bucket, kind="stable")
    seat = np.empty_like(order)
    seat[order] = np.arange(len(order))
    cuts = np.searchsorted(bucket[order], np.arange(BUCKETS + 1)).tolist()
    words = words.take(pa.array(order))
    offsets, text = np.frombuffer(words.buffers()[1], np.int64)[words.offset:words.offset + len(words) + 1], words.buffers()[2]
    cut = lambda x: [x[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]
    listed = ([text[int(offsets[a]):int(offsets[b])].to_pybytes() for a, b in zip(cuts, cuts[1:])], cut(np.diff(offsets).astype(np.int32)),
              cut(df[order].astype(np.int64)), cut(of_term[order]))
    parts = (np.bincount(doc, minlength=len(docs)).astype(np.int32), _least(seat[place]), _least(n))
    return pa.RecordBatch.from_arrays(
        [pa.array([docs], pa.list_(kind)), *(pa.array([x.tobytes()], pa.binary()) for x in parts),
         *(pa.array([x], pa.list_(pa.binary())) for x in listed)],
        names=["docs", "lengths", "place", "n", "text", "sizes", "df", "tokens"])


def _chunks(most: int):
    def run(batches):
        rows, held = [], 0
        for batch in batches:
            kind = batch.schema.field(0).type
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held >= most and row[0] != rows[-1][0]:
                    yield _chunk(kind, rows)
                    rows, held = [], 0
                rows.append(row)
                held += len(row[2]) // 4
        if rows:
            yield _chunk(kind, rows)

    return run


def _terms(lists: pa.Table) -> pa.Array:
    sizes = np.frombuffer(b"".join(lists["sizes"].to_pylist()), np.int32)
    offsets = np.concatenate((np.zeros(1, np.int64), np.cumsum(sizes, dtype=np.int64)))
    text = b"".join(lists["text"].to_pylist())
    return pa.Array.from_buffers(pa.large_string(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(text)])


def pack(tokens: DataFrame, doc_col: str, list_col: str, term_col: str = "word") -> PackedCounts:
    """Counts of each document's tokens, from rows that hold them as lists; the rows
    of a document are added up.  Written once."""
    spark = tokens.sparkSession
    ship(spark)
    tokens = tokens.select(F.col(doc_col).alias("doc"), list_col)
    kind = tokens.schema["doc"].dataType.simpleString()
    counted = tokens.mapInArrow(_counted, f"doc {kind}, text binary, sizes binary, n binary")
    dealt = counted.repartition("doc").sortWithinPartitions("doc")
    chunks = dealt.mapInArrow(_chunks(CHUNK), f"docs array<{kind}>, lengths binary, place binary, n binary, text array<binary>, "
                                               "sizes array<binary>, df array<binary>, tokens array<binary>")

    def added(lists):
        terms = _terms(lists).dictionary_encode()
        at, known = terms.indices.to_numpy(), terms.dictionary.cast(pa.string())
        sums = []
        for c in ("df", "n"):
            total = np.zeros(len(known), np.int64)
            np.add.at(total, at, np.frombuffer(b"".join(lists[c].to_pylist()), np.int64))
            sums.append(pa.array(total))
        return pa.Table.from_arrays([pa.array(np.full(len(known), lists["bucket"][0].as_py(), np.int32)), known, *sums],
                                    names=["bucket", term_col, "df", "n"])

    with frugal(spark):
        chunks = written(chunks.withColumn("chunk", serial()))
        each = F.posexplode(F.arrays_zip("text", "sizes", "df", "tokens")).alias("bucket", "t")
        lists = chunks.select("chunk", each).filter(F.length("t.sizes") > 0).select(
            "chunk", "bucket", "t.text", "t.sizes", "t.df", F.col("t.tokens").alias("n"))
        terms = written(lists.groupBy("bucket").applyInArrow(added, f"bucket int, `{term_col}` string, df bigint, n bigint"))
    return PackedCounts(chunks.select("chunk", "docs", "lengths", "place", "n"), lists, terms)


def vectors(counts: PackedCounts, numbered: DataFrame, size: int, doc_col: str) -> DataFrame:
    """``(doc, tf)`` with the parts of a sparse vector, for documents with any of the
    terms ``numbered(bucket, term, term_index)``, of which there are ``size``."""
    kind = counts.chunks.schema["docs"].dataType.elementType.simpleString()

    def looked_up(lists, numbered):
        at = pc.index_in(_terms(lists), numbered["term"].combine_chunks().cast(pa.large_string()))
        index = numbered["term_index"].combine_chunks().take(at).fill_null(-1).to_numpy().astype(np.int32)
        ends = np.cumsum([len(x) // 4 for x in lists["sizes"].to_pylist()])
        found = [x.tobytes() for x in np.split(index, ends[:-1])] if len(ends) else []
        return pa.Table.from_arrays([lists["chunk"], lists["bucket"], pa.array(found, pa.binary())], names=["chunk", "bucket", "found"])

    def run(chunk, index):
        # a chunk is one row; its terms are in the order of their buckets
        at = np.frombuffer(b"".join(index.sort_by("bucket")["found"].to_pylist()), np.int32)
        r = chunk.select(["lengths", "place", "n"]).to_pylist()[0]
        lengths = np.frombuffer(r["lengths"], np.int32)
        total = int(lengths.sum())
        term = at[_numbers(r["place"], total)]
        kept = np.flatnonzero(term >= 0)
        key = np.repeat(np.arange(len(lengths)), lengths)[kept] * size + term[kept]
        order = np.argsort(key)
        doc, term = np.divmod(key[order], size) if size else (key, key)
        first = np.flatnonzero(np.diff(doc, prepend=-1))
        bounds = pa.array(np.append(first, len(doc)).astype(np.int32))
        n = _numbers(r["n"], total)[kept][order].astype(np.float64)
        docs = chunk["docs"].combine_chunks().flatten().take(pa.array(doc[first]))
        tf = pa.StructArray.from_arrays(
            [pa.array(np.zeros(len(first), np.int8)), pa.array(np.full(len(first), size, np.int32)),  # type 0: sparse
             pa.ListArray.from_arrays(bounds, pa.array(term.astype(np.int32))),
             pa.ListArray.from_arrays(bounds, pa.array(n))], names=["type", "size", "indices", "values"])
        return pa.Table.from_arrays([docs, tf], names=[doc_col, "tf"])

    index = counts.lists.select("chunk", "bucket", "text", "sizes").groupBy("bucket").cogroup(numbered.groupBy("bucket")) \
        .applyInArrow(looked_up, "chunk bigint, bucket int, found binary")
    return counts.chunks.groupBy("chunk").cogroup(index.groupBy("chunk")).applyInArrow(
        run, f"`{doc_col}` {kind}, tf struct<type:tinyint,size:int,indices:array<int>,values:array<double>>")
