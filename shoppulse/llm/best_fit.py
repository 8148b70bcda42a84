"""Best-fit packing of tokenised documents into sequences of bounded length.

Tokens come from a public vocabulary file (a parameter; never copied here).
A document is its ids and one end id.  Only a document longer than ``width`` is
cut, into pieces of ``width`` tokens with the remainder first; pieces of full
width are sequences of their own.  All other pieces go to bounded-space online
best-fit: every task keeps at most ``open_bins`` open bins; one bit for each
free space says whether such a bin is open, so the fullest bin that takes a
piece is the lowest set bit at or above its length.  A bin that is full leaves;
where one bin too many would open, the fullest closes first.  Pieces are dealt
to blocks by a hash of their own serial number, and a block arrives longest
piece first, which is the order best-fit packs nearly without loss.  Bins stay
open over the blocks of a task, so its memory holds the open bins and one batch.

Splitting a text into the vocabulary's words ("pretokens") is done on whole
slices with numpy.  What kind a code point is (letter, number, space or other)
is asked from the tokenizer itself, once for each code point that occurs; the
distinct words of a slice are found with Arrow's dictionary encoding, and only
words that a task has not met yet are encoded, by ``tokenizers``.  The ids are
those that the tokenizer gives for the whole text.

Defined cases: a null or empty text is the end id alone; strings that look like
special tokens are ordinary text; equal texts and repeated rows are pieces of
their own; a null doc_id stays null; an empty table gives an empty result;
extra columns are not read, whatever their names.  A text above the slice size
is encoded in parts, cut where a space follows a letter or digit (there a word
always starts), and gives the same ids.
"""

from __future__ import annotations

import functools
import itertools
import os
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import materialise
from ._text import text_slices, utf8

VOCABULARY = "byte_bpe_50k.json"
WIDTH = 1024
END_ID = 2
OPEN_BINS = 1 << 14
#: Pieces that arrive together, longest first; half the open bins, so that the bins of two blocks fit.
BLOCK = 1 << 13
#: Bytes of text encoded together.
SLICE = 4 << 20
#: Words whose ids a task remembers; beyond, it starts anew.
REMEMBERED = 1 << 20
SPACE, LETTER, NUMBER, OTHER, UNKNOWN = range(5)
# Endings that the pattern of the vocabulary splits off after an apostrophe.
ONE_LETTER, TWO_LETTERS = "stmd", ("re", "ve", "ll")


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of many texts at once, equal to those of the tokenizer."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.id_bytes = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
        for token, i in self.tokenizer.get_vocab().items():
            self.id_bytes[i] = len(token)  # one character stands for each byte
        self.kind = np.full(0x110000, UNKNOWN, np.uint8)
        self._forget()

    def _forget(self):
        self.known: dict = {}
        self.ends = np.zeros(1, np.int32)
        self.flat = np.zeros(0, np.uint32)

    def _kinds(self, codes: np.ndarray) -> np.ndarray:
        kind = self.kind[codes]
        if (kind == UNKNOWN).any():
            split = self.tokenizer.pre_tokenizer.pre_tokenize_str
            for c in np.unique(codes[kind == UNKNOWN]).tolist():
                joins = [x for x, before in ((LETTER, "a"), (NUMBER, "1"), (OTHER, "!")) if len(split(before + chr(c))) == 1]
                self.kind[c] = joins[0] if joins else SPACE
            kind = self.kind[codes]
        return kind

    def words(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Byte positions at which the words of the texts begin."""
        codes = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        at = np.flatnonzero((data & 0xC0) != 0x80)
        rows = np.searchsorted(at, off)  # code point at which each text begins
        n = len(codes)
        kind = self._kinds(codes)
        before, after = np.empty_like(kind), np.empty_like(kind)
        before[1:], after[:-1] = kind[:-1], kind[1:]
        first = rows[:-1][rows[:-1] < rows[1:]]
        before[first] = UNKNOWN
        after[rows[1:][rows[:-1] < rows[1:]] - 1] = UNKNOWN
        start = kind != before
        # the last space before other text is a word of its own, or belongs to that text if it is a plain one
        start |= (kind == SPACE) & (after != SPACE) & (after != UNKNOWN)
        plain = codes[:-1] == 0x20
        plain &= (kind[1:] != SPACE) & (before[1:] != UNKNOWN)
        start[1:][plain] = False
        mark = np.flatnonzero((codes == 0x27) & start)
        if len(mark):
            end = rows[1:][np.searchsorted(rows, mark, "right") - 1]
            wide = np.concatenate([codes, np.zeros(3, np.uint32)])
            one, two = wide[mark + 1], wide[mark + 2]
            short = np.isin(one, [ord(c) for c in ONE_LETTER]) & (mark + 1 < end)
            long = np.zeros(len(mark), bool)
            for a, b in TWO_LETTERS:
                long |= (one == ord(a)) & (two == ord(b))
            long &= mark + 2 < end
            start[mark[short | long] + 1] = False
            rest = np.concatenate([(mark + 2)[short & (mark + 2 < end)], (mark + 3)[long & (mark + 3 < end)]])
            start[rest[rest < n]] = True
        return at[start]

    def _learn(self, new: list) -> None:
        """Append words not met before and their ids.

        Many words go to the tokenizer as one list; as a vocabulary over bytes
        loses none, byte counts tell which ids belong to which word.
        """
        lists = [new[i:i + 10000] for i in range(0, len(new), 10000)]
        ids = np.concatenate([np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(
            lists, is_pretokenized=True, add_special_tokens=False)])
        upto = np.cumsum(pc.binary_length(pa.array(new, pa.string())).to_numpy().astype(np.int64))
        size = np.searchsorted(np.cumsum(self.id_bytes[ids]), upto) + 1
        self.ends = np.concatenate([self.ends, self.ends[-1] + size.astype(np.int32)])
        self.flat = np.concatenate([self.flat, ids])
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))

    def _encode(self, data: np.ndarray, off: np.ndarray):
        """(ids, ids in each text) of a slice."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(off) - 1, np.int64)
        if len(self.known) > REMEMBERED:
            self._forget()
        start = self.words(data, off)
        bounds = np.append(start, len(data)).astype(np.int32)
        words = pa.Array.from_buffers(pa.string(), len(start), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))])
        coded = words.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        slot = np.fromiter(map(self.known.get, distinct, itertools.repeat(-1)), np.int32, len(distinct))
        new = np.flatnonzero(slot < 0)
        if len(new):
            slot[new] = len(self.known) + np.arange(len(new))
            self._learn([distinct[k] for k in new.tolist()])
        ids = pa.ListArray.from_arrays(pa.array(self.ends), pa.array(self.flat)).take(pa.array(slot[coded.indices.to_numpy()]))
        ends = ids.offsets.to_numpy()[np.append(np.searchsorted(start, off[:-1]), len(start))]
        return ids.flatten().to_numpy(), np.diff(ends).astype(np.int64)

    def encode(self, data: np.ndarray, off: np.ndarray, limit: int = SLICE):
        """(ids, ids in each text); one text above ``limit`` bytes is encoded in parts."""
        try:
            data.tobytes().decode()
        except UnicodeDecodeError:  # a string column can hold any bytes
            texts = [data[a:b].tobytes().decode(errors="replace") for a, b in zip(off[:-1], off[1:])]
            off, data = utf8(pa.array(texts, pa.large_string()))
        if len(data) <= limit or len(off) != 2:
            return self._encode(data, off)
        word = np.zeros(256, bool)
        word[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
        cuts = np.flatnonzero((data[1:] == 0x20) & word[data[:-1]]) + 1
        parts, a = [], 0
        while a < len(data):
            k = np.searchsorted(cuts, a + limit)
            b = int(cuts[k]) if k < len(cuts) else len(data)
            parts.append(self._encode(data[a:b], np.array([0, b - a]))[0])
            a = b
        ids = np.concatenate(parts)
        return ids, np.array([len(ids)])


@functools.lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def cut(size: np.ndarray, width: int):
    """(document, piece, start, length) of the pieces of documents of these lengths."""
    n = -(-size // width)
    doc = np.repeat(np.arange(len(size)), n)
    piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    head = (size - (n - 1) * width)[doc]
    start = np.where(piece == 0, 0, head + (piece - 1) * width)
    return doc, piece, start, np.where(piece == 0, head, width)


def pieces(docs: DataFrame, path: str, width: int = WIDTH, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, serial[, ids]) of every document; serials are unique."""
    def run(batches):
        from pyspark import TaskContext

        code = encoder(path)
        serial = TaskContext.get().partitionId() << 40
        for batch in batches:
            ids_of = batch.column("doc_id")
            for i, j, off, data in text_slices(batch, limit=SLICE):
                ids, size = code.encode(data, off)
                ids = np.insert(ids, np.cumsum(size), np.uint32(end_id)).astype("<u4")
                size = size + 1
                doc, piece, start, length = cut(size, width)
                at = (np.cumsum(size) - size)[doc] + start
                raw = memoryview(ids).cast("B")
                crc = [zlib.crc32(raw[4 * a:4 * (a + b)]) for a, b in zip(at.tolist(), length.tolist())]
                out = {"doc_id": ids_of.slice(i, j - i).take(pa.array(doc)), "piece": pa.array(piece, pa.int32()),
                       "start": pa.array(start), "length": pa.array(length), "ids_crc32": pa.array(crc, pa.int64()),
                       "serial": pa.array(serial + np.arange(len(doc)))}
                if with_ids:
                    ends = np.append(at, len(ids)).astype(np.int32)
                    out["ids"] = pa.ListArray.from_arrays(pa.array(ends), pa.array(ids.view(np.int32)))
                serial += len(doc)
                yield pa.RecordBatch.from_pydict(out)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, serial long"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text") \
        .mapInArrow(run, schema + (", ids array<int>" if with_ids else ""))


class Bins:
    """At most ``most`` open bins, found by their free space through one bit each."""

    def __init__(self, width: int, most: int, first: int = 0):
        self.width, self.most, self.next = width, most, first
        self.free: list = [[] for _ in range(width + 1)]
        self.bits = self.open = 0

    def _take(self, space: int) -> int:
        number = self.free[space].pop()
        if not self.free[space]:
            self.bits &= ~(1 << space)
        return number

    def put(self, length: int):
        """(bin, place in it) for a piece of this length: the fullest bin that takes it, or a new one."""
        fits = self.bits >> length
        if fits:
            space = length + (fits & -fits).bit_length() - 1
            number = self._take(space)
        else:
            if self.open == self.most:  # the fullest closes
                self._take((self.bits & -self.bits).bit_length() - 1)
                self.open -= 1
            space, number = self.width, self.next
            self.next += 1
            self.open += 1
        left = space - length
        if left:
            self.free[left].append(number)
            self.bits |= 1 << left
        else:
            self.open -= 1
        return number, self.width - space


def pack(docs: DataFrame, path: str | None = None, width: int = WIDTH, end_id: int = END_ID,
         open_bins: int = OPEN_BINS, block: int = BLOCK, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their sequence and place in it.

    doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids].
    """
    cut_up = materialise(pieces(docs, path or vocabulary_path(), width, end_id, with_ids))
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + (["ids"] if with_ids else [])
    whole = cut_up.filter(F.col("length") == width).withColumn("sequence_id", F.col("serial") * 2 + 1) \
        .withColumn("offset", F.lit(0).cast("long"))
    blocks = -(-cut_up.filter(F.col("length") < width).count() // block) or 1
    dealt = (cut_up.filter(F.col("length") < width)
             .withColumn("block", F.pmod(F.xxhash64("serial"), F.lit(blocks)))
             .repartition("block").sortWithinPartitions("block", F.desc("length"), "serial"))

    def run(batches):
        from pyspark import TaskContext

        bins = Bins(width, open_bins, TaskContext.get().partitionId() << 40)
        for batch in batches:
            placed = [bins.put(x) for x in batch.column("length").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in names]
                + [pa.array([2 * p[0] for p in placed], pa.int64()), pa.array([p[1] for p in placed], pa.int64())],
                names=names + ["sequence_id", "offset"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut_up.select(names).schema)
    packed = dealt.select(names).mapInArrow(run, schema + ", sequence_id long, offset long")
    out = names[:5] + ["sequence_id", "offset"] + names[5:]
    return whole.select(out).union(packed.select(out))


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, n_docs, ids): the token sequences themselves, from ``pack(..., with_ids=True)``.

    A sequence holds at most ``width`` tokens, so its row is bounded.
    """
    return (packed.groupBy("sequence_id")
            .agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
            .select("sequence_id", F.size("parts").alias("n_docs"), F.flatten("parts.ids").alias("ids")))
