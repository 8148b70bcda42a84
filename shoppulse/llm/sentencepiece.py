"""SentencePiece encoding and decoding by a batched numpy Viterbi.

The pieces and scores come from a public model file (a parameter; never copied
here).  A text is its code points with the space written as U+2581 and one in
front.  No piece has that mark after another character, so the best
segmentation of a text is that of its words, each a run of marks and the
characters up to the next mark.  The distinct words of a slice are segmented
together: words of one length advance one position at a time; the hashes of
the substrings that end there probe the sorted piece keys, a hit is compared
code point by code point, and vectorised maxima store the backpointer.  On
equal scores the longest last piece wins.  A character that no piece covers
costs ``UNKNOWN`` below the lowest score and becomes its UTF-8 byte pieces.

The result maximises the summed piece scores, as a unigram model's encoder
does.  With a merge-ranked vocabulary this is not the merge order's result;
decoding restores the text either way.

Defined cases: null gives null ids (0 tokens), the empty text no ids; a text
that holds U+2581 itself decodes to a space there (``round_trip`` is false), as
in the format itself; ties and repeated rows give equal results; extra columns
are passed through by ``encode`` unless they clash with the added names
(``token_ids``, ``n_tokens``, ``decoded``), which replace them.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ._text import INVERSE, mix64, powers, slices, utf8

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = 0x2581
UNKNOWN = 10.0
#: Scores below this stand for "none given" (runs of marks); they count as the lowest given one.
PLACEHOLDER = -1e8
SLICE_CHARS = 1 << 21
U64 = np.uint64
PROBE_SHIFT = U64(46)


class Pieces:
    """The vocabulary as sorted substring keys with ids and scores."""

    def __init__(self, path: str = MODEL):
        import sentencepiece as sp

        model = sp.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.text = {i: model.id_to_piece(i) for i in plain}
        self.byte = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        codes = [np.array([ord(c) for c in self.text[i]], np.uint32) for i in plain]
        self.known = Known()
        self.longest = max(map(len, codes))
        grid = np.zeros((len(plain), self.longest), np.uint32)
        for k, c in enumerate(codes):
            grid[k, :len(c)] = c
        lengths = np.array([len(c) for c in codes])
        scores = np.array([model.get_score(i) for i in plain])
        scores = np.maximum(scores, scores[scores > PLACEHOLDER].min())
        self.floor = float(scores.min()) - UNKNOWN
        self.by_length = {}
        for m in range(1, self.longest + 1):
            rows = np.flatnonzero(lengths == m)
            if len(rows):
                keys = code_hash(grid[rows, :m])
                order = np.argsort(keys)
                maybe = np.zeros(1 << 18, bool)  # which leading bits any key has: most probes end here
                maybe[keys >> PROBE_SHIFT] = True
                self.by_length[m] = (keys[order], grid[rows[order], :m], np.array(plain, np.int32)[rows[order]], scores[rows[order]], maybe)
        # decoding: the UTF-8 bytes of every id, one after the other
        marks = [b""] * n
        for i, t in self.text.items():
            marks[i] = t.replace(chr(MARK), " ").encode()
        for b, i in enumerate(self.byte):
            marks[i] = bytes([b])
        size = np.array([len(x) for x in marks])
        self.byte_start = np.cumsum(size) - size
        self.byte_size = size
        self.bytes = np.frombuffer(b"".join(marks), np.uint8)

    def segment(self, grid: np.ndarray):
        """Best pieces of equally long words, one a row: (word, id, is_char, char) in order."""
        n, length = grid.shape
        best = np.full((length + 1, n), -np.inf)
        best[0] = 0.0
        back = np.zeros((length + 1, n), np.int32)
        piece = np.full((length + 1, n), -1, np.int32)
        step = powers(length + 1)
        total = np.zeros((length + 1, n), U64)
        for p in range(length):
            total[p + 1] = total[p] + mix64(grid[:, p].astype(U64)) * step[p]
        for end in range(1, length + 1):
            top = best[end - 1] + self.floor  # one unknown character
            back[end] = end - 1
            for m in range(1, min(self.longest, end) + 1):
                if m not in self.by_length:
                    continue
                keys, codes, ids, scores, maybe = self.by_length[m]
                want = (total[end] - total[end - m]) * inverse_power(end - m)
                hit = np.flatnonzero(maybe.take((want >> PROBE_SHIFT).view(np.int64)))
                if not len(hit):
                    continue
                want = want[hit]
                at = np.searchsorted(keys, want)
                at[at == len(keys)] = 0
                exact = keys.take(at) == want
                hit, at = hit[exact], at[exact]
                if not len(hit):
                    continue
                same = (grid[hit, end - m:end] == codes[at]).all(axis=1)
                hit, at = hit[same], at[same]
                value = best[end - m, hit] + scores[at]
                better = value >= top[hit]
                hit, at = hit[better], at[better]
                top[hit] = value[better]
                back[end, hit] = end - m
                piece[end, hit] = ids[at]
            best[end] = top
        word, ids, order = [], [], []
        place = np.full(n, length)
        rows = np.arange(n)
        turn = 0
        while len(rows):
            at = place[rows]
            got = piece[at, rows]
            word.append(rows)
            ids.append(np.where(got >= 0, got.astype(np.int64), -1 - grid[rows, at - 1].astype(np.int64)))
            order.append(np.full(len(rows), -turn))
            place[rows] = back[at, rows]
            rows = rows[place[rows] > 0]
            turn += 1
        word, ids, order = map(np.concatenate, (word, ids, order))
        by = np.lexsort((order, word))
        return word[by], ids[by]

    def spell(self, word: np.ndarray, ids: np.ndarray):
        """Replace uncovered characters (negative ids) by their byte pieces."""
        odd = np.flatnonzero(ids < 0)
        if not len(odd):
            return word, ids
        raw = [chr(-1 - int(ids[k])).encode("utf-8", "surrogatepass") for k in odd]
        count = np.ones(len(ids), np.int64)
        count[odd] = [len(r) for r in raw]
        out = np.repeat(ids, count)
        start = np.cumsum(count) - count
        for k, r in zip(odd, raw):
            out[start[k]:start[k] + len(r)] = self.byte[list(r)]
        return np.repeat(word, count), out


class Known:
    """The ids of words seen before in this task, at most ``limit`` words of at most ``LONG`` characters.

    When it is full it starts anew; words are looked up by their 64-bit hash.
    """

    LONG = 64

    def __init__(self, limit: int = 400_000):
        self.limit = limit
        self.clear()

    def clear(self):
        self.key = np.zeros(0, U64)
        self.begin = self.count = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)

    def look_up(self, key, codes, start, length, vocab):
        """(word number of every key, ids, begin, count) with the new words segmented and added."""
        distinct, where, which = np.unique(key, return_index=True, return_inverse=True)
        at = np.searchsorted(self.key, distinct)
        at[at == len(self.key)] = 0
        old = self.key[at] == distinct if len(self.key) else np.zeros(len(distinct), bool)
        fresh = np.flatnonzero(~old)
        ids, count = segment_words(codes, start[where[fresh]], length[where[fresh]], vocab)
        begin = np.zeros(len(distinct), np.int64)
        size = np.zeros(len(distinct), np.int64)
        begin[old], size[old] = self.begin[at[old]], self.count[at[old]]
        begin[fresh], size[fresh] = len(self.ids) + np.cumsum(count) - count, count
        all_ids = np.concatenate((self.ids, ids))
        short = fresh[length[where[fresh]] <= self.LONG]
        if len(self.key) + len(short) > self.limit:
            self.clear()
        else:
            order = np.searchsorted(self.key, distinct[short])
            self.key = np.insert(self.key, order, distinct[short])
            self.begin = np.insert(self.begin, order, begin[short])
            self.count = np.insert(self.count, order, size[short])
            self.ids = all_ids
        return which, all_ids, begin, size


def segment_words(codes, start, length, vocab):
    """(ids, ids per word) of the words codes[start:start + length]; equal lengths advance together."""
    words, ids = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for m in np.unique(length):
        rows = np.flatnonzero(length == m)
        block = max(1, (1 << 19) // int(m + 1))
        for k in range(0, len(rows), block):
            part = rows[k:k + block]
            grid = codes[start[part][:, None] + np.arange(m)]
            w, t = vocab.spell(*vocab.segment(grid))
            words.append(part[w])
            ids.append(t)
    words, ids = np.concatenate(words), np.concatenate(ids)
    return ids[np.argsort(words, kind="stable")].astype(np.int32), np.bincount(words, minlength=len(start))


def inverse_power(k: int) -> np.uint64:
    return powers(k + 1, INVERSE)[k]


def code_hash(grid: np.ndarray) -> np.ndarray:
    """Hash of each row of code points."""
    m = grid.shape[1]
    total = np.zeros(len(grid), U64)
    step = powers(m + 1)
    for p in range(m):
        total += mix64(grid[:, p].astype(U64)) * step[p]
    return total


@functools.lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def encode_codes(codes: np.ndarray, vocab: Pieces):
    """Code points of whole words in marks -> (ids, words' first token, words' start)."""
    mark = codes == MARK
    first = mark.copy()
    first[1:] &= ~mark[:-1]
    first[0] = True
    start = np.flatnonzero(first)
    length = np.diff(np.append(start, len(codes)))
    step = powers(len(codes))
    total = np.zeros(len(codes) + 1, U64)
    np.cumsum(mix64(codes.astype(U64)) * step, out=total[1:])
    key = mix64((total[start + length] - total[start]) * powers(len(codes), INVERSE)[start] + length.astype(U64))
    which, ids, begin, count = vocab.known.look_up(key, codes, start, length, vocab)
    n = count[which]
    first_token = np.cumsum(n) - n
    out = ids[np.repeat(begin[which] - first_token, n) + np.arange(n.sum())]
    return out, first_token, start


def encode_texts(offsets: np.ndarray, data: np.ndarray, vocab: Pieces):
    """Ids of every text of a UTF-8 column: (ids, token offsets)."""
    out, sizes = [], []
    for i, j in slices(offsets, SLICE_CHARS):
        raw = data[offsets[i]:offsets[j]].tobytes()
        part = offsets[i:j + 1] - offsets[i]
        lead = (np.frombuffer(raw, np.uint8) & 0xC0) != 0x80
        chars = np.concatenate(([0], np.cumsum(lead)))[part]
        codes = np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32)
        # one mark in front of every text that is not empty
        full = np.diff(chars) > 0
        codes = np.where(codes == 0x20, np.uint32(MARK), codes)
        codes = np.insert(codes, chars[:-1][full], np.uint32(MARK))
        edge = chars + np.concatenate(([0], np.cumsum(full)))
        counts = np.zeros(j - i, np.int64)
        # words start at marks, so a text can be cut at any of them; a text's first mark may follow the last one's end
        for a, b in text_cuts(codes, edge):
            ids, first, start = encode_codes(codes[a:b], vocab)
            owner = np.searchsorted(edge, start + a, "right") - 1
            n = np.diff(np.append(first, len(ids)))
            np.add.at(counts, owner, n)
            out.append(ids)
        sizes.append(counts)
    ids = np.concatenate(out) if out else np.zeros(0, np.int32)
    n = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
    return ids, np.concatenate(([0], np.cumsum(n)))


def text_cuts(codes: np.ndarray, edge: np.ndarray, limit: int = SLICE_CHARS):
    """Ranges that hold whole words of one or more texts, about ``limit`` code points each.

    A run of marks must not be torn, nor joined to the marks that end the text
    before: each text whose predecessor ends in a mark starts a new range.
    """
    if not len(codes):
        return
    mark = codes == MARK
    starts = np.unique(edge[:-1][edge[:-1] < len(codes)])
    forced = starts[(starts > 0) & mark[starts - 1]] if len(starts) else starts
    first = mark.copy()
    first[1:] &= ~mark[:-1]
    places = np.flatnonzero(first)
    cuts, at = {0, len(codes)} | {int(x) for x in forced}, 0
    while at + limit < len(codes):
        k = np.searchsorted(places, at + limit, "right") - 1
        if places[k] <= at:
            if k + 1 >= len(places):
                break
            k += 1
        at = int(places[k])
        cuts.add(at)
    cuts = sorted(cuts)
    yield from zip(cuts, cuts[1:])


def decode_ids(ids: np.ndarray, offsets: np.ndarray, vocab: Pieces) -> list[bytes]:
    """UTF-8 bytes of every id list, without the mark put in front by encoding."""
    n = vocab.byte_size[ids]
    first = np.cumsum(n) - n
    raw = vocab.bytes[np.repeat(vocab.byte_start[ids] - first, n) + np.arange(n.sum())].tobytes()
    edge = np.concatenate((first, [n.sum()]))[offsets]
    return [raw[a + 1 if b > a else a:b] for a, b in zip(edge, edge[1:])]


ADDED = [T.StructField("token_ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType()),
         T.StructField("round_trip", T.BooleanType()), T.StructField("decoded_sha256", T.StringType())]


def encode(docs: DataFrame, path: str = MODEL, keep=None) -> DataFrame:
    """``docs`` with token_ids, n_tokens, and the check of the decoded text.

    ``keep``: the columns passed on besides (default: all but ``text``).  Every
    row is encoded and decoded in the task that reads it; nothing is shuffled.
    """
    added = [f.name for f in ADDED]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in added and c != "text"]
    source = docs.select(*keep, "text")
    schema = T.StructType([source.schema[c] for c in keep] + ADDED)

    def run(batches):
        vocab = pieces(path)
        for batch in batches:
            off, data = utf8(batch.column("text"))
            null = batch.column("text").is_null().to_numpy(zero_copy_only=False)
            for i, j in slices(off, SLICE_CHARS):
                part = off[i:j + 1] - off[i]
                raw = data[off[i]:off[j]]
                ids, at = encode_texts(part, raw, vocab)
                back = decode_ids(ids, at, vocab)
                whole = raw.tobytes()
                same = [b == whole[s:e] for b, s, e in zip(back, part, part[1:])]
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids, pa.int32()))
                if null[i:j].any():
                    lists = pc.if_else(pa.array(null[i:j]), pa.scalar(None, lists.type), lists)
                cols = [batch.column(c).slice(i, j - i) for c in keep]
                cols += [lists, pa.array(np.diff(at)), pa.array(same, pa.bool_()),
                         pa.array([hashlib.sha256(b).hexdigest() for b in back], pa.string())]
                yield pa.RecordBatch.from_arrays(cols, names=[*keep, *added])

    return source.mapInArrow(run, schema)


def decode(tokens: DataFrame, path: str = MODEL) -> DataFrame:
    """``tokens`` with ``decoded``, the text of its ``token_ids`` (null for null)."""
    keep = [c for c in tokens.columns if c != "decoded"]
    schema = T.StructType([tokens.schema[c] for c in keep] + [T.StructField("decoded", T.StringType())])

    def run(batches):
        vocab = pieces(path)
        for batch in batches:
            lists = batch.column("token_ids")
            null = lists.is_null().to_numpy(zero_copy_only=False)
            at = np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))))
            ids = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            back = decode_ids(ids, at, vocab)
            text = pa.array([None if x else b.decode("utf-8", "replace") for x, b in zip(null, back)], pa.string())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], text], names=[*keep, "decoded"])

    return tokens.select(*keep).mapInArrow(run, schema)
