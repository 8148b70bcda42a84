"""Conversation trie, periodic runs and best-fit packing against brute force, and their defined edge cases."""

import collections
import hashlib
import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import llm_brute as B
from shoppulse.llm import _scan, best_fit, periodic_runs, prefix_trie
from shoppulse.llm import queries as Q
from shoppulse.llm._spark import ship
from shoppulse.llm._text import utf8

TURNS = "conv_id long, turn long, role string, text string, depth string, f1 string, place string, part string, up string"
DOCS = "doc_id long, text string, lang string, source string, runs string, length string, serial string, ids string"


@pytest.fixture(scope="module")
def sp(spark):
    ship(spark)
    return spark


def turns(spark, rows):
    return spark.createDataFrame([(*r, "x", None, "y", "z", None) for r in rows], TURNS)


def docs(spark, rows):
    return spark.createDataFrame([(d, t, None, None, "x", None, "y", None) for d, t in rows], DOCS)


# -- trie --------------------------------------------------------------------------

def rebuilt(rows):
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    out = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - int(np.fmod(c, 100)), [])[:h] + mine[h:]
    return out


def brute_trie(rows):
    seqs = rebuilt(rows)
    members = collections.defaultdict(list)
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    below = collections.defaultdict(list)
    for k in members:
        if k:
            below[k[:-1]].append(k)
    out = {}
    for k in sorted(members, key=len, reverse=True):
        n = len(members[k])
        kids = [out[x] for x in below[k]]
        saved = (n - 1) * (len(k[-1][1]) if k else 0) + sum(x[6] for x in kids)
        leaves = sum(x[5] for x in kids) if kids else 1
        ends = ",".join(map(str, sorted(c for c in members[k] if len(seqs[c]) == len(k))))
        out[k] = (min(members[k]), len(k), min(members[k[:-1]]) if k else None, n, len(kids), leaves, saved,
                  hashlib.sha256(ends.encode()).hexdigest())
    return sorted(out.values(), key=repr)


def conversations(seed, n=60):
    rng = random.Random(seed)
    said = [(r, t) for r in ("user", "assistant", None) for t in ("hé", "yes", "", None, "a longer answer 🎉")]
    rows = []
    for c in rng.sample(range(-150, 450), n):
        for k in range(rng.choice([1, 2, 3, 5, 7, 9])):
            role, text = said[0] if rng.random() < .6 else rng.choice(said)
            rows.append((c, rng.choice([k, k, k, None]) if k < 2 else k, role, text))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_equals_brute_force(sp, seed):
    rows = conversations(seed)
    got = sorted((tuple(r) for r in prefix_trie.trie(turns(sp, rows).repartition(5)).collect()), key=repr)
    assert got == brute_trie(rows)


def test_trie_survives_colliding_fingerprints(sp):
    rows = conversations(3, 40)
    got = sorted((tuple(r) for r in prefix_trie.trie(turns(sp, rows), bits=2).collect()), key=repr)
    assert got == brute_trie(rows)


def test_trie_of_one_very_long_conversation_and_of_equal_ones(sp):
    """A conversation with most turns spans all tasks; equal ones end in one node."""
    rows = [(0, k, "user", f"turn {k % 7}") for k in range(2500)]
    rows += [(c, k, "user", f"turn {k}") for c in range(1, 90) for k in range(3)]
    rows += [(5000 + 100 * k, 0, "user", "x" * 200_000) for k in range(3)] + [(None, 0, "user", "no conversation"), (7001, 0, "u", "t")] * 2
    got = sorted((tuple(r) for r in prefix_trie.trie(turns(sp, rows)).collect()), key=repr)
    assert got == brute_trie(rows)


def test_trie_of_a_deeply_nested_chain_of_conversations(sp):
    """Conversation c leaves the path of c - 1 one turn later, so chains hang below chains."""
    rows = [(100 * c, k, "user", "common" if k < c else f"own {c}") for c in range(20) for k in range(c + 2)]
    got = sorted((tuple(r) for r in prefix_trie.trie(turns(sp, rows)).collect()), key=repr)
    assert got == brute_trie(rows)


def test_trie_plan_of_its_own_and_empty_table(sp):
    rows = [(1, 0, "u", "a"), (1, 1, "u", "b"), (2, 0, "u", "c"), (2, 1, "u", "d")]
    plan = sp.createDataFrame([(1, 2, 0), (2, 1, 1)], "conv_id long, base_id long, head long")
    got = sorted(tuple(r)[:5] for r in prefix_trie.trie(turns(sp, rows), plan).collect() if r.depth)
    assert got == [(1, 1, 1, 2, 2), (1, 2, 1, 1, 0), (2, 2, 1, 1, 0)]
    assert prefix_trie.trie(turns(sp, rows).limit(0)).count() == 0


def test_trie_query_equals_brute_force_on_given_table(sp):
    rows = duckdb.sql(f"SELECT conv_id, turn, role, text FROM '{B.SMALL}/conversations.parquet'").fetchall()
    got = sorted((tuple(r) for r in Q.REGISTRY["op11_prefix_trie"][0](sp, B.SMALL).collect()), key=repr)
    assert got == brute_trie(rows)


def test_scan_splits_one_key_over_tasks(sp):
    df = sp.range(4000).select((F.col("id") % 3 * F.when(F.col("id") % 2 == 0, 0).otherwise(1)).alias("k"), "id",
                               F.xxhash64("id").alias("v"), (F.col("id") * 3).alias("w"))
    got = _scan.scan(df, "k", [F.col("id")], sums=["w"], lanes=["v"]).orderBy("k", "id").collect()
    assert len({r.k for r in got}) == 3
    held = {}
    for r in got:
        n, w, v = held.get(r.k, (0, 0, 0))
        now = (v + r.v * pow(int(_scan.BASE), n, 1 << 64)) % (1 << 64)
        assert (r.place, r.w_run, r.v_before % (1 << 64), r.v_upto % (1 << 64)) == (n, w + r.w, v, now)
        held[r.k] = (n + 1, w + r.w, now)


# -- runs --------------------------------------------------------------------------

def brute_runs(w, least=12):
    out = {}
    for p in range(1, len(w) // 2 + 1):
        i = 0
        while i < len(w) - p:
            j = i
            while j < len(w) - p and w[j] == w[j + p]:
                j += 1
            if j > i and j + p - i >= max(least, 2 * p):
                out.setdefault((i, j + p), p)
            i = max(j, i + 1)
    return sorted((s, e - s, p) for (s, e), p in out.items())


def brute_op12(d, text):
    w = B.WORD.findall(text or "")
    n = len(w)
    h = zlib.crc32(str(d).encode()) if d is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    runs = brute_runs(w)
    gone = {i for s, m, p in runs for i in range(s + p, s + m)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (d, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            sha("".join(f"{s},{m},{p}\n" for s, m, p in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def periodic_texts(seed, n=120):
    rng = random.Random(seed)
    out = []
    for d in range(n):
        words = [rng.choice("ab") if rng.random() < .5 else rng.choice(["ab", "é", "x,y", "日本"]) for _ in range(rng.randrange(1, 12))]
        kind, m = rng.randrange(4), rng.randrange(0, 90)
        if kind == 0:
            w = (words * 90)[:m]
            for _ in range(rng.randrange(3) if w else 0):
                w[rng.randrange(len(w))] = "z"
        elif kind == 1:
            a, w = ["a"], ["a", "b"]
            while len(w) < m:
                a, w = w, w + a
        elif kind == 2:
            x = ["a"] + ["b", "a"] * rng.randrange(1, 8)
            w = ["b", "a"] * rng.randrange(6) + x + x + ["b", "a"] * rng.randrange(6) + x
        else:
            w = [rng.choice("ab") for _ in range(m)]
        out.append((d, rng.choice([" ", "\n", " \t\v"]).join(w)))
    return out


def op12(df):
    found = periodic_runs.collapse(df, edit=periodic_runs.stretched)
    return sorted((tuple(r) for r in periodic_runs.digest(found).collect()), key=repr)


def test_runs_equal_brute_force(sp):
    rows = periodic_texts(1) + [(900, None), (901, ""), (902, " \n\t "), (None, "a " * 30), (903, "a b " * 20), (903, "a b " * 20),
                                (10 ** 12, "q " * 11), (905, "q " * 12)]
    got = op12(docs(sp, rows).repartition(4))
    assert got == sorted((brute_op12(d, t) for d, t in rows), key=repr)
    assert sum(r[1] for r in got) > 200
    assert op12(docs(sp, rows).limit(0)) == []


@pytest.mark.parametrize("least", [2, 12])
def test_find_runs_on_small_alphabets(least):
    rng = random.Random(least)
    for _ in range(400):
        texts = [t.split() for _, t in periodic_texts(rng.random(), 3)]
        names = {w: k for k, w in enumerate({x for t in texts for x in t})}
        words = np.array([names[x] for t in texts for x in t], np.int64)
        doc = np.array([k for k, t in enumerate(texts) for _ in t], np.int64)
        got = list(zip(*(x.tolist() for x in periodic_runs.find_runs(words, doc, least))))
        want, at = [], 0
        for t in texts:
            want += [(s + at, m, p) for s, m, p in brute_runs(t, least)]
            at += len(t)
        assert got == want


def test_runs_of_a_text_above_the_slice_size(sp):
    """Three million words of one period, after words that do not repeat."""
    text = " ".join(map(str, range(1000))) + " " + "ab cd " * 600_000
    r = periodic_runs.collapse(docs(sp, [(1, text), (2, "x y")])).orderBy("doc_id").first()
    assert [tuple(x) for x in r.runs] == [(1000, 1_200_000, 2)]
    assert r.collapsed == " ".join(map(str, range(1000))) + " ab cd"


def test_runs_query_equals_brute_force_on_given_table(sp):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{B.SMALL}/documents.parquet' WHERE length(text) < 4000").fetchall()
    got = {r.doc_id: tuple(r) for r in Q.REGISTRY["op12_periodic_runs"][0](sp, B.SMALL).collect()}
    assert len(got) == 200
    assert all(got[d] == brute_op12(d, t) for d, t in rows)


# -- packing -----------------------------------------------------------------------

@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(best_fit.vocabulary_path())
    t.encode_special_tokens = True
    return t


def test_encoder_equals_tokenizer(tokenizer):
    rng = random.Random(1)
    signs = list("ab1 ''''stmdrevl\n\t !?.,é日本語٣½²Ⅷ_-　 \u0085 ᠎🎉́\x00\x1c\x1f")
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(40))) for _ in range(5000)]
    texts += ["", "a<|endoftext|>b", "\n's", "  's", "''s", "'re'll've 'd'm't", "x'"]
    texts += ["".join(chr(c) for c in range(a, a + 64) if not 0xD800 <= c < 0xE000) for a in range(0, 0x30000, 64)]
    off, data = utf8(pa.array(texts, pa.large_string()))
    code = best_fit.Encoder(best_fit.vocabulary_path())
    for _ in range(2):  # the second time from remembered words
        ids, size = code.encode(data, off)
        want = [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
        assert ids.tolist() == [y for x in want for y in x] and size.tolist() == [len(x) for x in want]
    one = " ".join(texts[:300])
    off, data = utf8(pa.array([one], pa.large_string()))
    assert code.encode(data, off, limit=500)[0].tolist() == tokenizer.encode(one, add_special_tokens=False).ids


def check_packing(rows, got, tokenizer, width=1024):
    """Pieces are those of the documents; sequences are gapless and within the width."""
    want = collections.Counter()
    for d, t in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
        head = (len(ids) - 1) % width + 1
        for k, a in enumerate([0, *range(head, len(ids), width)]):
            part = ids[a:head if k == 0 else a + width]
            want[(d, k, a, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] += 1
    assert collections.Counter(tuple(r)[:5] for r in got) == want
    by_sequence = collections.defaultdict(list)
    for r in got:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= width
    return len(by_sequence), -(-sum(r.length for r in got) // width)


def test_packing_of_odd_texts(sp, tokenizer):
    rows = [(1, None), (2, ""), (3, " \n "), (4, "one two"), (4, "one two"), (None, "one two"), (5, "日本語 🎉 \x00" * 900),
            (6, "word " * 1023), (7, "word " * 1022 + "word"), (8, "a b " * 40_000)]
    for width in (1024, 7):
        got = best_fit.pack(docs(sp, rows), width=width).collect()
        used, least = check_packing(rows, got, tokenizer, width)
        assert used <= least + 1 + (width == 7)
    assert best_fit.pack(docs(sp, rows).limit(0)).count() == 0


def test_packed_sequences_hold_the_tokens(sp, tokenizer):
    rows = [(k, f"text number {k} " * (k % 90)) for k in range(200)]
    packed = best_fit.pack(docs(sp, rows).repartition(3), with_ids=True, block=50, open_bins=20)
    check_packing(rows, packed.drop("ids").collect(), tokenizer)
    held = best_fit.sequences(packed).collect()
    want = {r.sequence_id: [] for r in held}
    for r in sorted(packed.collect(), key=lambda r: r.offset):
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
        want[r.sequence_id] += r.ids
    assert {r.sequence_id: r.ids for r in held} == want and sum(r.n_docs for r in held) == packed.count()


def test_packing_query_needs_hardly_more_than_the_least(sp, tokenizer):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{B.SMALL}/documents.parquet'").fetchall()
    used, least = check_packing(rows, Q.REGISTRY["op13_best_fit"][0](sp, B.SMALL).collect(), tokenizer)
    assert used <= least * 1.03


def test_bins_take_the_fullest_that_fits_and_close_the_fullest():
    rng = random.Random(4)
    for most in (1, 3, 50):
        bins, plain, n = best_fit.Bins(64, most), {}, 0
        for _ in range(600):
            x = rng.randrange(1, 64)
            fit = [b for b in plain if plain[b] + x <= 64]
            number, place = bins.put(x)
            if fit:
                assert plain[number] == max(plain[b] for b in fit) == place
                plain[number] += x
            else:
                assert (number, place) == (n, 0)
                if len(plain) == most:
                    full = max(plain.values())
                    shut = [b for b in plain if plain[b] == full]
                    plain.pop(next(b for b in shut if b not in {q for f in bins.free for q in f}))
                plain[n], n = x, n + 1
            plain = {b: v for b, v in plain.items() if v < 64}
            assert len(plain) == bins.open == sum(map(len, bins.free)) <= most
