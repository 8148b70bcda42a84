"""The operators on training text against brute force, and their defined edge cases."""

import hashlib
import random
import time

import duckdb
import numpy as np
import pyarrow as pa
import pytest

import llm_brute as B
from shoppulse.llm import (embedding_dedup, fingerprint, line_dedup, lm_score, mixing, ngram_join, quality_cnn,
                           sentencepiece, suffix_dedup, toxicity)
from shoppulse.llm import queries as Q
from shoppulse.llm._spark import components, ship, table, thinned
from shoppulse.llm._text import mix64, prefix, span, utf8

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, h string, t string, n_lines string"


@pytest.fixture(scope="module")
def sp(spark):
    ship(spark)
    return spark


def frame(spark, rows):
    """Documents with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(d, t, None, s, None, None, "x", None, "y") for d, t, s in rows], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


ODD = [(1, None, "a"), (2, "", "a"), (3, " \n\t ", None), (4, "one two", "b"), (4, "one two", "b"), (None, "one two", "b"),
       (5, "x" * 5000 + " " + "y z " * 3000, "a"), (6, "日本語 и кириллица 🎉 \x00 end", "c")]


def collect(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


# -- suffix arrays -------------------------------------------------------------

def _phrases(seed, n=70):
    rng = random.Random(seed)
    words = ["alpha", "bé", "gamma", "d", "epsilon", "ζeta"]
    shared = [" ".join(rng.choice(words) for _ in range(k)) for k in (10, 16, 22, 30, 60, 200)]
    line = "Th of inth onston of onti thor tionlyha by enth and more words to fill this!!"
    out = []
    for d in range(n):
        t = " ".join(rng.choice(shared) if rng.random() < .5 else
                     " ".join(rng.choice(words) + str(rng.randrange(999)) for _ in range(rng.randrange(1, 40)))
                     for _ in range(rng.randrange(0, 6)))
        out.append((d, t, "s"))
    out += [(300 + k, " ".join(str(rng.randrange(10 ** 6)) for _ in range(30)) + line
             + " ".join(str(rng.randrange(10 ** 6)) for _ in range(30)), "s") for k in range(40)]
    return out + [(900, "ab" * 400, "s"), (901, "ab" * 300 + "x", "s"), (902, None, "s"), (903, "", "s"), (904, "a" * 99, "s"),
                  (905, "a" * 100, "s"), (906, "a" * 101, "s"), (None, "ab" * 200, "s")]


def test_suffix_dedup_equals_brute_force(sp):
    rows = _phrases(5)
    want = B.repeated_bytes([(d, t) for d, t, _ in rows])
    got = collect(suffix_dedup.dedup(frame(sp, rows).repartition(7), with_text=True))
    assert {d: tuple(r)[1:5] for d, r in got.items()} == want
    assert all(hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256 for r in got.values())


def test_suffix_dedup_repeated_rows_and_empty(sp):
    rows = [(1, "q" * 150, "s"), (1, "q" * 150, "s"), (2, "q" * 150, "s")]
    got = [tuple(r)[1:4] for r in suffix_dedup.dedup(frame(sp, rows)).orderBy("doc_id").collect()]
    assert got[0] == got[1] == (150, 149, 1) and got[2] == (150, 150, 1)
    assert suffix_dedup.dedup(empty(sp)).count() == 0


def test_suffix_array_and_common_prefixes():
    rng = np.random.default_rng(0)
    data = rng.integers(97, 99, 600).astype(np.uint8)
    data[300:500] = data[50:250]
    order, rank = suffix_dedup.suffix_array(data, 100)
    raw = data.tobytes()
    keys = [raw[i:i + 100].ljust(100, b"\0") for i in order]
    assert keys == sorted(keys)
    common = suffix_dedup.common_prefixes(data, order, 100)
    wide = raw + b"\0" * 108
    for k in range(1, len(order)):
        a, b = order[k - 1], order[k]
        n = 0
        while n < 100 and wide[a + n] == wide[b + n]:
            n += 1
        assert common[k] == n


# -- lines -----------------------------------------------------------------------

def test_line_dedup_equals_brute_force(sp):
    rng = random.Random(3)
    base = ["the quick brown fox jumps over %d" % i for i in range(12)] + ["Ünïcödé line of some length é%d" % i for i in range(4)]
    base += ["short", "", "   padded line with spaces here  "]

    def mutated(x):
        i = rng.randrange(len(x) + 1)
        return rng.choice([x, x, x[:i] + x[i + 1:], x[:i] + rng.choice("abé ") + x[i:], x[:i] + "z" + x[i + 1:]])

    rows = [(k, "\n".join(mutated(rng.choice(base)) for _ in range(rng.randrange(0, 9))), "s") for k in range(50)]
    rows += [(70, None, "s"), (None, "the quick brown fox jumps over 1\nthe null id comes first", "s")] + [(71, "again and again and again", "s")] * 2
    want = B.dedup_lines([(d, t) for d, t, _ in rows])
    got = line_dedup.dedup_lines(frame(sp, rows)).collect()
    assert len(got) == len(rows)
    sources = dict((d, t) for d, t, _ in rows)
    for r in got:
        if sources[r.doc_id] is None:
            assert r.text is None and r.n_lines == 0 and r.n_dropped == 0
        else:
            assert r.text == want[(r.doc_id, sources[r.doc_id])][0], r
        assert r.h == "x"
    assert sum(r.n_dropped for r in got) > 50
    assert line_dedup.dedup_lines(empty(sp)).count() == 0


def test_line_dedup_odd_rows(sp):
    assert line_dedup.dedup_lines(frame(sp, ODD)).count() == len(ODD)


def test_line_dedup_short_lines(sp):
    """Equal short lines go, those one edit apart stay; the query asks for it."""
    rows = [(1, "Read more\n\n猫が好き。\nx", "s"), (2, " Read more\n\n猫が好き\n猫が好き。\ny", "s"), (3, "Read more\nx", "s")]
    got = collect(line_dedup.dedup_lines(frame(sp, rows), short=True))
    assert [got[k].text for k in (1, 2, 3)] == [rows[0][1], "\n猫が好き\ny", ""]


# -- n-grams --------------------------------------------------------------------

def _near_texts():
    rng = random.Random(9)
    words = [f"w{k}" for k in range(300)]
    out = []
    for g in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([3, 6, 40, 120]))]
        for _ in range(rng.randrange(1, 8)):
            w = list(base)
            for _ in range(rng.randrange(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(words)
            out.append(" ".join(w))
    return [(100 - k, t, "s") for k, t in enumerate(out)]


def test_ngram_join_equals_brute_force(sp):
    rows = _near_texts() + [(200, None, "s"), (201, "", "s"), (202, "  ", "s"), (203, "  ", "s")]
    got = collect(ngram_join.join(frame(sp, rows)))
    want = B.classes([(d, B.shingle_set(t)) for d, t, _ in rows], B.similar)
    assert {d: (r.n_links, r.component_id) for d, r in got.items()} == {d: w for (d, _, _), w in zip(rows, want)}
    kept = {r.doc_id for r in ngram_join.first_of_each(frame(sp, rows)).collect()}
    assert kept == {w[1] for w in want}


def test_ngram_join_odd_rows(sp):
    got = ngram_join.join(frame(sp, ODD)).collect()
    assert len(got) == len(ODD)
    assert sorted(r.n_links for r in got) == [0] * 5 + [2] * 3  # "one two" three times
    assert ngram_join.join(empty(sp)).count() == 0
    assert ngram_join.first_of_each(frame(sp, ODD)).count() == 6


def test_bands_reach_the_recall():
    b = ngram_join.choose_bands(0.8, 0.999, 6)
    assert 1 - (1 - 0.8 ** 6) ** b >= 0.999 > 1 - (1 - 0.8 ** 6) ** (b - 1)


def test_block_overlaps_are_exact():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 9000, n).astype(np.uint64)) for n in (1, 10, 3000, 6000, 6000)]
    got = ngram_join.overlaps(sets[:2], sets[2:])
    assert got.tolist() == [[len(np.intersect1d(a, b)) for b in sets[2:]] for a in sets[:2]]


# -- embeddings --------------------------------------------------------------------

def test_embeddings_equal_brute_force(sp):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((60, 64))
    rows = [x.tolist() for x in base]
    rows += [(base[k % 60] + rng.standard_normal(64) * rng.choice([.02, .1, .2, .3])).tolist() for k in range(240)]
    rows += [rows[0], [2 * v for v in rows[1]], None, [0.0] * 64, [float("nan")] * 64, [None] + [1.0] * 63, [1.0, 2.0], [2.0, 4.0], []]
    data = [(1000 - k, r) for k, r in enumerate(rows)] + [(1000, rows[0])]
    df = sp.createDataFrame([(i, r, 1, "c") for i, r in data], "vec_id long, embedding array<double>, label int, t string")
    got = sorted(tuple(r) for r in embedding_dedup.near_duplicates(df).collect())

    def unit(r):
        if not r or any(v is None or not np.isfinite(v) for v in r) or not any(r):
            return None
        x = np.array(r)
        return x / np.linalg.norm(x)

    want = B.classes([(i, unit(r)) for i, r in data], lambda a, b: a is not None and b is not None and len(a) == len(b) and a @ b >= 0.95)
    assert got == sorted((i, n, c, i == c) for (i, _), (n, c) in zip(data, want))
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_embedding_recall_at_the_threshold():
    rng = np.random.default_rng(7)
    x = rng.standard_normal((4000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    side = rng.standard_normal(x.shape)
    side -= (side * x).sum(1)[:, None] * x
    side /= np.linalg.norm(side, axis=1)[:, None]
    y = 0.951 * x + np.sqrt(1 - 0.951 ** 2) * side
    index = embedding_dedup.Index(x, 64)
    margin = embedding_dedup.probe_margin(64, 0.95)
    (a, (ra, la)), (b, (rb, lb)) = index.probes(x, margin), index.probes(y, margin)
    p, q = set(zip(ra.tolist(), la.tolist())), set(zip(rb.tolist(), lb.tolist()))
    found = [a[k] == b[k] or (k, b[k]) in p or (k, a[k]) in q for k in range(len(x))]
    assert np.mean(found) > 0.995


def test_embedding_recall_of_low_rank_vectors():
    """Neighbours that differ in 6 of 256 dimensions only: none is lost."""
    rng = np.random.default_rng(8)
    x = rng.standard_normal((4000, 6))
    x /= np.linalg.norm(x, axis=1)[:, None]
    side = rng.standard_normal(x.shape)
    side -= (side * x).sum(1)[:, None] * x
    side /= np.linalg.norm(side, axis=1)[:, None]
    y = 0.951 * x + np.sqrt(1 - 0.951 ** 2) * side
    x, y = (np.pad(v, ((0, 0), (0, 250))) for v in (x, y))
    index = embedding_dedup.Index(x, 64)
    margin = embedding_dedup.probe_margin(256, 0.95)
    (a, (ra, la)), (b, (rb, lb)) = index.probes(x, margin), index.probes(y, margin)
    p, q = set(zip(ra.tolist(), la.tolist())), set(zip(rb.tolist(), lb.tolist()))
    assert all(a[k] == b[k] or (k, b[k]) in p or (k, a[k]) in q for k in range(len(x)))


def _neighbours(rng, n, dim):
    x = rng.standard_normal((n, dim))
    x /= np.linalg.norm(x, axis=1)[:, None]
    side = rng.standard_normal(x.shape)
    side -= (side * x).sum(1)[:, None] * x
    side /= np.linalg.norm(side, axis=1)[:, None]
    return x, 0.951 * x + np.sqrt(1 - 0.951 ** 2) * side


@pytest.mark.parametrize("rank,dim,least", [(64, 64, 0.995), (20, 768, 0.995), (6, 256, 1.0)])
def test_embedding_margins_measured_on_the_sample(rank, dim, least):
    """Neighbours at the threshold are probed whatever the rank; in many dimensions few lists are."""
    rng = np.random.default_rng(rank)
    x, y = _neighbours(rng, 4000, rank)
    turn = np.linalg.qr(rng.standard_normal((dim, rank)))[0].T  # any directions, not the axes
    x, y = x @ turn, y @ turn
    index = embedding_dedup.Index(x, 64)
    index.fit_probes(x, 0.95)
    (a, (ra, la)), (b, (rb, lb)) = index.probes(x), index.probes(y)
    p, q = set(zip(ra.tolist(), la.tolist())), set(zip(rb.tolist(), lb.tolist()))
    assert np.mean([a[k] == b[k] or (k, b[k]) in p or (k, a[k]) in q for k in range(len(x))]) >= least
    if rank == 64:
        assert len(ra) < 0.35 * len(index.probes(x, embedding_dedup.probe_margin(dim, 0.95))[1][0])


def test_embedding_margins_widen_where_the_sample_tells():
    """Neighbours displaced along one direction only, which the residuals hardly show."""
    rng = np.random.default_rng(3)
    x = rng.standard_normal((3000, 32))
    x[:, 0] *= 0.2
    x /= np.linalg.norm(x, axis=1)[:, None]
    y = x.copy()
    y[:, 0] += 0.3
    y /= np.linalg.norm(y, axis=1)[:, None]
    both = np.concatenate([x, y])
    index = embedding_dedup.Index(both, 48)
    assert index.fit_probes(both, 0.95) >= embedding_dedup.RECALL


def test_thinned_edges_connect_the_same(sp):
    rng = random.Random(6)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(k, h) for k in range(300, 340) for h in range(290, 300)]
    df = sp.createDataFrame(edges, "src long, dst long")
    less = thinned(df)
    assert {tuple(r) for r in components(less).collect()} == {tuple(r) for r in components(df).collect()}
    assert less.filter("src >= 290").count() == 49


# -- mixing ------------------------------------------------------------------------

def test_mix_equals_brute_force_and_sql(sp):
    rng = random.Random(2)
    rows = [(k, " ".join("w" * rng.randrange(1, 4) for _ in range(rng.randrange(0, 30))), rng.choice(["a", "b", "b", "b", "z", "é", None]))
            for k in range(300)]
    rows += [(400, None, "a"), (401, " \t", "empty")]
    got = collect(mixing.mix(frame(sp, rows)))
    taken, target = B.mix(rows)
    assert {d: r.repeats for d, r in got.items()} == taken
    for r in got.values():
        assert r.target == pytest.approx(target[r.source]) and r.taken == r.repeats * r["size"] <= 3 * r["size"]
    copies = mixing.mixed_rows(frame(sp, rows)).groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in copies} == {d: n for d, n in taken.items() if n}
    assert mixing.mix(empty(sp)).count() == 0 and mixing.mixed_rows(empty(sp)).count() == 0
    assert mixing.mix(frame(sp, ODD)).count() == len(ODD)


# -- pieces -------------------------------------------------------------------------

def test_encoding_equals_brute_force_and_round_trips(sp):
    vocab = sentencepiece.pieces(sentencepiece.MODEL)
    texts = ["Hello  wörld\n x\t y 日本 ٣ ", "", None, " a", " ", "   ", "x ", "🎉 e\r\n\r\nend", "thontition " * 50, "z" * 300]
    off, data = utf8(pa.array(texts, pa.string()))
    ids, at = sentencepiece.encode_texts(off, data, vocab)
    for k, t in enumerate(texts):
        assert ids[at[k]:at[k + 1]].tolist() == B.viterbi(t or "", vocab)
    assert [b.decode() for b in sentencepiece.decode_ids(ids, at, vocab)] == [t or "" for t in texts]
    df = frame(sp, [(k, t, "s") for k, t in enumerate(texts)])
    tokens = sentencepiece.encode(df)
    back = {r.doc_id: r for r in sentencepiece.decode(tokens).collect()}
    assert [back[k].decoded for k in range(len(texts))] == texts
    assert all(r.round_trip for r in back.values()) and back[2].token_ids is None and back[1].token_ids == []
    assert sentencepiece.encode(empty(sp)).count() == 0


# -- classifiers ------------------------------------------------------------------------

def _held_out(spark, name, label):
    import pandas as pd
    labels = pd.read_parquet("/root/testdata/sf0.1/labels.parquet").set_index("doc_id")[label].to_dict()
    rows = [r for r in Q.REGISTRY[name][0](spark, "/root/testdata/sf0.1").collect()]
    assert len(rows) == 10000 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    return [labels[r.doc_id] for r in held], [r.score for r in held]


def test_quality_on_held_out_documents(sp):
    assert B.auc(*_held_out(sp, "op4_quality", "quality")) > 0.99


def test_toxicity_on_held_out_documents(sp):
    assert B.auc(*_held_out(sp, "op2_toxicity", "toxic")) > 0.94


def _labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_quality_odd_rows(sp):
    docs = frame(sp, ODD + [(k, f"good text number {k}. It goes on.", "s") for k in range(20, 40)]
                 + [(k, "bad!!! " * k, "s") for k in range(40, 60)])
    labels = _labels(sp, [(k, int(k < 40), 0) for k in range(20, 60)] + [(None, 1, 1), (21, None, None), (20, 1, 0), (9999, 0, 0)])
    got = quality_cnn.classify(docs, labels).collect()
    assert len(got) == docs.count() and all(r.score is not None for r in got)
    assert quality_cnn.keep_good(docs, labels).columns == docs.columns
    none = quality_cnn.classify(docs, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    assert quality_cnn.classify(empty(sp), labels).count() == 0


def test_network_sees_the_whole_text_and_no_neighbour():
    rng = np.random.default_rng(0)
    net = quality_cnn.Network(quality_cnn.start_taps(rng), np.zeros(16, np.float32),
                              rng.standard_normal(32).astype(np.float32), np.zeros(1, np.float32))
    texts = ["", "a", "x" * 113, "y" * 128, "z " * 500, "é" * 700, "q" * 2000 + "!!%%"]
    off, data = utf8(pa.array(texts))
    together = net.score(data, off)
    alone = [net.score(*reversed(utf8(pa.array([t]))))[0] for t in texts]
    assert np.allclose(together, alone)
    a, b = (net.score(*reversed(utf8(pa.array(["w" * 5000 + end]))))[0] for end in ("", "!!%%&&"))
    assert a != b


def test_toxic_folding_and_exceptions():
    m = toxicity.Matcher({" idiot ".replace("l", "i"): 3.0, " trash ": 2.0})
    assert m.strength("You 1d10t")[0] == 3.0 and m.strength("ІDІОТ!")[0] == 3.0 and m.strength("id​iöt")[0] == 3.0
    assert m.strength("the trash can")[0] == 0.0 and m.strength("trash talk")[0] == 2.0
    assert m.strength(None) == (0.0, 0) and m.strength("")[0] == 0.0 and m.strength("idiotic")[0] == 0.0
    assert toxicity.folded("ｆｕｌｌ $$$ c@t $cum").split() == ["fuii", "cat", "scum"]


def test_toxicity_keeps_the_forms_of_a_word(sp):
    """A whole word before its inflected form: both stay, and a longer form hides no shorter one."""
    rows = [(f"you moron {k % 7}", 1) for k in range(60)] + [("the morons", 1)] * 30 + [("a morose morocco moroni", 0)] * 90
    got = toxicity.learn_lexicon(sp.createDataFrame(rows, "text string, label int"))
    m = toxicity.Matcher(got)
    assert m.strength("moron")[0] > 0 and m.strength("morons")[0] > 0 and m.strength("morocco")[0] == 0
    assert toxicity.covers(" mor", " moron ") and not toxicity.covers(" moron ", " morons ")
    assert not toxicity.covers(" morons", " moron ") and not toxicity.covers("\x01é", " é")
    assert toxicity.Matcher({" moro": 2.0, " moron ": 3.0}).strength("moron moros")[0] == 5.0


def test_toxicity_odd_rows(sp):
    docs = frame(sp, ODD + [(k, f"plain words {k} here", "s") for k in range(20, 60)] + [(k, f"you {k} utter grobian", "s") for k in range(60, 100)])
    labels = _labels(sp, [(k, 1, int(k >= 60)) for k in range(20, 100)] + [(None, 1, 1), (21, 1, None)])
    got = toxicity.classify(docs, labels).collect()
    assert len(got) == docs.count()
    assert all((r.predicted == 1) == (60 <= r.doc_id < 100) for r in got if r.doc_id and r.doc_id >= 20)
    assert {r.score for r in toxicity.classify(docs, labels.limit(0)).collect()} == {0.5}
    assert toxicity.classify(empty(sp), labels).count() == 0


# -- language model ----------------------------------------------------------------------

def test_lm_prefers_the_order_it_was_trained_on(sp):
    rng = random.Random(1)
    nouns, verbs, ends = ([f"{p}{k}" for k in range(12)] for p in "nve")
    rows = [(k, " ".join(f"{rng.choice(nouns)} {rng.choice(verbs)} {rng.choice(ends)}" for _ in range(60)), "s") for k in range(400)]
    model = lm_score.fit(frame(sp, rows).repartition(4))
    shuffled = [(d, " ".join(rng.sample(t.split(), len(t.split()))), s) for d, t, s in rows[:60]]
    real = lm_score.score(frame(sp, rows[:60]), model).collect()
    other = lm_score.score(frame(sp, shuffled), model).collect()
    assert np.mean([r.per_word for r in real]) > np.mean([r.per_word for r in other]) + 0.3
    odd = collect(lm_score.score(frame(sp, ODD), model))
    assert odd[1].score == 0 and odd[1].per_word is None and odd[3].n_words == 0 and odd[5].n_words > 6000
    assert lm_score.score_corpus(empty(sp)).count() == 0


def test_lm_every_word_is_a_training_target(sp):
    """The words a stride of 12 with offsets 0, 4 and 8 would never predict are learnt too."""
    cycle = ["f" if k % 4 == 0 else f"w{k}" for k in range(12)]
    docs = frame(sp, [(k, " ".join(cycle * 10), "s") for k in range(100)]).coalesce(1)
    got = lm_score.score_corpus(docs).collect()
    assert min(r.per_word for r in got) > -0.3


def test_lm_probabilities_equal_a_plain_softmax():
    rng = np.random.default_rng(0)
    vocab = lm_score.Vocabulary(rng.integers(0, 50, lm_score.BUCKETS))
    net = lm_score.Network.start(vocab.log_class)
    off, data = utf8(pa.array(["a b c d", "e", "", "f g"]))
    bucket, row = lm_score.buckets(data, off)
    klass = vocab.klass[bucket]
    around = lm_score.windows(klass, row)
    got = net.log_probability(around, klass)
    for k in range(len(klass)):
        side = [klass[k + s] if 0 <= k + s < len(klass) and row[k + s] == row[k] else lm_score.PAD for s in lm_score.SIDES]
        assert around[k].tolist() == side
        z = sum(net.side[j][c] for j, c in enumerate(side)) @ net.out + net.bias
        assert got[k] == pytest.approx(z[klass[k]] - np.log(np.exp(z).sum()), abs=1e-4)
    share = np.zeros(lm_score.CLASSES)
    np.add.at(share, vocab.klass, np.exp(vocab.share.astype(float)))
    assert np.allclose(share, 1, atol=1e-3)


def _plain_steps(net, around, target):
    """The same Adagrad steps, as the formulas have them: float32, one product for a step and dense sums."""
    side, out, bias = net.side.copy(), net.out.copy(), net.bias.copy()
    memory = [np.full_like(x, 1e-2) for x in (side, out, bias)]
    spot = around + np.arange(len(lm_score.SIDES)) * (lm_score.CLASSES + 1)
    for i in range(0, len(target), lm_score.BATCH):
        x, t = spot[i:i + lm_score.BATCH], target[i:i + lm_score.BATCH]
        h = sum(side.reshape(-1, lm_score.WIDTH).take(x[:, j], axis=0) for j in range(x.shape[1]))
        z = out.T @ h.T + bias[:, None]
        z -= z.max(axis=0)
        p = np.exp(z)
        p /= p.sum(axis=0)
        p[t, np.arange(len(t))] -= 1
        p /= len(t)
        cell = (x[:, :, None] * lm_score.WIDTH + np.arange(lm_score.WIDTH)).ravel()
        parts = np.broadcast_to((out @ p).T[:, None, :], (*x.shape, lm_score.WIDTH)).ravel()
        g_side = np.bincount(cell, parts, side.size).astype(np.float32).reshape(side.shape)
        for value, g, m in zip((side, out, bias), (g_side, (p @ h).T, p.sum(axis=1)), memory):
            m += g * g
            value -= lm_score.RATE * g / np.sqrt(m)
    return side, out, bias


def _lm_words(n, seed=3):
    rng = np.random.default_rng(seed)
    klass = np.minimum(rng.zipf(1.3, n) - 1, lm_score.CLASSES - 1).astype(np.int16)
    return lm_score.windows(klass, np.sort(rng.integers(0, n // 40 + 1, n))), klass


@pytest.mark.parametrize("n, scale", [(1, 1), (200, 1), (256, 1), (900, 1), (900, 60)])
def test_lm_steps_equal_plain_ones(n, scale):
    """Steps that fill their blocks and others; at 60 the logits' powers leave the range of 32-bit numbers."""
    around, klass = _lm_words(n)
    net = lm_score.Network.start(np.log(np.full(lm_score.CLASSES, 1 / lm_score.CLASSES, np.float32)))
    net.side[:] *= scale
    net.out[:] *= scale
    z = net.side[np.arange(len(lm_score.SIDES)), around].sum(axis=1).astype(float) @ net.out + net.bias
    assert (z.max() > 128) == (scale > 1)
    plain = z - z.max(axis=1, keepdims=True)
    plain = plain[np.arange(n), klass] - np.log(np.exp(plain).sum(axis=1))
    assert np.allclose(net.log_probability(around, klass), plain, rtol=1e-4, atol=1e-4)
    want = _plain_steps(net, around, klass)
    net.train(around, klass, [])
    for a, b in zip((net.side, net.out, net.bias), want):
        assert np.isfinite(a).all() and np.allclose(a, b, atol=1e-3 if scale > 1 else 1e-5, rtol=1e-3 if scale > 1 else 1e-5)


def test_lm_steps_cost_less_than_plain_ones():
    """Training every word three times is the operator's time; its steps take well below the CPU of plain ones."""
    around, klass = _lm_words(40 * lm_score.BATCH)
    start = lm_score.Network.start(np.zeros(lm_score.CLASSES, np.float32)).flat()
    took = {"plain": [], "steps": []}
    for _ in range(7):
        net = lm_score.Network.from_flat(start)
        for name, run in (("plain", lambda: _plain_steps(net, around, klass)), ("steps", lambda: net.train(around, klass, []))):
            before = time.thread_time()
            run()
            took[name].append(time.thread_time() - before)
    assert min(took["steps"]) < 0.75 * min(took["plain"])


# -- fingerprints --------------------------------------------------------------------------

def _pieces(text):
    import collections
    c = collections.Counter()
    for line in (text or "").split("\n"):
        m = [x.span() for x in B.WORD.finditer(line)]
        start, before = 0, 0
        for k, (i, j) in enumerate(m):
            raw = np.frombuffer(line[i:j].encode(), np.uint8)
            h = span(prefix(raw), np.array([0]), np.array([len(raw)]))
            cut = mix64(h + np.array([before], np.uint64) * fingerprint.CHECK)
            before = int(h[0])
            if int(cut[0]) < 2 ** 64 // fingerprint.PIECE_WORDS or k == len(m) - 1:
                c[line[m[start][0]:j]] += 1
                start = k + 1
    return c


def _jaccard(a, b):
    both = sum((a | b).values())
    return sum((a & b).values()) / both if both else 1.0


def test_fingerprints_equal_brute_force(sp):
    rng = random.Random(6)
    rows = [(3 * k, "\n".join(" ".join(rng.choice(["lorem", "ipsum", "döl", "日本", "🎉"]) + str(rng.randrange(30)) for _ in range(rng.randrange(0, 25)))
                              for _ in range(rng.randrange(0, 20))), "s") for k in range(80)]
    rows += [(7, None, "s"), (8, "", "s"), (10, rows[4][1], "s"), (None, "first of all", "s")]
    got = collect(fingerprint.with_next(frame(sp, rows)))
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    assert len(got) == len(rows)
    for k, (d, t, _) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        edited = t[:len(t) - half] + nxt[:half]
        r = got[d]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert r.near_edited == pytest.approx(_jaccard(_pieces(t), _pieces(edited)))
        assert r.near_next == pytest.approx(_jaccard(_pieces(t), _pieces(nxt)))
        after = got[order[(k + 1) % len(order)][0]].fingerprint
        assert r.near_edited == fingerprint.likeness_of(r.fingerprint, r.edited_fingerprint)
        assert r.near_next == fingerprint.likeness_of(r.fingerprint, after) == fingerprint.likeness_of(after, r.fingerprint)
    assert got[10].fingerprint == got[rows[4][0]].fingerprint
    single = fingerprint.with_next(frame(sp, [(1, "a b", "s")])).collect()
    assert single[0].near_next == 1.0
    assert fingerprint.with_next(empty(sp)).count() == 0
    assert fingerprint.with_next(frame(sp, ODD)).count() == len(ODD)


def test_differing_digests_are_recovered():
    a = "\n".join(f"line number {k}" for k in range(300))
    b = a.replace("number 7\n", "number seven\n").replace("number 250", "number 251")
    left, right = fingerprint.difference(a, b)
    assert (len(left), len(right)) == (2, 2)
    far = fingerprint.difference(a, "\n".join(f"else {k}" for k in range(400)))
    assert (len(far[0]), len(far[1])) == (300, 400)
    prints = fingerprint.prints_of([a, b, "\n".join(f"zz {k}" for k in range(40))]).texts()
    assert fingerprint.likeness_of(prints[0], prints[1]) == pytest.approx(298 / 302)
    assert fingerprint.likeness_of(prints[0], prints[0]) == 1.0 and fingerprint.likeness_of(prints[0], prints[2]) == 0.0
    assert len(prints[0]) > 3 * len(prints[2])


def test_published_fingerprints_of_given_documents(sp):
    """The columns are what two stored fingerprints give, for every row of a table."""
    docs = table(sp, B.SMALL, "documents")
    got = sorted(fingerprint.with_next(docs).collect(), key=lambda r: r.doc_id)
    stored = {r.doc_id: r.fingerprint for r in fingerprint.fingerprints(docs).collect()}
    assert len(got) == len(stored) > 100
    for r, following in zip(got, got[1:] + got[:1]):
        assert r.fingerprint == stored[r.doc_id]
        assert r.near_edited == fingerprint.likeness_of(r.fingerprint, r.edited_fingerprint)
        assert r.near_next == fingerprint.likeness_of(r.fingerprint, following.fingerprint)


def test_an_inserted_word_changes_few_pieces():
    rng = random.Random(8)
    for _ in range(20):
        words = [f"w{rng.randrange(5000)}" for _ in range(3000)]
        k = rng.choice([0, rng.randrange(3000)])
        one, two = fingerprint.prints_of([" ".join(words), " ".join(words[:k] + ["new"] + words[k:])]).texts()
        assert fingerprint.likeness_of(one, two) > 0.9


# -- SQL ----------------------------------------------------------------------------------------

@pytest.mark.parametrize("name", [n for n, (_, sql) in Q.REGISTRY.items() if sql])
def test_queries_match_duckdb(sp, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{B.SMALL}/{t}.parquet')")
    fn, sql = Q.REGISTRY[name]
    got = fn(sp, B.SMALL).toPandas()
    want = con.execute(sql).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    assert sorted(map(str, got[cols].values.tolist())) == sorted(map(str, want[cols].values.tolist()))
