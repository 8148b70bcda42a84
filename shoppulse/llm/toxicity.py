"""Toxicity: a weighted lexicon matched by Aho-Corasick in folded text.

A text is matched in two views, one after the other: the folded one, and the
same words in lower case with their accents.  Folding maps accented letters, look-alike letters of other alphabets and
full-width forms to a-z, digits and signs used as letters to those letters
(``l`` and ``1`` both to ``i``), drops invisible characters, and turns all else
into spaces.  Lexicon entries are folded alike and carry a leading space (a
word's start) and, for whole words, a closing one; in the second view the space
is ``LIGHT``.  The weights are the log ratios of an entry's frequencies in toxic
and clean texts: every word and word start of three letters or more is a
candidate, counted by Spark over the training sample.

A text's strength is the summed weight of the matches that lie in no exception
phrase, of those that start at one place the heaviest; the score is a logistic function, fitted on the sample, of the strength
and of the strength for each hundred words.

Defined cases: null and empty texts have no match and get the score of strength
0; labels without document or value are not used; without labels of both
classes the lexicon is empty and every score is 0.5; repeated rows are scored
alike; extra columns are not read.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._labels import fold as id_fold
from ._labels import sampled_texts
from ._text import slices, utf8

PER_CLASS = 3000
#: A lexicon entry needs so many toxic documents, that log ratio, and there are so many entries.
LEAST_DOCS, LEAST_RATIO, ENTRIES = 5, 2.0, 512
#: Occurrences of a candidate that count in one document, while the lexicon is learned.
MOST_EACH = 8
LIGHT = "\x01"
LONGEST = 12
THRESHOLD = 0.7
EXCEPTIONS = ("trash can", "trash bin", "trash collection", "clown fish", "idiot proof", "pond scum", "soap scum")

# Look-alike letters: code points and the letters they stand for.
LOOK_ALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "є": "e",
    "һ": "h", "н": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "ӏ": "l",
    "м": "m", "п": "n", "о": "o", "р": "p", "ԛ": "q", "г": "r", "ѕ": "s",
    "т": "t", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y", "з": "e",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v",
    "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "σ": "o",
    "ı": "i", "ɩ": "i", "ɑ": "a", "ɡ": "g", "ϲ": "c", "ո": "n", "ս": "u",
    "օ": "o", "ø": "o", "ð": "d", "ł": "l", "ß": "ss", "æ": "ae", "œ": "oe",
}
# Digits and signs written for letters.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "€": "e"}
INVISIBLE = "­​‌‍⁠﻿᠎"
TOTAL = ""
LETTERS = re.compile(r"[^\W\d_]+")
SIGNS = re.compile(r"[@$€]{2,}|[@$€](?![^\W_])")


class _Table(dict):
    """str.translate table, filled for each character when it first occurs."""

    def __missing__(self, code: int):
        ch = chr(code)
        out = SUBSTITUTES.get(ch)
        if out is None and (ch in INVISIBLE or unicodedata.combining(ch)):
            out = ""
        if out is None:
            out = ""
            for c in unicodedata.normalize("NFKD", ch).lower():
                c = LOOK_ALIKES.get(c, c)
                if unicodedata.combining(c[0]):
                    continue
                for d in c:
                    d = SUBSTITUTES.get(d, d)
                    out += d if "a" <= d <= "z" else " "
        out = out.replace("l", "i")
        self[code] = out
        return out


TABLE = _Table()


def folded(text: str) -> str:
    """Words of a-z between spaces, with one at either end."""
    if "$" in text or "@" in text or "€" in text:
        text = SIGNS.sub(" ", text)
    return f" {text.translate(TABLE)} "


def light(text: str) -> str:
    """The words in lower case with accents, between ``LIGHT`` signs."""
    return LIGHT + LIGHT.join(LETTERS.findall(text.lower())) + LIGHT


def candidates(text: str) -> Counter:
    """Whole words and word starts of both views of a text, with their counts."""
    out: Counter = Counter()
    for gap, view in ((" ", folded(text).split()), (LIGHT, light(text).split(LIGHT))):
        for w, n in Counter(view).items():
            if len(w) >= 3 and (gap == " " or not w.isascii()):
                if len(w) <= LONGEST:
                    out[f"{gap}{w}{gap}"] += n
                for k in range(3, min(len(w), LONGEST)):
                    out[gap + w[:k]] += n
    return out


def learn_lexicon(few: DataFrame) -> dict[str, float]:
    """Weights of the entries that mark toxic documents of ``few(text, label)``.

    Counts are summed in each task before they are shuffled; at most ``ENTRIES``
    of them, the strongest, come to the driver.
    """
    def rows(seen):
        keys = list(seen)
        cols = {"entry": pa.array(keys, pa.string())}
        for k, name in enumerate(("clean", "toxic", "docs")):
            cols[name] = pa.array([seen[x][k] for x in keys], pa.int64())
        return pa.RecordBatch.from_pydict(cols)

    def count(batches):
        seen: dict[str, list[int]] = {TOTAL: [0, 0, 0]}
        for batch in batches:
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
                got = candidates(text or "")
                seen.setdefault(TOTAL, [0, 0, 0])[label] += 1 + folded(text or "").count(" ")
                for c, n in got.items():
                    tally = seen.setdefault(c, [0, 0, 0])
                    tally[label] += min(n, MOST_EACH)
                    tally[2] += label
            if len(seen) > 200_000:
                yield rows(seen)
                seen = {}
        yield rows(seen)

    counts = (few.mapInArrow(count, "entry string, clean long, toxic long, docs long")
              .groupBy("entry").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"), F.sum("docs").alias("docs")))
    counts = counts.cache()
    total = counts.filter(F.col("entry") == TOTAL).first()
    ratio = (F.log((F.col("toxic") + 0.5) / F.lit(total.toxic + 1.0))
             - F.log((F.col("clean") + 0.5) / F.lit(total.clean + 1.0)))
    best = (counts.filter((F.col("entry") != TOTAL) & (F.col("docs") >= LEAST_DOCS)).withColumn("ratio", ratio)
            .filter(F.col("ratio") >= LEAST_RATIO)
            .orderBy(F.desc(F.col("toxic") * F.col("ratio")), F.desc(F.length("entry")), "entry").limit(ENTRIES).collect())
    counts.unpersist()
    out: dict[str, float] = {}
    for r in best:
        if not any(covers(x, r.entry) for x in out):
            out[r.entry] = float(r.ratio)
    return out


def covers(chosen: str, entry: str) -> bool:
    """Whether ``chosen`` matches wherever ``entry`` does, in a text's folded view if not in the entry's own."""
    if chosen[0] == entry[0]:
        return entry.startswith(chosen)
    plain = folded(entry.strip(LIGHT)).rstrip()
    return chosen[0] == " " and (plain + " " if entry[-1] == LIGHT else plain).startswith(chosen)


class Matcher:
    """Strengths of texts under a lexicon; the automaton is built where it is used."""

    def __init__(self, lexicon: dict[str, float], exceptions=EXCEPTIONS):
        self.lexicon, self.exceptions = lexicon, tuple(folded(x) for x in exceptions)
        self.automaton = None

    def __getstate__(self):
        return self.__dict__ | {"automaton": None}

    def _build(self):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for entry, weight in self.lexicon.items():
            self.automaton.add_word(entry, (entry, weight))
        for phrase in self.exceptions:
            self.automaton.add_word(phrase, (phrase, None))
        self.automaton.make_automaton()

    def strength(self, text: str | None) -> tuple[float, int]:
        """(summed weight of the matches outside exception phrases, words)."""
        if not text or not (self.lexicon or self.exceptions):
            return 0.0, 0
        if self.automaton is None:
            self._build()
        plain = folded(text)
        hits, free = [], []
        for end, (entry, weight) in self.automaton.iter(plain if text.isascii() else plain + light(text)):
            span = (end - len(entry) + 1, end + 1)
            (free if weight is None else hits).append((*span, weight))
        best: dict[int, float] = {}  # a word that several entries match counts once, with the heaviest
        for a, b, w in hits:
            if not any(x <= a and b <= y for x, y, _ in free):
                best[a] = max(w, best.get(a, w))
        return sum(best.values()), plain.count(" ")


def features(total: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.stack((np.log1p(total), np.log1p(100 * total / np.maximum(n, 40)), np.ones(len(total))), 1)


def strengths(docs: DataFrame, matcher: Matcher, extra: tuple = ()) -> DataFrame:
    """(doc_id, strength, n_words, *extra) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(matcher)  # ENTRIES entries at most
    kinds = "".join(f", {c} int" for c in extra)

    def run(batches):
        for batch in batches:
            off, data = utf8(batch.column("text"))
            for i, j in slices(off):
                raw = data[off[i]:off[j]].tobytes()
                edge = off[i:j + 1] - off[i]
                got = [shared.value.strength(raw[a:b].decode()) for a, b in zip(edge, edge[1:])]
                cols = [batch.column("doc_id").slice(i, j - i), pa.array([g[0] for g in got], pa.float64()),
                        pa.array([g[1] for g in got], pa.int64())]
                cols += [batch.column(c).slice(i, j - i) for c in extra]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "strength", "n_words", *extra])

    return docs.select("doc_id", "text", *extra).mapInArrow(run, "doc_id long, strength double, n_words long" + kinds)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Ridge-penalised logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(w)),
                               x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = PER_CLASS, exceptions=EXCEPTIONS):
    """(matcher, logistic weights) from at most ``per_class`` labelled documents of each class."""
    few = sampled_texts(docs, labels, label, per_class).repartition("doc_id").cache()
    n = {r.label: r["count"] for r in few.groupBy("label").count().collect()}
    if len(n) < 2:
        return Matcher({}, exceptions), np.zeros(3)
    matcher = Matcher(learn_lexicon(few), exceptions)
    got = strengths(few, matcher, ("label",)).orderBy("doc_id", "strength", "n_words").toArrow()
    few.unpersist()
    x = features(got.column("strength").to_numpy(), got.column("n_words").to_numpy().astype(float))
    return matcher, logistic(x, got.column("label").to_numpy().astype(float))


def score(docs: DataFrame, matcher: Matcher, weights: np.ndarray) -> DataFrame:
    """doc_id, strength, n_words, score."""
    a, b, c = (float(w) for w in weights)
    z = (F.lit(a) * F.log1p("strength")
         + F.lit(b) * F.log1p(100 * F.col("strength") / F.greatest(F.col("n_words"), F.lit(40))) + F.lit(c))
    return strengths(docs, matcher).withColumn("score", 1 / (1 + F.exp(-z)))


def classify(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 3, held: int = 1,
             per_class: int = PER_CLASS, exceptions=EXCEPTIONS) -> DataFrame:
    """doc_id, held_out, score, predicted, strength, n_words; labels of the held-out fold are not used."""
    matcher, weights = fit(docs, labels.filter(id_fold(F.col("doc_id"), folds) != held), label, per_class, exceptions)
    return (score(docs, matcher, weights)
            .withColumn("held_out", id_fold(F.col("doc_id"), folds) == held)
            .withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
            .select("doc_id", "held_out", "score", "predicted", "strength", "n_words"))
