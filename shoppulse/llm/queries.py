"""Queries of this package: name -> (callable(spark, sf_dir) -> DataFrame, DuckDB SQL or None)."""

from __future__ import annotations

import functools

from . import (best_fit, embedding_dedup, fingerprint, line_dedup, lm_score, mixing, ngram_join, periodic_runs, prefix_trie,
               quality_cnn, sentencepiece, suffix_dedup, toxicity)
from ._spark import ship, spread_rows, table

REGISTRY: dict = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        @functools.wraps(fn)
        def run(spark, sf_dir):
            ship(spark)
            return fn(spark, sf_dir)

        REGISTRY[name] = (run, sql)
        return run
    return deco


def op10_sql(docs: str = "documents") -> str:
    """SQL of the mix over the table or subquery ``docs`` (doc_id, text, source)."""
    return rf"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('17:' || coalesce(doc_id::VARCHAR, '')) AS h
  FROM {docs}),
src AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3
              WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w,
         (source_size * 3)::DOUBLE AS cap, sum(source_size) OVER () ::DOUBLE AS total
  FROM src),
tested AS (
  SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / w, source IS NULL, source
                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_cap,
         sum(w) OVER (ORDER BY cap / w, source IS NULL, source
                      ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_from
  FROM ranked),
clamped AS (SELECT *, w * (total - before_cap) / w_from > cap AS above FROM tested),
rest AS (
  SELECT coalesce(sum(cap) FILTER (WHERE above), 0) AS c, sum(w) FILTER (WHERE NOT above) AS open_w FROM clamped),
goal AS (
  SELECT source, source_size, CASE WHEN above THEN cap ELSE w * (total - c) / open_w END AS target
  FROM clamped, rest),
parts AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM goal),
run AS (
  SELECT s.doc_id, s.size, s.source, g.source_size, g.target, g.whole,
         g.target - g.whole * g.source_size AS rest,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.h, s.doc_id, s.size
                           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM sized s JOIN parts g ON s.source IS NOT DISTINCT FROM g.source),
rep AS (
  SELECT *, CASE WHEN size > 0 THEN least(whole + (upto - size / 2.0 <= rest)::INT, 3) ELSE 0 END::BIGINT AS repeats
  FROM run)
SELECT doc_id, size, source, source_size, target, repeats, (size * repeats)::BIGINT AS taken FROM rep"""


@query("op10_mix", op10_sql())
def op10_mix(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"))


@query("op6_sentencepiece")
def op6_sentencepiece(spark, sf_dir):
    return sentencepiece.encode(spread_rows(table(spark, sf_dir, "documents").select("doc_id", "text")))


@query("op4_quality")
def op4_quality(spark, sf_dir):
    return quality_cnn.classify(spread_rows(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels"))


@query("op2_toxicity")
def op2_toxicity(spark, sf_dir):
    return toxicity.classify(spread_rows(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels"))


@query("op9_fingerprint")
def op9_fingerprint(spark, sf_dir):
    return fingerprint.with_next(table(spark, sf_dir, "documents"))


@query("op5_line_dedup")
def op5_line_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs, short=True)


def op8_sql(docs: str = "documents") -> str:
    """SQL of the n-gram join over the table or subquery ``docs`` (doc_id, text), all pairs compared exactly."""
    return rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM {docs}),
grams AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
           ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g
  FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
  FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
  WHERE c >= 0.8 * (p.n + q.n - c) - 1e-9),
reach AS (
  SELECT doc_id AS x, doc_id AS y FROM {docs}
  UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x)
SELECT d.doc_id, coalesce(l.n, 0)::BIGINT AS n_links, r.c AS component_id
FROM {docs} d
LEFT JOIN (SELECT x, count(*) AS n FROM links GROUP BY x) l ON l.x = d.doc_id
JOIN (SELECT x, min(y) AS c FROM reach GROUP BY x) r ON r.x = d.doc_id"""


@query("op8_ngram_join", op8_sql())
def op8_ngram_join(spark, sf_dir):
    return ngram_join.join(table(spark, sf_dir, "documents"))


OP1_SQL = """
WITH RECURSIVE parts AS (
  SELECT vec_id, embedding, unnest(embedding)::DOUBLE AS x FROM embeddings),
norms AS (
  SELECT vec_id, sqrt(sum(x * x)) AS n FROM parts GROUP BY vec_id),
units AS (
  SELECT e.vec_id, list_transform(embedding, lambda x: x::DOUBLE / n) AS u
  FROM embeddings e JOIN norms USING (vec_id)
  WHERE n > 0 AND isfinite(n) AND len(list_filter(embedding, lambda x: x IS NULL)) = 0),
links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM units a JOIN units b ON a.vec_id <> b.vec_id
  WHERE len(a.u) = len(b.u) AND list_dot_product(a.u, b.u) >= 0.95),
reach AS (
  SELECT vec_id AS x, vec_id AS y FROM embeddings
  UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x)
SELECT e.vec_id, coalesce(l.n, 0)::BIGINT AS n_links, r.c AS component_id, e.vec_id = r.c AS kept
FROM embeddings e
LEFT JOIN (SELECT x, count(*) AS n FROM links GROUP BY x) l ON l.x = e.vec_id
JOIN (SELECT x, min(y) AS c FROM reach GROUP BY x) r ON r.x = e.vec_id"""


@query("op1_embedding_dedup", OP1_SQL)
def op1_embedding_dedup(spark, sf_dir):
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


@query("op7_lm_score")
def op7_lm_score(spark, sf_dir):
    return lm_score.score_corpus(spread_rows(table(spark, sf_dir, "documents")))


@query("op3_suffix_dedup")
def op3_suffix_dedup(spark, sf_dir):
    return suffix_dedup.dedup(table(spark, sf_dir, "documents"))


@query("op11_prefix_trie")
def op11_prefix_trie(spark, sf_dir):
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


@query("op12_periodic_runs")
def op12_periodic_runs(spark, sf_dir):
    docs = spread_rows(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return periodic_runs.digest(periodic_runs.collapse(docs, edit=periodic_runs.stretched))


@query("op13_best_fit")
def op13_best_fit(spark, sf_dir):
    return best_fit.pack(spread_rows(table(spark, sf_dir, "documents").select("doc_id", "text")))
