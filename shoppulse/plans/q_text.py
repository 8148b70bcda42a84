"""Text-mining queries (documents, conversations, pages, events bodies)."""

from __future__ import annotations

from pyspark.sql import functions as F

from shoppulse.functions.text import WORD_PATTERN, clean_text, char_runs
from shoppulse.operators import text as T
from shoppulse.plans import fixtures as FX
from shoppulse.plans.catalog import query
from shoppulse.session import spread

W = WORD_PATTERN
STOP_SQL = ", ".join(f"'{w}'" for w in FX.STOP_WORDS)

# The reference's review-cleaning word list.
CLEAN_WORDS = ["电视", "小米", "不错", "安装"]

_COUNTS_SQL = f"""
  d AS (SELECT doc_id, regexp_extract_all(lower(text), '{W}') AS w FROM documents),
  t AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS doc_n, unnest(w) AS word FROM d),
  c AS (SELECT doc_id, word, doc_n, count(*) AS n FROM t GROUP BY ALL),
  dfc AS (SELECT word, count(*) AS dfc FROM c GROUP BY word),
  nd AS (SELECT count(DISTINCT doc_id) AS nd FROM c),
  s AS (SELECT c.doc_id, c.word, c.n, (c.n / c.doc_n) * ln(nd.nd / dfc.dfc) AS tf_idf
        FROM c JOIN dfc USING (word) CROSS JOIN nd)"""


def _tfidf(spark, sf_dir):
    docs = FX.table(spark, sf_dir, "documents")
    counts = T.doc_term_counts_from_text(docs, "doc_id", "text")
    return T.tf_idf(counts, "doc_id", "word", "n", doc_total_col="doc_n",
                    n_docs=T.docs_with_tokens(docs, "text"))


@query("best_terms", f"""WITH {_COUNTS_SQL},
  r AS (SELECT *, rank() OVER (PARTITION BY doc_id ORDER BY tf_idf DESC) AS rk FROM s
        WHERE word NOT IN ({STOP_SQL}))
SELECT word, round(max(tf_idf), 6) AS tf_idf FROM r WHERE rk <= 10 GROUP BY word
ORDER BY max(tf_idf) DESC, word LIMIT 100""")
def best_terms(spark, sf_dir):
    """Minimum slice: tokens -> counts -> TF-IDF -> stop words -> top 10 per
    document (ties kept) -> best score per word -> 100 best words."""
    scored = T.drop_terms(_tfidf(spark, sf_dir), FX.STOP_WORDS)
    top = T.top_terms(scored, "doc_id", "tf_idf", 10)
    best = T.best_terms(top, "word", "tf_idf", 100)
    return best.select("word", F.round("tf_idf", 6).alias("tf_idf"))


@query("tf_idf_top_per_doc", f"""WITH {_COUNTS_SQL},
  r AS (SELECT *, rank() OVER (PARTITION BY doc_id ORDER BY tf_idf DESC) AS rk FROM s)
SELECT doc_id, word, n, round(tf_idf, 6) AS tf_idf FROM r WHERE rk <= 10""")
def tf_idf_top_per_doc(spark, sf_dir):
    top = T.top_terms(_tfidf(spark, sf_dir), "doc_id", "tf_idf", 10)
    return top.select("doc_id", "word", "n", F.round("tf_idf", 6).alias("tf_idf"))


@query("term_frequency", f"""SELECT word, count(*) AS frequency FROM
  (SELECT unnest(regexp_extract_all(lower(text), '{W}')) AS word FROM documents)
WHERE word NOT IN ({STOP_SQL}) AND word <> 'NA' GROUP BY word""")
def term_frequency(spark, sf_dir):
    toks = T.tokenize(FX.table(spark, sf_dir, "documents"), "doc_id", "text")
    return T.term_frequency(T.drop_terms(toks, FX.STOP_WORDS))


@query("term_frequency_top100", f"""SELECT word, count(*) AS frequency FROM
  (SELECT unnest(regexp_extract_all(lower(text), '{W}')) AS word FROM documents)
WHERE word NOT IN ({STOP_SQL}) AND word <> 'NA' GROUP BY word ORDER BY frequency DESC, word LIMIT 100""")
def term_frequency_top100(spark, sf_dir):
    """The word-cloud input: the 100 most frequent words (a top-k report)."""
    toks = T.tokenize(FX.table(spark, sf_dir, "documents"), "doc_id", "text")
    return T.term_frequency(T.drop_terms(toks, FX.STOP_WORDS), n=100)


_POS_SQL = f"""SELECT id, word, CAST(index_word AS BIGINT) AS index_word FROM (
  SELECT id, unnest(w) AS word, generate_subscripts(w, 1) AS index_word FROM (
    SELECT id, regexp_extract_all(lower(text), '{W}') AS w FROM {FX.SQL['conv_docs']}))"""


@query("token_positions", _POS_SQL)
def token_positions(spark, sf_dir):
    return T.token_positions(FX.conversation_docs(spark, sf_dir), "id", "text")


def _tagged(spark, sf_dir):
    toks = T.tokenize(FX.conversation_docs(spark, sf_dir), "id", "text", positions=True)
    return T.tag_words(toks, FX.lexicon(spark, sf_dir)).select("id", "word", "nature", "index_word")


_TAG_SQL = f"""SELECT p.id, p.word, l.nature, p.index_word FROM ({_POS_SQL}) p
  LEFT JOIN {FX.SQL['lexicon']} l USING (word)"""


@query("tag_words", _TAG_SQL)
def tag_words(spark, sf_dir):
    return _tagged(spark, sf_dir)


@query("token_frequency_merge", f"""WITH tk AS ({_TAG_SQL}),
  fq AS (SELECT word, count(*) AS frequency FROM tk GROUP BY word)
SELECT coalesce(tk.word, fq.word) AS word, id, nature, index_word, frequency
FROM tk FULL OUTER JOIN fq ON tk.word = fq.word""")
def token_frequency_merge(spark, sf_dir):
    return T.with_frequency(_tagged(spark, sf_dir), "word", order_col="id") \
            .select("word", "id", "nature", "index_word", "frequency")


_CLEAN_SQL = ("regexp_replace(regexp_replace(" +
              "".join("regexp_replace(" for _ in CLEAN_WORDS) +
              "regexp_replace(text, '[a-zA-Z0-9]', '', 'g')" +
              "".join(f", '{w}', '', 'g')" for w in CLEAN_WORDS) +
              ", '[&|;]', '', 'g'), '\\\\', '', 'g')")


@query("clean_reviews", f"SELECT doc_id, {_CLEAN_SQL} AS cleaned FROM documents")
def clean_reviews(spark, sf_dir):
    docs = spread(FX.table(spark, sf_dir, "documents"))
    return docs.select("doc_id", clean_text("text", CLEAN_WORDS, strip_ascii=True).alias("cleaned"))


# Latin stand-in for the ideograph run class (the tables hold no CJK text).
LATIN_RUN = "[a-zà-ÿ,:]+"


@query("script_runs", f"""SELECT doc_id, array_to_string(regexp_extract_all(text, '{LATIN_RUN}'), ' ') AS runs
FROM documents""")
def script_runs(spark, sf_dir):
    docs = spread(FX.table(spark, sf_dir, "documents"))
    return docs.select("doc_id", char_runs("text", LATIN_RUN, " ").alias("runs"))


PARAGRAPH = "<p[^>]*>(.*?)</p>"


@query("extract_bodies", f"""SELECT DISTINCT page_id, m AS body FROM
  (SELECT page_id, unnest(regexp_extract_all(html, '{PARAGRAPH}', 1)) AS m FROM pages)""")
def extract_bodies(spark, sf_dir):
    pages = FX.table(spark, sf_dir, "pages")
    return T.extract_matches(pages, "page_id", "html", PARAGRAPH, 1, out_col="body")


@query("extract_reviews", f"""SELECT DISTINCT sku, array_to_string(regexp_extract_all(m, '{LATIN_RUN}'), ' ') AS comments FROM
  (SELECT sku, unnest(regexp_extract_all(body, '{T.REVIEW_BODY.replace("'", "''")}')) AS m
   FROM {FX.SQL['qa_bodies']})""")
def extract_reviews(spark, sf_dir):
    """X3 review-body pattern over the Q&A bodies, reduced to its runs (of
    Latin letters: the tables hold no ideographs)."""
    return T.extract_reviews(FX.qa_bodies(spark, sf_dir), "sku", "body", run_pattern=LATIN_RUN)


@query("extract_tags", f"""SELECT sku, CAST(pos - 1 AS BIGINT) AS tag_pos,
  replace(split_part(split_part(m, ':', 3), ',', 1), '"', '') AS name,
  CAST(replace(split_part(m, ':', 4), '"', '') AS BIGINT) AS count
FROM (SELECT sku, unnest(ms) AS m, generate_subscripts(ms, 1) AS pos FROM
  (SELECT sku, regexp_extract_all(body, '{T.TAG_ITEM}') AS ms FROM {FX.SQL['tag_bodies']}))""")
def extract_tags(spark, sf_dir):
    return T.extract_tags(FX.tag_bodies(spark, sf_dir), "sku", "body")


@query("extract_tag_summary", f"""SELECT sku, split_part(a, ':', 2) AS averagescore,
  split_part(c, ':', 2) AS commentCount, labelID FROM (
  SELECT sku, regexp_extract(body, '{T.AVERAGE_SCORE}') AS a, regexp_extract(body, '{T.COMMENT_COUNT}') AS c,
    array_to_string(list_transform(regexp_extract_all(body, '{T.TAG_ITEM}'),
      lambda m: replace(split_part(split_part(m, ':', 3), ',', 1) || ':' || split_part(m, ':', 4) || ' ', '"', '')), '')
      AS labelID
  FROM {FX.SQL['tag_bodies']}) WHERE a <> '' AND c <> ''""")
def extract_tag_summary(spark, sf_dir):
    return T.extract_tag_summary(FX.tag_bodies(spark, sf_dir), "sku", "body")


@query("extract_qa", f"""WITH b AS (
  SELECT sku, regexp_extract_all(body, '{T.QA_DATES}') AS dates, unnest(bl) AS blk,
         generate_subscripts(bl, 1) - 1 AS block
  FROM (SELECT sku, body, regexp_extract_all(body, '{T.QA_BLOCK}') AS bl FROM {FX.SQL['qa_bodies']})),
 p AS (SELECT sku, block, dates, regexp_extract(blk, '{T.QA_ASK}') AS ask,
         regexp_extract_all(regexp_extract(blk, '{T.QA_REPLY}'), '{T.QA_CONTENT}') AS rc FROM b)
SELECT sku, CAST(block AS BIGINT) AS block,
  replace(split_part(regexp_extract(ask, '{T.QA_CONTENT}'), ':', 2), '"', '') AS ask_content,
  strptime(split_part(regexp_extract(ask, '"lastAnswerTime":".*?"'), '"', 4), '%Y-%m-%d %H:%M:%S') AS lastAnswerTime,
  replace(split_part(rc[2], ':', 2), '"', '') AS reply_content,
  strptime(replace(replace(split_part(dates[block + 1], ',', 1), '"created":', ''), '"', ''), '%Y-%m-%d %H:%M:%S')
    AS replycreatedTime,
  strptime(replace(replace(split_part(dates[block + 1], ',', 2), '"modified":', ''), '"', ''), '%Y-%m-%d %H:%M:%S')
    AS replymodifiedTime
FROM p WHERE ask <> '' AND len(rc) >= 2 AND len(dates) > block""")
def extract_qa(spark, sf_dir):
    return T.extract_qa(FX.qa_bodies(spark, sf_dir), "sku", "body")


@query("distinct_reviews", "SELECT DISTINCT source, text FROM documents")
def distinct_reviews(spark, sf_dir):
    return T.distinct_reviews(FX.table(spark, sf_dir, "documents").select("source", "text"))


@query("doc_term_matrix", f"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{W}')) AS word
  FROM documents), c AS (SELECT doc_id, word, count(*) AS n FROM t GROUP BY ALL),
  k AS (SELECT word FROM c GROUP BY word HAVING count(*) >= 5)
SELECT doc_id, word, n FROM c SEMI JOIN k USING (word)""")
def doc_term_matrix(spark, sf_dir):
    from shoppulse.operators.topics import doc_term_matrix as dtm
    toks = T.tokenize(FX.table(spark, sf_dir, "documents"), "doc_id", "text")
    return dtm(toks, "doc_id", "word", min_df=5)


@query("terms_outside_lexicon", f"""SELECT word, count(*) AS frequency FROM
  (SELECT unnest(regexp_extract_all(lower(text), '{W}')) AS word FROM documents)
WHERE word NOT IN (SELECT word FROM {FX.SQL['lexicon']}) GROUP BY word""")
def terms_outside_lexicon(spark, sf_dir):
    """F15/J5: the lexicon as a stop table, an anti join on the aggregated terms."""
    toks = T.tokenize(FX.table(spark, sf_dir, "documents"), "doc_id", "text")
    counts = toks.groupBy("word").agg(F.count(F.lit(1)).alias("frequency"))
    return T.drop_terms(counts, FX.lexicon(spark, sf_dir).select("word"))


@query("topic_share_fixed", f"""WITH t AS (SELECT word AS term, length(word) % 3 + 1 AS topic FROM {FX.SQL['lexicon']}),
 f AS (SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '{W}')) AS word FROM documents) GROUP BY word),
 p AS (SELECT topic, coalesce(sum(n), 0)::BIGINT AS freq FROM t LEFT JOIN f ON word = term GROUP BY topic),
 s AS (SELECT *, freq / sum(freq) OVER () AS share FROM p)
SELECT topic::INT AS topic, freq, round(share, 6) AS share,
  'topic:' || topic || '(' || regexp_replace(round(share * 100, 2)::VARCHAR, '\\.0$', '') || '%)' AS label FROM s""")
def topic_share_fixed(spark, sf_dir):
    """A17/J3/X14 on given topics: lexicon words by their length."""
    from shoppulse.operators.topics import topic_share
    terms = FX.lexicon(spark, sf_dir).select(F.col("word").alias("term"), (F.length("word") % 3 + 1).alias("topic"))
    toks = T.tokenize(FX.table(spark, sf_dir, "documents"), "doc_id", "text")
    out = topic_share(terms, toks.groupBy("word").agg(F.count(F.lit(1)).alias("frequency")))
    return out.withColumn("share", F.round("share", 6))
