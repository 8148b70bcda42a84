"""Text-mining operators: extraction, tokens, term frequency, TF-IDF.

Scale notes
-----------
* Tokens are produced by a narrow ``explode`` of a JVM regex result; no UDF.
* Every count is a ``groupBy`` so Spark aggregates partially before the
  shuffle: a word present in every document (or a document holding a third of
  all tokens) reaches the exchange as one partial row per map task.
* Per-document totals come from ``size(words)`` on the document row itself,
  so TF needs no second pass or join over the documents.
* Per-term document frequency is joined back as an aggregate: broadcast for the
  frequent terms, which have most of the counts, and shuffled for the others.
* Top-n per document uses ``rank() <= n``; Spark plans it with a partial
  ``WindowGroupLimit`` before the shuffle, so a hot document sends only its
  local top-n rows.
"""

from __future__ import annotations

from typing import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoppulse.functions.text import WORD_PATTERN, words as word_array, char_runs
from shoppulse.session import broadcast_if_small, spread

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's for equal results).
# Review body inside a raw comment response.  The bracket after the comma is a
# character class (one of  " v c o n t e | i d ), not an alternation.
REVIEW_BODY = '"content":".*?",["vcontent"|"id"]'
# Comment tags: one match per tag, plus the score and count summary fields.
TAG_ITEM = '"id":.*?,"name":.*?,"count":[0-9]+'
AVERAGE_SCORE = '"averageScore":[0-9]'
COMMENT_COUNT = '"commentCount":[0-9]+'
# Question/answer blocks and their parts.
TS = "[0-9]+-[0-9]+-[0-9]+ [0-9]+:[0-9]+:[0-9]+"
QA_DATES = f'"created":"{TS}","modified":"{TS}"'
QA_BLOCK = f'"content":".*?".*?"created":"{TS}","modified":"{TS}"'
QA_ASK = f'"content":".*?","clientType":.*?,"productId":.*?,"status":.*?,"lastAnswerTime":"{TS}"'
QA_REPLY = '"content":".*?","systemId"'
QA_CONTENT = '"content":".*?"'
# ---------------------------------------------------------------------------

#: Share of the documents from which on a term's document frequency is broadcast.
FREQUENT = 1e-3


def _arr(pattern: str) -> Column:
    return F.lit(pattern)


# ----------------------------------------------------------------- tokens ---

def tokenize(df: DataFrame, id_col: str, text_col: str, pattern: str = WORD_PATTERN,
             stopwords: Iterable[str] | None = None, positions: bool = False,
             word_col: str = "word", lists: bool = False) -> DataFrame:
    """One row per token: ``(id, word)``, or ``(id, word, index_word)`` with a
    1-based position inside the document when ``positions`` is set (W1), or
    one row per text with its tokens as a list when ``lists`` is set.

    ``stopwords`` drops tokens before they are emitted (the segmenter's stop
    list).  Positions count the kept tokens, as the segmenter numbers them."""
    arr = word_array(text_col, pattern)
    if stopwords:
        stop = F.array(*[F.lit(w) for w in sorted(set(stopwords))])
        arr = F.filter(arr, lambda w: ~F.array_contains(stop, w))
    base = spread(df).select(F.col(id_col), arr.alias("_w"))
    if lists:
        return base.withColumnRenamed("_w", word_col)
    # explode_outer + null filter: a plain explode makes the optimizer infer
    # ``size(regex result) > 0`` below the projection, evaluating the regex
    # twice per document
    if positions:
        return base.select(id_col, F.posexplode_outer("_w").alias("_p", word_col)) \
                   .filter(F.col(word_col).isNotNull()) \
                   .select(id_col, word_col, (F.col("_p") + 1).cast("bigint").alias("index_word"))
    return base.select(id_col, F.explode_outer("_w").alias(word_col)).filter(F.col(word_col).isNotNull())


def token_positions(df: DataFrame, id_col: str, text_col: str, pattern: str = WORD_PATTERN,
                    stopwords: Iterable[str] | None = None) -> DataFrame:
    """``(id, word, index_word)``: tokens with their 1-based position."""
    return tokenize(df, id_col, text_col, pattern, stopwords, positions=True)


def tag_words(tokens: DataFrame, lexicon: DataFrame, word_col: str = "word",
              nature_col: str = "nature", max_broadcast_rows: int = 2_000_000) -> DataFrame:
    """Attach a part-of-speech-like tag from a lexicon ``(word, nature)``;
    words missing from the lexicon get null.  The lexicon is broadcast only
    after a bounded row count proves it small."""
    lex = lexicon.select(word_col, nature_col).dropDuplicates([word_col])
    return tokens.join(broadcast_if_small(lex, max_broadcast_rows), on=word_col, how="left")


def term_frequency(tokens: DataFrame, n: int | None = None, word_col: str = "word",
                   freq_col: str = "frequency", n_col: str | None = None) -> DataFrame:
    """``(word, frequency)`` sorted by frequency descending then word; top-n
    when ``n`` is given (a top-k report).  Rows that stand for several tokens
    have their number in ``n_col``."""
    out = tokens.groupBy(word_col).agg((F.sum(n_col) if n_col else F.count(F.lit(1))).alias(freq_col))
    out = out.orderBy(F.col(freq_col).desc(), F.col(word_col))
    return out.limit(n) if n else out


def doc_term_counts(tokens: DataFrame, id_col: str, word_col: str = "word",
                    n_col: str = "n") -> DataFrame:
    """Count per (document, word)."""
    return tokens.groupBy(id_col, word_col).agg(F.count(F.lit(1)).alias(n_col))


def doc_term_counts_from_text(df: DataFrame, id_col: str, text_col: str,
                              pattern: str = WORD_PATTERN) -> DataFrame:
    """``(id, word, n, doc_n)`` straight from the text: ``doc_n`` (tokens in
    the document) is ``size`` of the word array, carried through the explode,
    so TF needs no per-document aggregate or join.  The word arrays are dealt
    by document id, so the counts need no exchange of their own, and what
    ranks them per document finds them together."""
    arr = word_array(text_col, pattern)
    return (spread(df).select(F.col(id_col), arr.alias("_w")).repartition(id_col)
              .select(id_col, F.size("_w").cast("bigint").alias("doc_n"), F.explode_outer("_w").alias("word"))
              .filter(F.col("word").isNotNull())
              .groupBy(id_col, "word", "doc_n").agg(F.count(F.lit(1)).alias("n")))


def docs_with_tokens(df: DataFrame, text_col: str, pattern: str = WORD_PATTERN) -> DataFrame:
    """One-row ``_N``: documents holding at least one token.  A ``rlike``
    stops at the first match, so this pass is far cheaper than re-running
    the tokenizer in a second branch of the plan."""
    return df.filter(F.lower(F.col(text_col)).rlike(pattern)).agg(F.count(F.lit(1)).alias("_N"))


def tf_idf(counts: DataFrame, doc_col: str, term_col: str = "word", n_col: str = "n",
           doc_total_col: str | None = None, n_docs: DataFrame | None = None) -> DataFrame:
    """TF-IDF as tidy text defines it: ``tf = n / sum(n) per document``,
    ``idf = ln(N_docs / documents containing the term)`` (natural log, no
    smoothing), ``tf_idf = tf * idf``.

    ``n_docs`` is an optional one-row DataFrame with the document count
    ``_N`` (see :func:`docs_with_tokens`); by default it is counted here.
    ``doc_total_col`` names a precomputed per-document token total (see
    :func:`doc_term_counts_from_text`); otherwise it is aggregated here.

    Terms in at least a ``FREQUENT`` share of the documents are looked up in a
    broadcast table: at most the mean number of terms of a document divided by
    that share.  They make up most of the counts, which so stay where they are;
    only the counts of the other terms are shuffled to their document frequency.
    """
    if doc_total_col is None:
        totals = counts.groupBy(doc_col).agg(F.sum(n_col).alias("_doc_n"))
        counts = counts.join(totals, on=doc_col)
        doc_total_col = "_doc_n"
    # count_if(n > 0) (not count(*)) uses the count column, so the optimizer
    # keeps this branch's counts aggregation identical to the main one: the
    # exchange under it is reused and the tokens are produced once
    term_docs = counts.groupBy(term_col).agg(F.count_if(F.col(n_col) > 0).alias("_df"))
    n_docs_col = n_docs if n_docs is not None else counts.agg(F.countDistinct(doc_col).alias("_N"))
    term_docs = term_docs.crossJoin(F.broadcast(n_docs_col))  # one row by construction
    frequent = term_docs.filter(F.col("_df") >= F.col("_N") * FREQUENT)
    # the anti join is done before the counting: only tokens of the other terms are counted again
    rest = counts.join(F.broadcast(frequent.select(term_col)), on=term_col, how="left_anti")
    out = (counts.join(F.broadcast(frequent), on=term_col).unionByName(rest.join(term_docs, on=term_col))
           .withColumn("tf", F.col(n_col) / F.col(doc_total_col))
           .withColumn("idf", F.log(F.col("_N") / F.col("_df")))
           .withColumn("tf_idf", F.col("tf") * F.col("idf")))
    return out.drop("_df", "_N", "_doc_n")


def top_terms(scored: DataFrame, doc_col: str, score_col: str = "tf_idf", n: int = 10) -> DataFrame:
    """Top-n rows per document by score, ties at the cut kept (``rank``)."""
    w = Window.partitionBy(doc_col).orderBy(F.col(score_col).desc())
    return scored.withColumn("_rk", F.rank().over(w)).filter(F.col("_rk") <= n).drop("_rk")


def best_terms(scored: DataFrame, term_col: str = "word", score_col: str = "tf_idf",
               n: int | None = 100) -> DataFrame:
    """Highest score per term (first row per term after a descending sort),
    then the n best terms.  Ties broken by term for a total order."""
    out = scored.groupBy(term_col).agg(F.max(score_col).alias(score_col))
    out = out.orderBy(F.col(score_col).desc(), F.col(term_col))
    return out.limit(n) if n else out


def drop_terms(df: DataFrame, words: Iterable[str] | DataFrame, col: str = "word",
               drop_na: bool = True, max_list: int = 10_000) -> DataFrame:
    """Remove rows whose term is a stop word (and null / literal ``"NA"``).

    A literal list becomes ``NOT IN`` (pushed into the scan side's filter);
    a DataFrame of words, or a very long list, becomes a ``left_anti`` join
    whose small side is broadcast only after a bounded count.  Either way null
    terms go only with ``drop_na``."""
    out = df
    if drop_na:
        out = out.filter(F.col(col).isNotNull() & (F.col(col) != F.lit("NA")))
    if isinstance(words, DataFrame):
        stop = words.select(F.col(words.columns[0]).alias(col)).distinct()
        return out.join(broadcast_if_small(stop), on=col, how="left_anti")
    words = list(dict.fromkeys(words))
    if len(words) > max_list:
        stop = out.sparkSession.createDataFrame([(w,) for w in words], [col])
        return out.join(broadcast_if_small(stop), on=col, how="left_anti")
    return out.filter(F.col(col).isNull() | ~F.col(col).isin(words)) if words else out


def join_frequency(tokens: DataFrame, freq: DataFrame, word_col: str = "word",
                   order_col: str | None = "id") -> DataFrame:
    """Full outer join of tokens with the term-frequency table on ``word``,
    ordered by document id when ``order_col`` is given.

    Written as a left join plus the frequency rows no token matches: AQE can
    split a hot word's partition in a left join (not in a full outer one),
    and the unmatched side is an anti join against the distinct words."""
    matched = tokens.join(freq, on=word_col, how="left")
    words = tokens.select(word_col).distinct()
    unmatched = freq.join(words, on=word_col, how="left_anti")
    out = matched.unionByName(unmatched, allowMissingColumns=True)
    return out.orderBy(order_col) if order_col else out


def with_frequency(tokens: DataFrame, word_col: str = "word", order_col: str | None = "id",
                   freq_col: str = "frequency", blocks: int = 1 << 16) -> DataFrame:
    """Tokens beside how often their word occurs among them: what
    :func:`join_frequency` gives for the tokens' own frequency table, from one
    pass over the tokens.

    Tokens are gathered by word and a hash of their other columns (``blocks``
    values) into lists, whose sizes add up to the frequency and which are
    unfolded beside it.  A word of f tokens has lists of about f / ``blocks``
    rows, so a hot word is spread over all tasks, and the join of lists and
    sums is by a table of one row per word, which AQE broadcasts if it is
    small, and splits a hot word's lists otherwise.  Null words are kept, with
    a null frequency."""
    rest = [c for c in tokens.columns if c != word_col]
    block = F.pmod(F.xxhash64(*rest), F.lit(blocks)).alias("_block")
    lists = tokens.groupBy(word_col, block).agg(F.collect_list(F.struct(*rest)).alias("_rows"))
    # the sizes of the lists themselves, so that both branches share one exchange
    sums = lists.groupBy(word_col).agg(F.sum(F.size("_rows")).alias(freq_col))
    out = lists.join(sums, on=word_col, how="left").select(word_col, F.inline("_rows"), freq_col)
    return out.orderBy(order_col) if order_col else out


def distinct_reviews(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Distinct review rows (on ``cols`` when given)."""
    return df.dropDuplicates(list(cols)) if cols else df.distinct()


# ------------------------------------------------------------- extraction ---

def extract_reviews(df: DataFrame, id_col: str, body_col: str, pattern: str = REVIEW_BODY,
                    run_pattern: str | None = "[一-龥，：]+", distinct: bool = True) -> DataFrame:
    """Review texts out of raw response bodies: every ``pattern`` match,
    reduced to its ``run_pattern`` runs joined by a space (or the raw match
    when ``run_pattern`` is None), de-duplicated per body id."""
    m = spread(df).select(F.col(id_col), F.explode(
        F.regexp_extract_all(F.col(body_col), _arr(pattern), F.lit(0))).alias("_m"))
    text = char_runs("_m", run_pattern) if run_pattern else F.col("_m")
    out = m.select(id_col, text.alias("comments"))
    return out.distinct() if distinct else out


def extract_matches(df: DataFrame, id_col: str, body_col: str, pattern: str, group: int = 1,
                    out_col: str = "match", distinct: bool = True) -> DataFrame:
    """Capture group ``group`` of every ``pattern`` match (e.g. paragraph
    bodies of a web page), one row per match."""
    out = spread(df).select(F.col(id_col), F.explode(
        F.regexp_extract_all(F.col(body_col), _arr(pattern), F.lit(group))).alias(out_col))
    return out.distinct() if distinct else out


def _field(col: Column, key: str) -> Column:
    # text between  "<key>":  and the next comma (the reference splits on ':'/',')
    return F.regexp_extract(col, f'"{key}":"?([^,"]*)', 1)


def extract_tags(df: DataFrame, id_col: str, body_col: str) -> DataFrame:
    """``(id, name, count)`` per comment tag in the body.  ``name`` is the text
    after the second ``:`` up to the next comma, quotes removed; ``count`` the
    digits after the third ``:``, null if that is no number (a name that holds a
    ``:`` itself shifts the fields)."""
    m = spread(df).select(F.col(id_col), F.posexplode(
        F.regexp_extract_all(F.col(body_col), _arr(TAG_ITEM), F.lit(0))).alias("tag_pos", "_m"))
    parts = F.split(F.col("_m"), ":")
    name = F.regexp_replace(F.split(parts.getItem(2), ",").getItem(0), '"', "")
    cnt = F.regexp_replace(parts.getItem(3), '"', "")
    return m.select(id_col, F.col("tag_pos").cast("bigint").alias("tag_pos"),
                    name.alias("name"), cnt.try_cast("bigint").alias("count"))


def extract_tag_summary(df: DataFrame, id_col: str, body_col: str) -> DataFrame:
    """``(id, averagescore, commentCount, labelID)``; ``labelID`` packs
    ``name:count `` for every tag in body order (trailing space included).
    Bodies without a score or count field are skipped."""
    body = F.col(body_col)
    tags = F.regexp_extract_all(body, _arr(TAG_ITEM), F.lit(0))
    packed = F.transform(tags, lambda m: F.regexp_replace(
        F.concat(F.split(F.split(m, ":").getItem(2), ",").getItem(0), F.lit(":"),
                 F.split(m, ":").getItem(3), F.lit(" ")), '"', ""))
    out = spread(df).select(
        F.col(id_col),
        F.regexp_extract(body, f"({AVERAGE_SCORE})", 1).alias("_avg"),
        F.regexp_extract(body, f"({COMMENT_COUNT})", 1).alias("_cnt"),
        F.array_join(packed, "").alias("labelID"))
    return (out.filter((F.col("_avg") != "") & (F.col("_cnt") != ""))
               .select(id_col,
                       F.split("_avg", ":").getItem(1).alias("averagescore"),
                       F.split("_cnt", ":").getItem(1).alias("commentCount"),
                       "labelID"))


def extract_qa(df: DataFrame, id_col: str, body_col: str) -> DataFrame:
    """Question/answer pairs out of raw bodies:
    ``(id, block, ask_content, lastAnswerTime, reply_content, replycreatedTime,
    replymodifiedTime)``.

    Per block: the ask part must match, the reply part must hold a second
    ``"content"`` field, otherwise the block is skipped.  Contents are cut at
    their first ASCII colon.  Reply times are the block's position-matched
    created/modified pair of the whole body; a time that is no date (such as
    ``0000-00-00 00:00:00``) is null and its row stays."""
    body = F.col(body_col)
    blocks = spread(df).select(
        F.col(id_col),
        F.regexp_extract_all(body, _arr(QA_DATES), F.lit(0)).alias("_dates"),
        F.posexplode(F.regexp_extract_all(body, _arr(QA_BLOCK), F.lit(0))).alias("block", "_b"))
    ask = F.regexp_extract(F.col("_b"), QA_ASK, 0)
    reply = F.regexp_extract(F.col("_b"), QA_REPLY, 0)
    b = blocks.select(id_col, "block", "_dates", ask.alias("_ask"),
                      F.regexp_extract_all(reply, _arr(QA_CONTENT), F.lit(0)).alias("_rc"))
    b = b.filter((F.col("_ask") != "") & (F.size("_rc") >= 2)
                 & (F.size("_dates") > F.col("block")))
    first_colon_cut = lambda c: F.regexp_replace(F.split(c, ":").getItem(1), '"', "")
    ask_content = first_colon_cut(F.regexp_extract(F.col("_ask"), QA_CONTENT, 0))
    last_answer = F.split(F.regexp_extract(F.col("_ask"), '"lastAnswerTime":".*?"', 0), '"').getItem(3)
    reply_content = first_colon_cut(F.col("_rc").getItem(1))
    date_pair = F.split(F.element_at(F.col("_dates"), F.col("block") + 1), ",")
    created = F.regexp_replace(F.regexp_replace(date_pair.getItem(0), '"created":', ""), '"', "")
    modified = F.regexp_replace(F.regexp_replace(date_pair.getItem(1), '"modified":', ""), '"', "")
    fmt = "yyyy-MM-dd HH:mm:ss"
    return b.select(id_col, F.col("block").cast("bigint").alias("block"),
                    ask_content.alias("ask_content"),
                    F.try_to_timestamp(last_answer, F.lit(fmt)).alias("lastAnswerTime"),
                    reply_content.alias("reply_content"),
                    F.try_to_timestamp(created, F.lit(fmt)).alias("replycreatedTime"),
                    F.try_to_timestamp(modified, F.lit(fmt)).alias("replymodifiedTime"))
