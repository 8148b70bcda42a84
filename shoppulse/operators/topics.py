"""Document-term matrix, topic models (LDA), topic separation and
topic share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoppulse.operators import packed_counts
from shoppulse.operators.layout import with_row_index
from shoppulse.operators.packed_counts import PackedCounts
from shoppulse.operators.topic_em import fit_em
from shoppulse.session import frugal, written


def doc_term_matrix(tokens: DataFrame | PackedCounts, doc_col: str, term_col: str = "word", min_df: int = 5,
                    drop_digits: bool = True) -> DataFrame | PackedCounts:
    """Long document-term matrix ``(doc, term, n)`` keeping terms present in at
    least ``min_df`` documents (tokens of length >= 1, digit tokens removed).

    The matrix of packed counts (:func:`shoppulse.operators.packed_counts.pack`)
    is packed as well: the same chunks with the kept terms."""
    packed = isinstance(tokens, PackedCounts)
    toks = (tokens.terms if packed else tokens).filter(F.length(term_col) >= 1)
    if drop_digits:
        toks = toks.filter(~F.col(term_col).rlike("^[0-9]+$"))
    if packed:
        return tokens._replace(terms=toks.filter(F.col("df") >= min_df))
    counts = toks.groupBy(doc_col, term_col).agg(F.count(F.lit(1)).alias("n"))
    # document frequency read off the counts (count_if(n > 0) uses the count
    # column, so this branch's token aggregation stays identical to the main
    # one: its shuffle is reused and the text is tokenised once)
    keep = counts.groupBy(term_col).agg(F.count_if(F.col("n") > 0).alias("_df")).filter(F.col("_df") >= min_df)
    # inner join with the (unique) kept terms rather than a semi join: the
    # optimizer pushes a semi join below the count aggregation, which would
    # shuffle raw tokens by term (a hot term's tokens into one task, with no
    # map-side combine); the inner join keeps the counts aggregated first
    return counts.join(keep.select(term_col), on=term_col, how="inner").select(doc_col, term_col, "n")


def term_index(counts: DataFrame, term_col: str = "word", n_col: str = "n") -> DataFrame:
    """``(term, term_index)``: the distinct terms of a long count table
    numbered 0, 1, .. in term order, inside Spark (one range-partitioned,
    written table; no vocabulary on the driver)."""
    terms = counts.filter(F.col(n_col) > 0).groupBy(F.col(term_col).alias("term")).agg(F.count(F.lit(1)).alias("_df"))
    return written(with_row_index(terms.select("term"), "term", "term_index"))


def count_vectors(counts: DataFrame | PackedCounts, doc_col: str, term_col: str = "word", n_col: str = "n"):
    """Sparse count vectors per document from a long count table
    ``(doc, term, n)`` with unique (doc, term), or a packed one, such as
    :func:`doc_term_matrix`.  Returns ``(vectors DataFrame(doc, tf),
    vocabulary DataFrame(term, term_index))``.

    The terms are numbered in Spark and joined to the counts; a document's row
    is bounded by its own distinct terms.  The vectors are written once in the
    stored form of Spark ML's sparse vectors and read back as such, so every
    pass of an iterative fit is a plain scan."""
    from pyspark.ml.linalg import VectorUDT
    from pyspark.sql.types import StructField, StructType
    if isinstance(counts, PackedCounts):
        with frugal(counts.terms.sparkSession):
            terms = counts.terms.select("bucket", F.col(term_col).alias("term"))
            numbered = written(with_row_index(terms, "term", "term_index"))
            size = numbered.count()
            rows = packed_counts.vectors(counts, numbered, size, doc_col)
            return written(rows, StructType([rows.schema[doc_col], StructField("tf", VectorUDT())])), numbered.select("term", "term_index")
    vocab = term_index(counts, term_col, n_col)
    size = vocab.count()
    entry = F.struct(F.col("term_index").cast("int").alias("i"), F.col(n_col).cast("double").alias("v"))
    rows = (counts.join(vocab, F.col(term_col) == F.col("term"))
            .groupBy(doc_col).agg(F.sort_array(F.collect_list(entry)).alias("e")))
    stored = F.struct(F.lit(0).cast("tinyint").alias("type"), F.lit(size).alias("size"),  # type 0: sparse
                      F.col("e.i").alias("indices"), F.col("e.v").alias("values"))
    schema = StructType([rows.schema[doc_col], StructField("tf", VectorUDT())])
    return written(rows.select(doc_col, stored.alias("tf")), schema), vocab


def fit_topics(vectors: DataFrame, k: int, seed: int = 0, max_iter: int = 10, optimizer: str = "em"):
    """LDA (``k >= 2``) over every document in each iteration.

    The default ``em`` gives what Spark ML's EM optimiser gives, from its random
    start, by blocks of documents (:func:`shoppulse.operators.topic_em.fit_em`):
    topic counts of terms and documents stay on the executors, so neither memory
    nor traffic of the driver grows with the vocabulary.  ``online`` is Spark's
    variational optimiser (rate 1: all documents), whose term x topic matrix
    does pass through the driver; use it for small vocabularies."""
    from pyspark.ml.clustering import LDA
    if k < 2:
        raise ValueError("k must be >= 2")
    if optimizer == "em":
        return fit_em(vectors, [k], seed, max_iter)[k]
    return LDA(k=k, seed=seed, maxIter=max_iter, optimizer=optimizer, featuresCol="tf").setSubsamplingRate(1.0).fit(vectors)


def topic_terms(lda_model, vocab: DataFrame, n: int = 200) -> DataFrame:
    """``(topic, rank, term, weight)``: the n heaviest terms of each topic
    (topics and ranks 1-based); ``vocab(term, term_index)`` stays in Spark."""
    t = lda_model.describeTopics(n)
    ex = t.select("topic", F.posexplode(F.arrays_zip("termIndices", "termWeights")).alias("pos", "tw"))
    ex = ex.select((F.col("topic") + 1).alias("topic"), (F.col("pos") + 1).alias("rank"),
                   F.col("tw.termIndices").alias("term_index"), F.col("tw.termWeights").alias("weight"))
    return ex.join(vocab, "term_index").drop("term_index")


def topic_overlap(terms: DataFrame, k: int, n: int) -> DataFrame:
    """Mean pairwise cosine between topics' top-n term-incidence rows:
    ``cosine(a, b) = |A & B| / n``.  The topic x term incidence is one
    ``groupBy(term)`` with a 0/1 column per topic and the pair overlaps are
    sums of products in one aggregation (k <= a few dozen topics)."""
    from itertools import combinations
    inc = terms.groupBy("term").agg(*[F.max((F.col("topic") == t).cast("int")).alias(f"t{t}")
                                      for t in range(1, k + 1)])
    pairs = list(combinations(range(1, k + 1), 2))
    row = inc.agg(*[F.sum(F.col(f"t{a}") * F.col(f"t{b}")).alias(f"o{a}_{b}") for a, b in pairs])
    mean = sum((F.col(f"o{a}_{b}") / F.lit(float(n)) for a, b in pairs), F.lit(0.0)) / F.lit(float(len(pairs)))
    return row.select(F.lit(k).alias("k"), mean.alias("mean_cosine"))


def topic_separation(vectors: DataFrame, vocab: DataFrame, ks=range(2, 11), n: int = 50, seed: int = 0,
                     max_iter: int = 10) -> DataFrame:
    """``(k, mean_cosine)`` for each k; k = 1 is 1 by definition (not
    fitted).  Lower means better separated topics.  The fits share their
    passes over the documents."""
    spark = vectors.sparkSession
    out = spark.createDataFrame([(1, 1.0)], "k int, mean_cosine double")
    ks = [k for k in ks if k >= 2]
    models = fit_em(vectors, ks, seed, max_iter) if ks else {}
    for k in ks:
        out = out.unionByName(topic_overlap(topic_terms(models[k], vocab, n), k, n))
    return out


def topic_share(terms: DataFrame, freq: DataFrame, term_col: str = "word", freq_col: str = "frequency") -> DataFrame:
    """Corpus frequency summed over each topic's terms, as a share of the
    total: ``(topic, freq, share, label)`` with label ``topic:i(pp.pp%)``."""
    from shoppulse.functions.numeric import share_label
    j = terms.join(freq.select(F.col(term_col).alias("term"), F.col(freq_col).alias("_f")), "term", "left")
    per = j.groupBy("topic").agg(F.coalesce(F.sum("_f"), F.lit(0)).alias("freq"))
    tot = per.agg(F.sum("freq").alias("_tot"))  # one row (k topics)
    out = per.crossJoin(F.broadcast(tot)).withColumn("share", F.try_divide(F.col("freq"), F.col("_tot")))
    return out.select("topic", "freq", "share", share_label("topic", F.col("share") * 100).alias("label"))
