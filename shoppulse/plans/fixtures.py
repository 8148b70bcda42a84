"""Inputs of the three chains, derived from the test tables with Spark.

Every fixture is a lazy DataFrame over the parquet scans, so its work grows
with the tables and Catalyst prunes the columns a query does not use.  The
matching DuckDB text is in :data:`SQL` (used by the oracle queries).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shoppulse.functions.text import WORD_PATTERN, words
from shoppulse.session import spread

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# ---------------------------------------------------------------- B. wide ---
BEHAVIOUR_FAMILIES = [  # (family prefix, event_type)
    ("pchs", "purchase"), ("clk", "click"), ("brs", "view"), ("cart", "signup"),
]
WIDE_COLUMNS = ["pchs_firstcate_n", "pchs_secondcate_n", "clk_firstcate_n", "clk_secondcate_n",
                "brs_firstcate_n", "brs_secondcate_n", "cart_firstcate_n", "cart_secondcate_n",
                "flw_secondcate_n", "attr_value_floor"]


def wide_behaviour(spark: SparkSession, sf_dir: str, with_const: bool = False,
                   with_extra: bool = False, with_nulls: bool = False) -> DataFrame:
    """One row per user of ``events``: conditional counts per behaviour family
    and category level, in a single aggregation pass (partial aggregation
    before the shuffle on ``user_id``)."""
    ev = table(spark, sf_dir, "events")
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    first, second = k < 50, k >= 50
    aggs = []
    for fam, et in BEHAVIOUR_FAMILIES:
        is_t = F.col("event_type") == et
        aggs.append(F.count_if(is_t & first).alias(f"{fam}_firstcate_n"))
        aggs.append(F.count_if(is_t & second).alias(f"{fam}_secondcate_n"))
    aggs.append(F.count_if(F.col("event_type") == "error").alias("flw_secondcate_n"))
    aggs.append(F.floor(F.max("value")).cast("bigint").alias("attr_value_floor"))
    w = ev.groupBy("user_id").agg(*aggs)
    cols = [F.col("user_id").cast("string").alias("user_pin")]
    for c in WIDE_COLUMNS:
        if c == "flw_secondcate_n" and with_nulls:
            cols.append(F.when(F.col("user_id") % 7 == 0, F.lit(None).cast("bigint"))
                        .otherwise(F.col(c)).alias(c))
        else:
            cols.append(F.col(c))
    if with_const:
        cols.append(F.lit(1).cast("bigint").alias("attr_const"))
    if with_extra:
        cols.append((F.col("pchs_firstcate_n") % 2).alias("extra_a"))
        cols.append(F.lit(0).cast("bigint").alias("extra_b"))
    return w.select(*cols)


def _wide_sql(with_const=False, with_extra=False, with_nulls=False) -> str:
    parts = []
    for fam, et in BEHAVIOUR_FAMILIES:
        for lvl, cond in (("firstcate", "k < 50"), ("secondcate", "k >= 50")):
            parts.append(f"count(*) FILTER (WHERE event_type = '{et}' AND {cond})"
                         f"::BIGINT AS {fam}_{lvl}_n")
    flw = "count(*) FILTER (WHERE event_type = 'error')::BIGINT"
    if with_nulls:
        flw = f"CASE WHEN user_id % 7 = 0 THEN NULL ELSE {flw} END"
    parts.append(f"{flw} AS flw_secondcate_n")
    parts.append("floor(max(value))::BIGINT AS attr_value_floor")
    extra = ""
    if with_const:
        extra += ", 1::BIGINT AS attr_const"
    if with_extra:
        extra += ", pchs_firstcate_n % 2 AS extra_a, 0::BIGINT AS extra_b"
    return (f"(SELECT user_pin, {', '.join(WIDE_COLUMNS)}{extra} FROM ("
            f"SELECT CAST(user_id AS VARCHAR) AS user_pin, {', '.join(parts)} FROM ("
            f"SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events) e "
            f"GROUP BY user_id))")


# ------------------------------------------------------ C. labelled docs ---
SYMBOL_CLASS = "[a-zA-Zà-ÿ \t\n\r\f.,]"
FEATURES = ["f_chars", "f_words", "f_pipes", "f_symbol_ratio", "f_line_ratio"]


def _doc_features(docs: DataFrame) -> DataFrame:
    text = F.col("text")
    lines = F.split(text, "\n")
    return docs.select(
        F.col("doc_id").cast("string").alias("user_pin"),
        F.col("doc_id"),
        F.col("n_chars").cast("double").alias("f_chars"),
        F.size(words("text")).cast("double").alias("f_words"),
        (F.length(text) - F.length(F.replace(text, F.lit("|"), F.lit("")))).cast("double").alias("f_pipes"),
        F.when(F.col("n_chars") > 0,
               F.length(F.regexp_replace(text, SYMBOL_CLASS, "")) / F.col("n_chars"))
         .otherwise(F.lit(0.0)).alias("f_symbol_ratio"),
        (F.size(F.array_distinct(lines)) / F.size(lines)).alias("f_line_ratio"),
    )


def labelled_docs(spark: SparkSession, sf_dir: str, parallel: bool = False) -> DataFrame:
    """``documents`` joined with ``labels``: ``user_pin, label, f_*``.

    ``parallel`` spreads single-split inputs before the regex features (for
    one-pass reports); iterative learners leave it off, since they pass over
    the (small) labelled set many times and extra partitions only add
    per-iteration task cost."""
    src = table(spark, sf_dir, "documents")
    docs = _doc_features(spread(src) if parallel else src)
    lab = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("int").alias("label"))
    return docs.join(lab, "doc_id").select("user_pin", "label", *FEATURES)


def target_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unlabelled documents (the scoring target)."""
    docs = _doc_features(table(spark, sf_dir, "documents"))
    lab = table(spark, sf_dir, "labels").select("doc_id")
    return docs.join(lab, "doc_id", "left_anti").select("user_pin", *FEATURES)


def rule_scores(df: DataFrame) -> DataFrame:
    """Three deterministic scores in [0, 1] used as stand-in model outputs."""
    return df.withColumns({
        "s1": F.col("f_line_ratio"),
        "s2": 1 - F.least(F.col("f_symbol_ratio") * 4, F.lit(1.0)),
        "s3": F.least(F.col("f_words") / 500.0, F.lit(1.0)),
    })


_DOC_FEATURES_SQL = (
    "SELECT CAST(doc_id AS VARCHAR) AS user_pin, doc_id, CAST(n_chars AS DOUBLE) AS f_chars, "
    f"CAST(len(regexp_extract_all(lower(text), '{WORD_PATTERN}')) AS DOUBLE) AS f_words, "
    "CAST(length(text) - length(replace(text, '|', '')) AS DOUBLE) AS f_pipes, "
    "CASE WHEN n_chars > 0 THEN length(regexp_replace(text, '[a-zA-Zà-ÿ ' || chr(9) || chr(10) || chr(13) "
    "|| chr(12) || '.,]', '', 'g')) / n_chars ELSE 0.0 END AS f_symbol_ratio, "
    "len(list_distinct(string_split(text, chr(10)))) / len(string_split(text, chr(10))) AS f_line_ratio "
    "FROM documents")

SQL = {
    "wide": _wide_sql(),
    "wide_const": _wide_sql(with_const=True),
    "wide_extra": _wide_sql(with_extra=True),
    "wide_nulls": _wide_sql(with_nulls=True),
    "labelled": ("(SELECT d.user_pin, CAST(l.quality AS INTEGER) AS label, f_chars, f_words, f_pipes, "
                 f"f_symbol_ratio, f_line_ratio FROM ({_DOC_FEATURES_SQL}) d JOIN labels l USING (doc_id))"),
    "target": (f"(SELECT d.user_pin, f_chars, f_words, f_pipes, f_symbol_ratio, f_line_ratio FROM "
               f"({_DOC_FEATURES_SQL}) d ANTI JOIN labels l USING (doc_id))"),
}
SQL["scored"] = ("(SELECT *, f_line_ratio AS s1, 1 - least(f_symbol_ratio * 4, 1.0) AS s2, "
                 f"least(f_words / 500.0, 1.0) AS s3 FROM {SQL['labelled']})")


# -------------------------------------------------------- D. raw bodies ---

def tag_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user: ``"averageScore":<n%6>,"commentCount":<n>,`` followed by
    ``"id":<first event id>,"name":"<type>","count":<events>`` per event type
    in name order."""
    ev = table(spark, sf_dir, "events")
    per_type = ev.groupBy("user_id", "event_type").agg(
        F.min("event_id").alias("eid"), F.count(F.lit(1)).alias("n"))
    item = F.concat(F.lit('"id":'), F.col("eid").cast("string"), F.lit(',"name":"'),
                    F.col("event_type"), F.lit('","count":'), F.col("n").cast("string"))
    # at most one entry per event type: the per-user list is bounded by the
    # number of types, not by the user's event count
    per_user = per_type.groupBy("user_id").agg(
        F.sort_array(F.collect_list(F.struct("event_type", item.alias("s")))).alias("items"),
        F.sum("n").alias("total"))
    body = F.concat(F.lit('"averageScore":'), (F.col("total") % 6).cast("string"),
                    F.lit(',"commentCount":'), F.col("total").cast("string"), F.lit(","),
                    F.array_join(F.col("items.s"), ","))
    return per_user.select(F.col("user_id").alias("sku"), body.alias("body"))


def _strip(c):
    return F.regexp_replace(c, '[\r\n"]', "")


def qa_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per conversation, every user turn as a question and the assistant turn
    right after it as its answer, laid out in the field order of a Q&A response;
    a question that no answer follows has none."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    conv = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", "role", "text",
        F.when(F.lead("role").over(order) == "assistant", F.lead("text").over(order)).alias("reply"))
    ask = F.concat(F.lit('"content":"'), _strip(F.col("text")), F.lit('","clientType":1,"productId":'),
                   F.col("conv_id").cast("string"),
                   F.lit(',"status":1,"lastAnswerTime":"2024-01-01 00:00:00","answerList":['))
    reply = F.concat(F.lit('{"content":"'), _strip(F.col("reply")), F.lit('","systemId":1,'))
    tail = F.lit('"created":"2024-01-01 00:00:00","modified":"2024-01-02 00:00:00"}]')
    block = F.concat(ask, F.coalesce(reply, F.lit("")), tail)
    blocks = conv.filter((F.col("role") == "user") & F.col("text").isNotNull()).select("conv_id", "turn", block.alias("block"))
    return (blocks.groupBy(F.col("conv_id").alias("sku"))
            .agg(F.sort_array(F.collect_list(F.struct("turn", "block"))).alias("b"))
            .select("sku", F.array_join("b.block", ",").alias("body")))


SQL["tag_bodies"] = (
    "(SELECT user_id AS sku, '\"averageScore\":' || CAST(sum(n) % 6 AS VARCHAR) || ',\"commentCount\":' || "
    "CAST(sum(n) AS VARCHAR) || ',' || string_agg('\"id\":' || CAST(eid AS VARCHAR) || ',\"name\":\"' || "
    "event_type || '\",\"count\":' || CAST(n AS VARCHAR), ',' ORDER BY event_type) AS body FROM ("
    "SELECT user_id, event_type, min(event_id) AS eid, count(*) AS n FROM events GROUP BY ALL) GROUP BY user_id)")

_STRIP_SQL = "regexp_replace({c}, '[' || chr(13) || chr(10) || '\"]', '', 'g')"
SQL["qa_bodies"] = (
    "(SELECT conv_id AS sku, string_agg('\"content\":\"' || " + _STRIP_SQL.format(c="text") +
    " || '\",\"clientType\":1,\"productId\":' || CAST(conv_id AS VARCHAR) || "
    "',\"status\":1,\"lastAnswerTime\":\"2024-01-01 00:00:00\",\"answerList\":[' || "
    "coalesce('{\"content\":\"' || " + _STRIP_SQL.format(c="reply") + " || '\",\"systemId\":1,', '') || "
    "'\"created\":\"2024-01-01 00:00:00\",\"modified\":\"2024-01-02 00:00:00\"}]', ',' ORDER BY turn, text) AS body FROM ("
    "SELECT *, CASE WHEN lead(role) OVER o = 'assistant' THEN lead(text) OVER o END AS reply FROM conversations "
    "WINDOW o AS (PARTITION BY conv_id ORDER BY turn, role, text)) "
    "WHERE role = 'user' AND text IS NOT NULL GROUP BY conv_id)")


# --------------------------------------------------------- token tables ---

def conversation_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as documents: ``id = conv_id * 100 + turn``."""
    conv = table(spark, sf_dir, "conversations")
    return conv.select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), "text")


def lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct ``benchmark`` words tagged ``short`` (< 5 letters) or ``long``."""
    bm = table(spark, sf_dir, "benchmark")
    w = bm.select(F.explode(words("text")).alias("word")).distinct()
    return w.select("word", F.when(F.length("word") < 5, "short").otherwise("long").alias("nature"))


SQL["conv_docs"] = "(SELECT conv_id * 100 + turn AS id, text FROM conversations)"
SQL["lexicon"] = (f"(SELECT word, CASE WHEN length(word) < 5 THEN 'short' ELSE 'long' END AS nature FROM "
                  f"(SELECT DISTINCT unnest(regexp_extract_all(lower(text), '{WORD_PATTERN}')) AS word FROM benchmark))")

# Fixed stop list: the 8 most frequent tokens of `documents` (computed once,
# at sf0.01, and frozen here as literals).
STOP_WORDS = ["the", "of", "de", "and", "to", "in", "a", "la"]
