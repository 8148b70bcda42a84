"""Queries of the cohort chain: wide behaviour table, schema operators,
sampling / splits, correlations and signed weights, layouts."""

from __future__ import annotations

from pyspark.sql import functions as F

from shoppulse.functions.hashing import TWO_32, sql_hash_bucket
from shoppulse.functions.numeric import safe_rate
from shoppulse.operators import correlation as C
from shoppulse.operators import features as FE
from shoppulse.operators import layout as L
from shoppulse.operators import sampling as S
from shoppulse.operators import schema as SC
from shoppulse.operators.text import tokenize
from shoppulse.plans import fixtures as FX
from shoppulse.plans.catalog import query

WIDE = FX.SQL["wide"]
NUM = FX.WIDE_COLUMNS


def _sum(*cols):
    return " + ".join(f"coalesce({c}, 0)" for c in cols)


_FAM_SUMS = {
    "attr_sum": _sum("attr_value_floor"),
    "pchs_sum": _sum("pchs_firstcate_n", "pchs_secondcate_n"),
    "clk_sum": _sum("clk_firstcate_n", "clk_secondcate_n"),
    "brs_sum": _sum("brs_firstcate_n", "brs_secondcate_n"),
    "cart_sum": _sum("cart_firstcate_n", "cart_secondcate_n"),
}
_LEVEL_SUMS = {f"{f}_{lvl}_sum": _sum(f"{f}_{lvl}_n") for f in ("pchs", "brs", "clk", "cart")
               for lvl in ("firstcate", "secondcate")}


def _rate_sql(num, den):
    return (f"CASE WHEN ({den}) <> 0 THEN CAST(({num}) AS DOUBLE) / ({den}) "
            f"WHEN ({num}) = 0 THEN NULL ELSE -1.0 END")


_RATES = {
    "clk_rate": (_FAM_SUMS["pchs_sum"], _FAM_SUMS["clk_sum"]),
    "clk_firstcate_rate": ("pchs_firstcate_n", "clk_firstcate_n"),
    "clk_secondcate_rate": ("pchs_secondcate_n", "clk_secondcate_n"),
    "brs_rate": (_FAM_SUMS["pchs_sum"], _FAM_SUMS["brs_sum"]),
    "brs_firstcate_rate": ("pchs_firstcate_n", "brs_firstcate_n"),
    "brs_secondcate_rate": ("pchs_secondcate_n", "brs_secondcate_n"),
    "cart_rate": (_FAM_SUMS["pchs_sum"], _FAM_SUMS["cart_sum"]),
    "cart_firstcate_rate": ("pchs_firstcate_n", "cart_firstcate_n"),
    "cart_secondcate_rate": ("pchs_secondcate_n", "cart_secondcate_n"),
    "attr_rate": (_FAM_SUMS["pchs_sum"], _FAM_SUMS["attr_sum"]),
}


@query("family_sums", "SELECT user_pin, " + ", ".join(
    f"{e} AS {n}" for n, e in {**_FAM_SUMS, **_LEVEL_SUMS}.items()) + f" FROM {WIDE}")
def family_sums(spark, sf_dir):
    w = FX.wide_behaviour(spark, sf_dir)
    out = FE.family_sums(w, level_sums=True)
    return out.select("user_pin", *_FAM_SUMS, *_LEVEL_SUMS)


# Fitted shape at the oracle scale: all ten ratios survive and a complete row
# exists, so the block is appended and nulls are filled.
@query("behaviour_features", "SELECT user_pin, " + ", ".join(
    f"coalesce({c}, 0) AS {c}" for c in NUM) + ", " + ", ".join(
    f"{e} AS {n}" for n, e in _FAM_SUMS.items()) + ", " + ", ".join(
    f"coalesce({_rate_sql(a, b)}, 0.0) AS {n}" for n, (a, b) in _RATES.items()) + f" FROM {FX.SQL['wide_nulls']}")
def behaviour_features(spark, sf_dir):
    w = FX.wide_behaviour(spark, sf_dir, with_nulls=True)
    return FE.BehaviourFeatures().fit(w).transform(w)


@query("safe_rate_edges", f"""SELECT user_pin, pchs_firstcate_n AS num, clk_firstcate_n AS den,
  coalesce({_rate_sql('pchs_firstcate_n', 'clk_firstcate_n')}, 0.0) AS rate,
  CASE WHEN clk_firstcate_n <> 0 THEN 'value' WHEN pchs_firstcate_n = 0 THEN 'zero_zero' ELSE 'x_zero' END AS kind
FROM {WIDE}""")
def safe_rate_edges(spark, sf_dir):
    w = FX.wide_behaviour(spark, sf_dir)
    kind = (F.when(F.col("clk_firstcate_n") != 0, "value")
             .when(F.col("pchs_firstcate_n") == 0, "zero_zero").otherwise("x_zero"))
    return w.select("user_pin", F.col("pchs_firstcate_n").alias("num"), F.col("clk_firstcate_n").alias("den"),
                    safe_rate("pchs_firstcate_n", "clk_firstcate_n").alias("rate"), kind.alias("kind"))


_ZV_COLS = NUM + ["attr_const"]


@query("zero_variance_columns", " UNION ALL ".join(
    f"SELECT '{c}' AS col_name, round(stddev_samp({c}), 6) AS stddev, stddev_samp({c}) = 0 AS is_zero "
    f"FROM {FX.SQL['wide_const']}" for c in _ZV_COLS))
def zero_variance_columns(spark, sf_dir):
    w = FX.wide_behaviour(spark, sf_dir, with_const=True)
    sd = SC.column_stddevs(w, _ZV_COLS)
    return sd.select(F.col("column").alias("col_name"), F.round("stddev", 6).alias("stddev"),
                     (F.col("stddev") == 0).alias("is_zero"))


@query("exclude_extra_columns", f"SELECT user_pin, {', '.join(NUM)} FROM {FX.SQL['wide_extra']} "
                                "WHERE extra_a = 0 AND extra_b = 0")
def exclude_extra_columns(spark, sf_dir):
    train = FX.wide_behaviour(spark, sf_dir)
    target = FX.wide_behaviour(spark, sf_dir, with_extra=True)
    return SC.filter_extra_zero(target, train.columns)


_RENAMED = ["nation", "nation_region", "region_key", "region"]


@query("rename_positional", "SELECT n_nationkey, n_name AS nation, n_regionkey AS nation_region, "
                            "r_regionkey AS region_key, r_name AS region FROM nation JOIN region "
                            "ON n_regionkey = r_regionkey")
def rename_positional(spark, sf_dir):
    n, r = FX.table(spark, sf_dir, "nation"), FX.table(spark, sf_dir, "region")
    j = n.join(r, n.n_regionkey == r.r_regionkey).select("n_nationkey", "n_name", "n_regionkey",
                                                         "r_regionkey", "r_name")
    return SC.rename_positional(j, _RENAMED, skip_first=1)


@query("dedup_columns", "SELECT n_nationkey AS key1, n_name AS name1, r_regionkey AS key2, r_name AS name2, "
                        "n_regionkey AS regionkey FROM nation JOIN region ON n_regionkey = r_regionkey")
def dedup_columns(spark, sf_dir):
    n, r = FX.table(spark, sf_dir, "nation"), FX.table(spark, sf_dir, "region")
    j = n.join(r, n.n_regionkey == r.r_regionkey).select(
        n.n_nationkey.alias("key"), n.n_name.alias("name"), r.r_regionkey.alias("key"),
        r.r_name.alias("name"), n.n_regionkey.alias("regionkey"))
    return SC.dedup_columns(j)


@query("hash_sample", f"SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate FROM orders "
                      f"WHERE {sql_hash_bucket('o_orderkey', 's2019')} < {int(TWO_32 * 0.1)}")
def hash_sample(spark, sf_dir):
    o = FX.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    return S.hash_sample(o, "o_orderkey", 0.1, 2019)


def _cohorts(spark, sf_dir):
    lab = FX.table(spark, sf_dir, "labels")
    pos = lab.filter(F.col("quality") == 1).select("doc_id", "toxic")
    neg = lab.filter(F.col("quality") == 0).select("doc_id", "toxic")
    return pos, neg


def _balance_sql(policy: str) -> str:
    if policy == "upto2":
        fp = "CASE WHEN n <= p THEN n / p ELSE 1.0 END"
        fn = "CASE WHEN n <= p THEN 1.0 WHEN n >= 2 * p THEN 2.0 * p / n ELSE p / n END"
    else:
        fp = "CASE WHEN p > n THEN n / p ELSE 1.0 END"
        fn = "CASE WHEN p > n THEN 1.0 ELSE p / n END"
    h = sql_hash_bucket("doc_id", "sbal0")
    return f"""WITH c AS (SELECT CAST(count(*) FILTER (WHERE quality = 1) AS DOUBLE) AS p,
                          CAST(count(*) FILTER (WHERE quality = 0) AS DOUBLE) AS n FROM labels),
  f AS (SELECT {fp} AS fp, {fn} AS fn FROM c)
SELECT doc_id, toxic, 1 AS label FROM labels, f WHERE quality = 1 AND (fp >= 1.0 OR {h} < floor(4294967296 * fp))
UNION ALL
SELECT doc_id, toxic, 0 AS label FROM labels, f WHERE quality = 0 AND (fn >= 1.0 OR {h} < floor(4294967296 * fn))"""


@query("balance_upto2", _balance_sql("upto2"))
def balance_upto2(spark, sf_dir):
    pos, neg = _cohorts(spark, sf_dir)
    return S.balance(pos, neg, "doc_id", "upto2", seed=0)


@query("balance_equal", _balance_sql("equal"))
def balance_equal(spark, sf_dir):
    pos, neg = _cohorts(spark, sf_dir)
    return S.balance(pos, neg, "doc_id", "equal", seed=0)


@query("cohort_counts", "SELECT quality AS label, count(*) AS n FROM labels GROUP BY quality")
def cohort_counts(spark, sf_dir):
    pos, neg = _cohorts(spark, sf_dir)
    return S.cohort_counts(SC.label_cohorts(pos, neg))


@query("union_cohorts", "SELECT doc_id, toxic, quality AS label FROM labels WHERE quality IN (0, 1)")
def union_cohorts(spark, sf_dir):
    pos, neg = _cohorts(spark, sf_dir)
    return SC.label_cohorts(pos, neg).select("doc_id", "toxic", F.col("label").cast("int").alias("label"))


@query("train_test_split", f"SELECT doc_id, CASE WHEN {sql_hash_bucket('doc_id', 't0')} < "
                           f"{int(TWO_32 * 0.8)} THEN 0 ELSE 1 END AS split FROM labels")
def train_test_split(spark, sf_dir):
    lab = FX.table(spark, sf_dir, "labels")
    return lab.select("doc_id", S.split_column("doc_id", [4, 1], 0, "split"))


@query("fold_assignment", f"SELECT doc_id, CAST({sql_hash_bucket('doc_id', 'f0')} % 5 AS INTEGER) AS fold "
                          "FROM labels")
def fold_assignment(spark, sf_dir):
    lab = FX.table(spark, sf_dir, "labels")
    return lab.select("doc_id", S.fold_column("doc_id", 5, 0, "fold"))


# ------------------------------------------------------------ correlations --
LI_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _corr_pairs_sql(table: str, cols, absolute=True) -> str:
    parts = []
    for i, a in enumerate(cols):
        for b in cols[i + 1:]:
            # the deviation of equal values need not come out as 0
            varies = " AND ".join(f"min({x}) FILTER ({y} IS NOT NULL) < max({x}) FILTER ({y} IS NOT NULL)" for x, y in ((a, b), (b, a)))
            v = f"CASE WHEN {varies} THEN corr({a}, {b}) END"
            v = f"abs({v})" if absolute else v
            parts.append(f"SELECT '{a}' AS level_0, '{b}' AS level_1, {v} AS corr_value FROM {table}")
            parts.append(f"SELECT '{b}' AS level_0, '{a}' AS level_1, {v} AS corr_value FROM {table}")
    return "(SELECT * FROM (" + " UNION ALL ".join(parts) + ") WHERE corr_value IS NOT NULL AND NOT isnan(corr_value))"


# ``capped`` is null on some rows, and ``fixed`` is constant on all others
LI_DERIVED = {"capped": "CASE WHEN l_discount > 0.05 THEN l_tax END",
              "fixed": "CASE WHEN l_discount > 0.05 THEN 123456.789 ELSE l_quantity END"}
LI_TABLE = "(SELECT *, " + ", ".join(f"{x} AS {c}" for c, x in LI_DERIVED.items()) + " FROM lineitem)"


@query("corr_pairs", f"SELECT level_0, level_1, round(corr_value, 6) AS corr_value FROM "
                     f"{_corr_pairs_sql(LI_TABLE, LI_COLS + list(LI_DERIVED))}")
def corr_pairs(spark, sf_dir):
    li = FX.table(spark, sf_dir, "lineitem").selectExpr(*LI_COLS, *[f"{x} AS {c}" for c, x in LI_DERIVED.items()])
    out = C.corr_pairs(li, li.columns)
    return out.select("level_0", "level_1", F.round("corr_value", 6).alias("corr_value"))


@query("item_correlation", f"""WITH t AS (SELECT source, unnest(regexp_extract_all(lower(text), '{FX.WORD_PATTERN}'))
    AS word FROM documents),
  c AS (SELECT source, word, count(*) AS n FROM t GROUP BY ALL),
  v AS (SELECT CAST(count(DISTINCT word) AS DOUBLE) AS V FROM c),
  m AS (SELECT source, sum(n) AS sx, sum(n * n) AS sxx FROM c GROUP BY source),
  xy AS (SELECT a.source AS s1, b.source AS s2, sum(a.n * b.n) AS sxy FROM c a JOIN c b
         ON a.word = b.word AND a.source <> b.source GROUP BY ALL),
  pr AS (SELECT a.source AS s1, b.source AS s2 FROM m a JOIN m b ON a.source <> b.source)
SELECT pr.s1 AS SKU1, pr.s2 AS SKU2, round((V * coalesce(sxy, 0) - ma.sx * mb.sx) /
   sqrt((V * ma.sxx - ma.sx * ma.sx) * (V * mb.sxx - mb.sx * mb.sx)), 6) AS correlation
FROM pr LEFT JOIN xy ON pr.s1 = xy.s1 AND pr.s2 = xy.s2 JOIN m ma ON ma.source = pr.s1
  JOIN m mb ON mb.source = pr.s2 CROSS JOIN v""")
def item_correlation(spark, sf_dir):
    docs = FX.table(spark, sf_dir, "documents")
    toks = tokenize(docs.select("source", "text"), "source", "text")
    counts = toks.groupBy("source", "word").agg(F.count(F.lit(1)).alias("n"))
    out = C.item_correlation(counts, "source", "word", "n")
    return out.select("SKU1", "SKU2", F.round("correlation", 6).alias("correlation"))


# Fixed tokens for the signed weights: purchase columns pull up, browse down.
POS_TOKEN, NEG_TOKEN = "pchs", "brs"


def _weights(spark, sf_dir, mode):
    w = FX.wide_behaviour(spark, sf_dir)
    pairs = C.corr_pairs(w, NUM)
    return C.signed_weights(pairs, NUM, POS_TOKEN, NEG_TOKEN, mode)


def _weights_sql(mode: str) -> str:
    m1, f1 = f"contains(level_0, '{POS_TOKEN}')", f"contains(level_0, '{NEG_TOKEN}')"
    m2, f2 = f"contains(level_1, '{POS_TOKEN}')", f"contains(level_1, '{NEG_TOKEN}')"
    cases = [(f"{m1} AND {f2}", 1, 1.0, -1, 1.0, 40, -40), (f"{f1} AND {m2}", -1, 1.0, 1, 1.0, -40, 40),
             (f"{m1} AND NOT {f2}", 1, 2.0, 1, 0.5, 70, 40), (f"{f1} AND NOT {m2}", -1, 2.0, -1, 0.5, -60, -40),
             (f"NOT {m1} AND {f2}", -1, 0.5, -1, 2.0, -40, -60), (f"NOT {f1} AND {m2}", 1, 0.5, 1, 2.0, 40, 70)]

    def case(i):
        return "CASE " + " ".join(f"WHEN {c[0]} THEN {c[i]}" for c in cases) + " END"
    names = ["s1", "k1", "s2", "k2", "a1", "a2"]
    sel = ", ".join(f"{case(i + 1)} AS {n}" for i, n in enumerate(names))
    agg = ("arg_max(s, rn) * exp(sum(ln(k)))" if mode == "multiply" else "sum(a)")
    start = "1.0" if mode == "multiply" else "0.0"
    feats = " UNION ALL ".join(f"SELECT '{c}' AS feature" for c in NUM)
    return f"""WITH p AS (SELECT *, row_number() OVER (ORDER BY corr_value DESC, level_0, level_1) AS rn
    FROM {_corr_pairs_sql(WIDE, NUM)}),
  b AS (SELECT level_0, level_1, corr_value AS c, rn, {sel} FROM p),
  u AS (SELECT level_0 AS feature, rn, s1 AS s, 1 + k1 * c AS k, a1 * c AS a FROM b WHERE s1 IS NOT NULL
        UNION ALL
        SELECT level_1 AS feature, rn, s2 AS s, 1 + k2 * c AS k, a2 * c AS a FROM b WHERE s1 IS NOT NULL),
  w AS (SELECT feature, {agg} AS weight FROM u GROUP BY feature),
  f AS ({feats})
SELECT f.feature, CAST(coalesce(w.weight, {start}) AS DOUBLE) AS weight FROM f LEFT JOIN w USING (feature)"""


@query("signed_weights_multiply", f"SELECT feature, round(weight, 4) AS weight FROM ({_weights_sql('multiply')})")
def signed_weights_multiply(spark, sf_dir):
    return _weights(spark, sf_dir, "multiply").select("feature", F.round("weight", 4).alias("weight"))


@query("signed_weights_add", f"SELECT feature, round(weight, 4) AS weight FROM ({_weights_sql('add')})")
def signed_weights_add(spark, sf_dir):
    return _weights(spark, sf_dir, "add").select("feature", F.round("weight", 4).alias("weight"))


@query("weighted_label", f"""WITH wt AS ({_weights_sql('multiply')}),
  x AS (UNPIVOT {WIDE} ON {', '.join(NUM)} INTO NAME feature VALUE v),
  s AS (SELECT user_pin, sum(CAST(v AS DOUBLE) * weight) AS score FROM x JOIN wt USING (feature)
        WHERE weight <> 0 GROUP BY user_pin),
  mm AS (SELECT min(score) AS lo, max(score) AS hi FROM s)
SELECT user_pin, round(CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 0.0 END, 6) AS score,
  CASE WHEN (CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 0.0 END) >= 0.5 THEN 1 ELSE 0 END AS label_int
FROM s, mm""")
def weighted_label(spark, sf_dir):
    w = FX.wide_behaviour(spark, sf_dir)
    wmap = C.weights_to_map(_weights(spark, sf_dir, "multiply"))  # one number per feature column
    out = C.weighted_label(w, wmap, 0.5)
    return out.select("user_pin", F.round("score", 6).alias("score"), "label_int")


# ----------------------------------------------------------------- layouts --
@query("row_index", "SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS row_idx FROM documents")
def row_index(spark, sf_dir):
    docs = FX.table(spark, sf_dir, "documents").select("doc_id")
    return L.with_row_index(docs, "doc_id", "row_idx")


@query("split_parts", """WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents),
  n AS (SELECT greatest(1, CAST(round_even(count(*) / 3.0, 0) AS BIGINT)) AS len FROM documents)
SELECT doc_id, CAST(least(floor(i / len), 2) + 1 AS INTEGER) AS part FROM r, n""")
def split_parts(spark, sf_dir):
    docs = FX.table(spark, sf_dir, "documents").select("doc_id")
    return L.split_parts(docs, "doc_id", 3)


@query("part_sizes", """WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents),
  n AS (SELECT greatest(1, CAST(round_even(count(*) / 3.0, 0) AS BIGINT)) AS len FROM documents)
SELECT CAST(least(floor(i / len), 2) + 1 AS INTEGER) AS part, count(*) AS n FROM r, n GROUP BY 1""")
def part_sizes(spark, sf_dir):
    """Rows per contiguous part (what the part writer puts in each folder)."""
    docs = FX.table(spark, sf_dir, "documents").select("doc_id")
    return L.split_parts(docs, "doc_id", 3).groupBy("part").agg(F.count(F.lit(1)).alias("n"))
