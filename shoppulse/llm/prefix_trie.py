"""Prefix trie of rebuilt conversations, from fingerprints that compose as a monoid.

A rebuilt conversation is the first turns of a base conversation followed by
its own later turns.  No rebuilt text is ever made: a turn has a fingerprint
(two 64-bit numbers), a sequence of turns has the product of its turns
(sum of fingerprint times BASE**place), and products of a head and of a suffix
combine: product(head + suffix) = product(head) + BASE**len(head) *
product(suffix), the suffix of a conversation being the difference of two of
its own prefix products.  So every rebuilt prefix is named from the products of
stored turns alone, and rows carry numbers and a reference to the stored turn,
never text.

Prefixes of equal depth and product form one node.  Equality is then verified:
within a node all members must have the same parent product and refer to turns
of one fingerprint, and all stored turns of one fingerprint must have equal
role and text.  By induction over the depth, a node then holds equal sequences
and nothing else.  Should a check fail, everything is done anew with another
seed and wider fingerprints, so a collision costs time and never a wrong node.

The nodes whose smallest member is c form one downward path (chain) that hangs
below a node of a smaller conversation.  Sums over subtrees are sums over
chains: totals of whole chains by doubling (each chain adds its sum to its
1st, 2nd, 4th, .. ancestor, so the rounds grow with the logarithm of the
nesting), then a running sum from the end of each chain.  Running sums and
products split a conversation that holds a third of all turns over many tasks
(:mod:`._scan`).  The digest of a node's ends reads their numbers in order, in
chunks prepared by many tasks.

Defined cases: a null turn comes first; turns of one number are ordered by
role, text (by their first 64 characters, then by hash), and equal ones are
turns of their own; a null role or text is empty; rows with a null conv_id
belong to no conversation and are left out; a missing base gives an empty head;
a conversation whose own turns all lie in the head ends in its base's path; one
without any rebuilt turn ends at the root; an empty table has no root and gives
an empty result; very long texts are hashed and counted where they are read and
never moved but for the check of equal fingerprints; extra columns are not
read, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ._scan import U64, power, scan
from ._spark import materialise
from ._text import INVERSE

MODULUS = 100
HEADS = 6
#: Code points of role and text that order turns of one number.
ORDER_CHARS = 64
#: Numbers in one chunk of a node's ends.
CHUNK = 4096
NOTHING = hashlib.sha256(b"").hexdigest()
KEY = ["depth", "f1", "f2"]


def heads_from_hundreds(conversations: DataFrame) -> DataFrame:
    """(conv_id, base_id, head): conversation c takes crc32(c) % 6 turns of conversation c - c % 100."""
    c = F.col("conv_id")
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id")).filter("conv_id IS NOT NULL").distinct() \
        .select("conv_id", (c - c % MODULUS).alias("base_id"), (F.crc32(c.cast("string").cast("binary")) % HEADS).alias("head"))


def _stored(conversations: DataFrame) -> DataFrame:
    return conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def _fingerprints(seed: int, bits: int):
    mask = F.lit(-1 if bits >= 64 else (1 << bits) - 1)
    return [F.xxhash64(F.lit(2 * seed + k), F.lit("role"), "role", F.lit("text"), "text").bitwiseAND(mask).alias(f"x{k}") for k in (1, 2)]


def turn_products(stored: DataFrame, seed: int = 0, bits: int = 64) -> DataFrame:
    """Every turn with its place in its conversation and the products up to and before it."""
    rows = stored.select("conv_id", "turn", F.substring("role", 1, ORDER_CHARS).alias("role_start"),
                         F.substring("text", 1, ORDER_CHARS).alias("text_start"),
                         F.length("text").cast("long").alias("chars"), *_fingerprints(seed, bits))
    rows = rows.withColumn("serial", F.monotonically_increasing_id())
    order = [F.col(c) for c in ("turn", "role_start", "text_start", "x1", "x2", "serial")]
    return scan(rows, "conv_id", order, lanes=["x1", "x2"]) \
        .drop("turn", "role_start", "text_start", "serial")


@F.pandas_udf(LongType())
def _joined(head: pd.Series, own: pd.Series, skipped: pd.Series, missing: pd.Series) -> pd.Series:
    """Product of a head and the own turns from ``skipped`` on; ``missing`` = turns skipped less turns in the head."""
    h, o, s = (x.to_numpy(np.int64).view(U64) for x in (head, own, skipped))
    return pd.Series((h + (o - s) * power(missing.to_numpy(np.int64), INVERSE)).view(np.int64))


def prefixes(products: DataFrame, plan: DataFrame, most: int = HEADS - 1) -> DataFrame:
    """One row for every prefix of every rebuilt conversation, symbolically.

    conv_id, depth, f1, f2 (product), p1, p2 (product of the parent), x1, x2,
    chars (of the last turn), is_end.
    """
    first = F.when(F.col("place") < most, F.struct("place", "x1_upto", "x2_upto", "x1", "x2", "chars"))
    own = products.groupBy("conv_id").agg(F.count("*").alias("turns"), F.sort_array(F.collect_list(first)).alias("heads"))
    own = materialise(own)
    base = own.select(F.col("conv_id").alias("base_id"), F.col("heads").alias("base"))
    zero = F.lit(0).cast("long")

    def upto(heads: str, n: str, lane: str):
        return F.when(F.col(n) > 0, F.col(heads)[(F.col(n) - 1).cast("int")][f"{lane}_upto"]).otherwise(zero)

    made = (plan.select("conv_id", "base_id", F.least("head", F.lit(most)).cast("long").alias("cut"))
            .join(own, "conv_id").join(base, "base_id", "left")
            .withColumn("base", F.coalesce("base", F.array().cast(own.schema["heads"].dataType)))
            .withColumn("taken", F.least("cut", F.size("base").cast("long")))
            .withColumn("reach", F.least("cut", "turns"))
            .withColumn("length", F.col("taken") + F.greatest(F.col("turns") - F.col("cut"), zero))
            .select("conv_id", "cut", "taken", "length", F.slice("base", 1, F.col("taken").cast("int")).alias("base"),
                    *[upto("base", "taken", x).alias(f"h_{x}") for x in ("x1", "x2")],
                    *[upto("heads", "reach", x).alias(f"s_{x}") for x in ("x1", "x2")]))
    made = materialise(made)
    columns = ["conv_id", "depth", "f1", "f2", "p1", "p2", "x1", "x2", "chars", "is_end"]
    root = made.select("conv_id", *[zero.alias(c) for c in columns[1:-1]], (F.col("length") == 0).alias("is_end"))
    turn = F.col("t")
    parent = [F.when(turn["place"] > 0, F.col("base")[(turn["place"] - 1).cast("int")][f"{x}_upto"]).otherwise(zero) for x in ("x1", "x2")]
    head = made.withColumn("t", F.explode("base")).select(
        "conv_id", (turn["place"] + 1).alias("depth"), turn["x1_upto"].alias("f1"), turn["x2_upto"].alias("f2"),
        parent[0].alias("p1"), parent[1].alias("p2"), turn["x1"].alias("x1"), turn["x2"].alias("x2"),
        turn["chars"].alias("chars"), (turn["place"] + 1 == F.col("length")).alias("is_end"))
    missing = F.col("cut") - F.col("taken")
    depth = F.col("place") - missing + 1
    tail = products.join(made.drop("base"), "conv_id").filter("place >= cut").select(
        "conv_id", depth.alias("depth"),
        *[_joined(f"h_{x}", f"{x}_{end}", f"s_{x}", missing).alias(name)
          for end, names in (("upto", ("f1", "f2")), ("before", ("p1", "p2"))) for x, name in zip(("x1", "x2"), names)],
        "x1", "x2", "chars", (depth == F.col("length")).alias("is_end"))
    return root.select(columns).union(head.select(columns)).union(tail.select(columns))


def _equal_turns(stored: DataFrame, seed: int, bits: int) -> bool:
    """Whether all stored turns of one fingerprint have equal role and text."""
    ends = [f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in ("role", "text")]
    classes = stored.select(*_fingerprints(seed, bits), "role", "text").groupBy("x1", "x2").agg(*ends)
    return not classes.filter("min_role <> max_role OR min_text <> max_text").limit(1).count()


def grouped(conversations: DataFrame, plan: DataFrame, bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """(members, nodes), both written; nodes are verified to hold equal sequences."""
    stored = _stored(conversations)
    seed = 0
    while True:
        if _equal_turns(stored, seed, bits):
            members = materialise(prefixes(materialise(turn_products(stored, seed, bits)), plan))
            same = ["p1", "p2", "x1", "x2", "chars"]
            nodes = materialise(members.groupBy(*KEY).agg(
                F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"),
                *[F.min(c).alias(c) for c in same], *[F.max(c).alias(f"max_{c}") for c in same]))
            if not nodes.filter(" OR ".join(f"{c} <> max_{c}" for c in same)).limit(1).count():
                return members, nodes.drop(*[f"max_{c}" for c in same])
        seed, bits = seed + 1, min(64, 2 * bits)


def _ends(members: DataFrame) -> DataFrame:
    """depth, f1, f2, ends_sha256 of the nodes in which conversations end."""
    ends = members.filter("is_end").select(*KEY, "conv_id")

    def rows(out, *names):
        return pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], names=[*KEY, *names])

    def chunks(batches):
        key, first, held, out = None, 0, [], []
        for batch in batches:
            for *k, c in zip(*(batch.column(x).to_pylist() for x in [*KEY, "conv_id"])):
                if k != key or len(held) == CHUNK:
                    if held:
                        out.append((*key, first, ",".join(held)))
                    if len(out) == CHUNK:
                        yield rows(out, "first", "ids")
                        out = []
                    key, first, held = k, c, []
                held.append(str(c))
        if held:
            yield rows([*out, (*key, first, ",".join(held))], "first", "ids")

    def digests(batches):
        key, state, out = None, None, []
        for batch in batches:
            for *k, ids in zip(*(batch.column(x).to_pylist() for x in [*KEY, "ids"])):
                if k == key:
                    state.update(b"," + ids.encode())
                    continue
                if key is not None:
                    out.append((*key, state.hexdigest()))
                key, state = k, hashlib.sha256(ids.encode())
            if out:
                yield rows(out, "ends_sha256")
                out = []
        if key is not None:
            yield rows([(*key, state.hexdigest())], "ends_sha256")

    cut = (ends.repartitionByRange(*KEY, "conv_id").sortWithinPartitions(*KEY, "conv_id")
           .mapInArrow(chunks, "depth long, f1 long, f2 long, first long, ids string"))
    return cut.repartition(*KEY).sortWithinPartitions(*KEY, "first") \
        .mapInArrow(digests, "depth long, f1 long, f2 long, ends_sha256 string")


def _chain_totals(chains: DataFrame, sums: list, root) -> DataFrame:
    """Each chain's sums over itself and all chains below it; ``chains(conv_id, up, *sums)``, ``up`` its parent chain."""
    state = chains
    while state.filter("up IS NOT NULL").limit(1).count():
        below = state.filter("up IS NOT NULL").groupBy(F.col("up").alias("at")).agg(*[F.sum(c).alias(f"more_{c}") for c in sums])
        above = state.select(F.col("conv_id").alias("a_id"), F.col("up").alias("a_up"))
        jump = F.when(F.col("up") != F.lit(root), F.col("up"))  # the top chain has none above
        state = materialise(state.withColumn("jump", jump)
                            .join(above, F.col("jump") == F.col("a_id"), "left")
                            .join(below, F.col("conv_id") == F.col("at"), "left")
                            .select("conv_id", F.col("a_up").alias("up"),
                                    *[(F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c) for c in sums]))
    return state.drop("up")


def trie(conversations: DataFrame, plan: DataFrame | None = None, bits: int = 64) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``plan(conv_id, base_id, head)`` says which conversation gives each one its
    first ``head`` (at most 5) turns; by default :func:`heads_from_hundreds`.
    """
    members, nodes = grouped(conversations, heads_from_hundreds(conversations) if plan is None else plan, bits)
    top = nodes.filter("depth = 0").select("conv_id").first()
    root = top[0] if top else None
    sums = ["saved", "leaves"]
    children = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("c_depth"), F.col("p1").alias("c1"), F.col("p2").alias("c2")) \
        .agg(F.count("*").alias("n_children"))
    nodes = materialise(
        nodes.join(children, (F.col("depth") == F.col("c_depth")) & (F.col("f1") == F.col("c1")) & (F.col("f2") == F.col("c2")), "left")
        .withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long"))
        .withColumn("saved", (F.col("n_convs") - 1) * F.col("chars"))
        .withColumn("leaves", (F.col("n_children") == 0).cast("long"))
        .select(*KEY, "conv_id", "n_convs", "n_children", "p1", "p2", *sums))
    # the upper end of each chain and the node that it hangs below
    own = nodes.groupBy("conv_id").agg(F.min(F.struct("depth", "p1", "p2")).alias("start"), *[F.sum(c).alias(c) for c in sums]) \
        .select("conv_id", (F.col("start.depth") - 1).alias("below"), "start.p1", "start.p2", *sums)
    above = nodes.select(F.col("depth").alias("u_depth"), F.col("f1").alias("u1"), F.col("f2").alias("u2"), F.col("conv_id").alias("u"))
    deep = own.filter("below > 0").join(
        above, (F.col("below") == F.col("u_depth")) & (F.col("p1") == F.col("u1")) & (F.col("p2") == F.col("u2")))
    hung = deep.select("conv_id", "below", F.col("u").alias("up"), *sums)
    hung = hung.union(own.filter("below <= 0").select(
        "conv_id", "below", F.when(F.col("below") == 0, F.lit(root)).cast("long").alias("up"), *sums))
    hung = materialise(hung)
    totals = _chain_totals(hung.select("conv_id", "up", *sums), sums, root)
    at = (hung.select("conv_id", "below", "up").filter("up IS NOT NULL").join(totals, "conv_id")
          .groupBy(F.col("up").alias("t_conv"), F.col("below").alias("t_depth"))
          .agg(*[F.sum(c).alias(f"t_{c}") for c in sums]))
    valued = (nodes.join(at, (F.col("conv_id") == F.col("t_conv")) & (F.col("depth") == F.col("t_depth")), "left")
              .select(*KEY, "conv_id", "n_convs", "n_children", (-F.col("depth")).alias("rise"),
                      *[(F.col(c) + F.coalesce(f"t_{c}", F.lit(0))).alias(c) for c in sums]))
    summed = scan(valued, "conv_id", [F.col("rise")], sums=sums)
    starts = hung.select(F.col("conv_id").alias("s_conv"), (F.col("below") + 1).alias("s_depth"), "up")
    ends = _ends(members).select(*[F.col(k).alias(f"e_{k}") for k in KEY], "ends_sha256")
    return (summed.join(starts, (F.col("conv_id") == F.col("s_conv")) & (F.col("depth") == F.col("s_depth")), "left")
            .join(ends, [F.col(k) == F.col(f"e_{k}") for k in KEY], "left")
            .select("conv_id", "depth",
                    F.when(F.col("depth") > 0, F.coalesce("up", "conv_id")).alias("parent_conv_id"),
                    "n_convs", "n_children", F.col("leaves_run").alias("n_leaves"), F.col("saved_run").alias("saved_tokens"),
                    F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256")))
