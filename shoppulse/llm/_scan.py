"""Running sums within keys that may span many tasks."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._spark import materialise
from ._text import BASE

U64 = np.uint64


def power(exponent: np.ndarray, base=BASE) -> np.ndarray:
    """base**exponent modulo 2**64, by squaring."""
    e = exponent.astype(U64)
    out, b = np.ones(len(e), U64), np.full(1, base, U64)
    for _ in range(int(e.max(initial=0)).bit_length()):
        out = np.where(e & U64(1), out * b, out)
        b = b * b
        e = e >> U64(1)
    return out


def wrapped(column) -> np.ndarray:
    """A long Arrow column as unsigned numbers modulo 2**64; null is 0."""
    return column.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(U64)


def _segments(key: np.ndarray, carry):
    """Start index of each row's run of equal keys; whether the first goes on from the batch before."""
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    goes_on = carry is not None and len(key) > 0 and key[0] == carry
    begin = np.flatnonzero(new)
    return begin[np.cumsum(new) - 1], goes_on


def scan(df: DataFrame, key: str, order: list, sums: list = (), lanes: list = ()) -> DataFrame:
    """``df`` with running values of every row's predecessors and itself within its ``key``, in ``order``.

    Adds ``place`` (0, 1, ..), ``{c}_run`` for each long in ``sums``, and for
    each long in ``lanes`` the monoid product ``{c}_upto`` = sum of value times
    BASE**place modulo 2**64 and ``{c}_before``, the same without the row.

    The rows are range-partitioned by key and order, so a key that holds a
    third of all rows spans many tasks.  Each task scans its own part; only the
    first and last key of a part can go on elsewhere, so the totals carried
    over are at most two rows a part and may be broadcast.
    """
    names = df.columns
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    runs = [f"{c}_run" for c in sums]
    tops = [x for c in lanes for x in (f"{c}_upto", f"{c}_before")]
    added = ["part", "place", *runs, *tops]

    def local(batches):
        from pyspark import TaskContext

        part, last, count = TaskContext.get().partitionId(), None, 0
        held = {c: np.zeros(1, U64) for c in [*sums, *lanes]}
        for batch in batches:
            if not batch.num_rows:
                continue
            k = batch.column(key).to_numpy(zero_copy_only=False)
            begin, goes_on = _segments(k, last)
            first = begin == 0
            place = np.arange(len(k)) - begin + np.where(first & goes_on, count, 0)
            out = {}
            for c in [*sums, *lanes]:
                value = wrapped(batch.column(c))
                if c in lanes:
                    value = value * power(place)
                total = np.concatenate([np.zeros(1, U64), np.cumsum(value)])
                run = total[1:] - total[begin]
                if goes_on:
                    run = run + np.where(first, held[c], U64(0))
                held[c] = run[-1:]
                out[c] = (run, run - value)
            last, count = k[-1], int(place[-1]) + 1
            long = lambda x: pa.array(x.view(np.int64) if x.dtype == U64 else x, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, long(np.full(len(k), part)), long(place), *[long(out[c][0]) for c in sums],
                 *[long(x) for c in lanes for x in out[c]]], names=[*names, *added])

    schema = fields + "".join(f", `{c}` long" for c in added)
    scanned = materialise(df.repartitionByRange(key, *order).sortWithinPartitions(key, *order).mapInArrow(local, schema))
    totals = (scanned.groupBy(key, "part")
              .agg((F.max("place") + 1).alias("place"),
                   *[F.max_by(c, "place").alias(c) for c in runs],
                   *[F.max_by(f"{c}_upto", "place").alias(f"{c}_upto") for c in lanes])
              .withColumn("parts", F.count("*").over(Window.partitionBy(key))).filter("parts > 1").drop("parts"))
    upto = [f"{c}_upto" for c in lanes]

    def carried(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("part")
        n = rows["place"].to_numpy()
        before = np.cumsum(n) - n
        out = {"carry_key": rows[key], "carry_part": rows["part"], "carry_place": before}
        for c in [*runs, *upto]:
            value = rows[c].to_numpy().astype(np.int64).view(U64)
            if c in upto:
                value = value * power(before)
            out[f"carry_{c}"] = (np.cumsum(value) - value).view(np.int64)
        return pd.DataFrame(out)

    carry_names = ["place", *runs, *upto]
    carry = totals.groupBy(key).applyInPandas(
        carried, "carry_key long, carry_part long, " + ", ".join(f"carry_{c} long" for c in carry_names))
    carry = materialise(carry)
    with_carry = scanned.join(F.broadcast(carry), (F.col(key) == F.col("carry_key")) & (F.col("part") == F.col("carry_part")),
                              "left").drop("carry_key", "carry_part")

    def whole(batches):
        for batch in batches:
            before = wrapped(batch.column("carry_place"))
            cols = {c: batch.column(c) for c in [*names, *added] if c != "part"}
            cols["place"] = pa.array((wrapped(cols["place"]) + before).view(np.int64))
            for c in runs:
                cols[c] = pa.array((wrapped(cols[c]) + wrapped(batch.column(f"carry_{c}"))).view(np.int64))
            shift = power(before)
            for c in tops:
                start = wrapped(batch.column("carry_" + c.removesuffix("_upto").removesuffix("_before") + "_upto"))
                cols[c] = pa.array((wrapped(cols[c]) * shift + start).view(np.int64))
            yield pa.RecordBatch.from_pydict(cols)

    return with_carry.mapInArrow(whole, fields + "".join(f", `{c}` long" for c in added if c != "part"))
