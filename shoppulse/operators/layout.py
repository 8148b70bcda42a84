"""Ordered layouts without a single-partition window: global row index,
prefix sums along a sort order, contiguous parts.

A global ``row_number()`` without ``partitionBy`` moves every row into one
task.  Here the rows are range-partitioned once, numbered where they lie and
written with those numbers; what remains is one row per partition (its size),
summed in order.  Prefix sums along a numeric key need no written table: a
two-level histogram of the key splits them into bounded pieces inside one plan.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shoppulse.session import written

#: Bits of ``monotonically_increasing_id`` that count the rows of a partition.
ROW_BITS = 33
#: First-level cells of a prefix sum, key values that one cell may hold before
#: it is split, and the most cells it is split into.
CELLS, CELL_ROWS, MOST_SPLIT = 1024, 4096, 8192


def with_row_index(df: DataFrame, order_col: str | Sequence[str], out_col: str = "row_idx",
                   ranges: int | None = None) -> DataFrame:
    """0-based global position along ``order_col`` (nulls first; rows with
    equal keys get consecutive positions in the order of a row hash).

    One pass range-partitions the rows by key, row hash and a serial number
    -- so a key value or a repeated row that makes up a third of the table is
    spread over many partitions -- and writes them with their partition and
    their place in it.  The other adds the number of rows in earlier
    partitions, a broadcast table of one row per partition."""
    keys = [order_col] if isinstance(order_col, str) else list(order_col)
    spread = [F.col(c) for c in (*keys, "_tb", "_seat")]
    marked = df.withColumn("_tb", F.xxhash64(*df.columns)).withColumn("_seat", F.monotonically_increasing_id())
    ranged = marked.repartitionByRange(ranges, *spread) if ranges else marked.repartitionByRange(*spread)
    placed = written(ranged.sortWithinPartitions(*spread).drop("_tb", "_seat")
                     .withColumn("_at", F.monotonically_increasing_id())
                     .withColumn("_part", F.shiftright("_at", ROW_BITS))
                     .withColumn("_at", F.col("_at").bitwiseAND(F.lit((1 << ROW_BITS) - 1))))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")) \
        .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return (placed.join(F.broadcast(parts), "_part")
            .withColumn(out_col, (F.col("_before") + F.col("_at")).cast("bigint"))
            .select(*df.columns, out_col))


def prefix_sums(df: DataFrame, order_col: str, sum_cols: Sequence[str], inclusive: bool = False,
                suffix: str = "_before", by: Sequence[str] = (), cells: int = CELLS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """For each row, the sums of ``sum_cols`` over all rows (of its group
    ``by``) with a smaller numeric ``order_col``; ``inclusive`` adds the row
    itself.  ``order_col`` should be unique (aggregate ties first).

    The key's span is cut into ``cells`` equal cells; a cell with more than
    ``cell_rows`` rows is cut again over its own span.  A row's sum is that of
    the cells before its own, of the sub-cells before its own, and of the
    rows before it in its sub-cell.  Nothing runs while the plan is built, and
    no window but the last sees more than one row per cell."""
    key = F.col(order_col).cast("double")
    by = list(by)
    sums = [F.sum(c).alias(f"_t_{c}") for c in sum_cols]

    def cell(lo, hi, n):
        share = F.nanvl(F.try_divide(key - F.col(lo), F.col(hi) - F.col(lo)), F.lit(0.0))  # infinite spans: one cell
        at = F.floor(share * F.col(n)).cast("bigint")
        return F.when(F.col(hi) > F.col(lo), F.least(at, F.col(n) - 1)).otherwise(F.lit(0).cast("bigint"))

    def before(window, level):
        rows = window.rowsBetween(Window.unboundedPreceding, -1)
        return [F.coalesce(F.sum(f"_t_{c}").over(rows), F.lit(0)).alias(f"_o{level}_{c}") for c in sum_cols]

    def joined(left, right, keys):
        names = {k: f"_r{k}" for k in keys}
        right = right.select(*[F.col(k).alias(names.get(k, k)) for k in right.columns])
        on = [F.col(k).eqNullSafe(F.col(names[k])) for k in keys]
        return (left.join(right, on) if on else left.crossJoin(F.broadcast(right))).drop(*names.values())  # no key: one row

    span = df.groupBy(*by).agg(F.min(key).alias("_lo"), F.max(key).alias("_hi")).withColumn("_n", F.lit(cells).cast("bigint"))
    one = joined(df, span, by).withColumn("_c1", cell("_lo", "_hi", "_n")).drop("_lo", "_hi", "_n")
    first = one.groupBy(*by, "_c1").agg(F.min(key).alias("_lo"), F.max(key).alias("_hi"), F.count(F.lit(1)).alias("_rows"), *sums)
    split = F.least(F.ceil(F.col("_rows") / F.lit(cell_rows)), F.lit(MOST_SPLIT)).cast("bigint")
    first = first.select(*by, "_c1", "_lo", "_hi", split.alias("_n"), *before(Window.partitionBy(*by).orderBy("_c1"), 1))
    two = joined(one, first, [*by, "_c1"]).withColumn("_c2", cell("_lo", "_hi", "_n")).drop("_lo", "_hi", "_n")
    second = two.groupBy(*by, "_c1", "_c2").agg(*sums)
    second = second.select(*by, "_c1", "_c2", *before(Window.partitionBy(*by, "_c1").orderBy("_c2"), 2))
    out = joined(two, second, [*by, "_c1", "_c2"])
    within = Window.partitionBy(*by, "_c1", "_c2").orderBy(order_col).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    for c in sum_cols:
        out = out.withColumn(f"{c}{suffix}", F.col(f"_o1_{c}") + F.col(f"_o2_{c}") + F.coalesce(F.sum(c).over(within), F.lit(0)))
    return out.select(*df.columns, *[f"{c}{suffix}" for c in sum_cols])


def part_length(n_rows: int, n_parts: int) -> int:
    """``round(N / n)`` with Python's half-to-even rounding."""
    return round(n_rows / n_parts)


def split_parts(df: DataFrame, order_col: str, n_parts: int, out_col: str = "part") -> DataFrame:
    """Contiguous parts along ``order_col``: ``len = round_half_even(N/n)``,
    part i holds rows ``[i*len, (i+1)*len)``; the tail that rounding leaves
    over joins the last part (the reference drops it).  Parts are 1-based."""
    idx = with_row_index(df, order_col, "_ri")
    size = max(1, part_length(idx.count(), n_parts))  # counted from the written table's footers
    part = F.least(F.floor(F.col("_ri") / F.lit(size)), F.lit(n_parts - 1)) + 1
    return idx.withColumn(out_col, part.cast("int")).drop("_ri")
