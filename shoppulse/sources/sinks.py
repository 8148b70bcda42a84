"""Writers.  Everything is written by the executors in parallel; only the
single-file export funnels through one task, and only for small results."""

from __future__ import annotations

from pyspark.sql import DataFrame

from shoppulse.operators.layout import split_parts


def save_users(df: DataFrame, path: str, id_col: str = "user_pin") -> None:
    """Selected users as a CSV directory with a header, overwriting."""
    df.select(id_col).write.mode("overwrite").option("header", True).csv(path)


def save_single_csv(df: DataFrame, path: str, max_rows: int = 1_000_000) -> None:
    """One CSV part file for a small final result.  The row count is checked
    first (bounded action) so a large table is never funnelled into one
    task; more than ``max_rows`` rows are an error (use ``save_table``)."""
    if df.limit(max_rows + 1).count() > max_rows:
        raise ValueError(f"more than {max_rows} rows: not a single-file export")
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def save_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
               partition_by: list[str] | None = None) -> None:
    """Intermediate table (parquet by default, CSV with header otherwise)."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)


def write_parts(df: DataFrame, order_col: str, n_parts: int, path: str, fmt: str = "parquet") -> None:
    """Contiguous parts along ``order_col`` written as ``part=<i>`` folders
    (the tail left over by rounding joins the last part)."""
    # no repartition by part: with few parts that would put a whole part in
    # one task; each task writes its own rows into the part folders instead
    # in their order
    parts = split_parts(df, order_col, n_parts, "part").sortWithinPartitions("part", order_col)
    save_table(parts, path, fmt, partition_by=["part"])
