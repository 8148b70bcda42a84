"""Readers.  All are lazy scans (but for the quote states of ``multi_line``):
Spark lists and splits the files across executors; nothing is read on the
driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from shoppulse.sources.quoted import read_quoted

# Fixed value: review files are named <sku><sentiment>.csv, sentiment po / ne.
REVIEW_FILE = r"([0-9]+)(po|ne)\.csv$"


def read_cohort(spark: SparkSession, path: str | list[str], schema: StructType | str | None = None,
                id_col: str = "user_pin") -> DataFrame:
    """Cohort CSV(s) with a header (HDFS, S3 or local URIs).  With an explicit
    schema there is no inference pass; without one types are inferred (one
    extra scan) and the id column is kept as a string."""
    r = spark.read.option("header", True).option("encoding", "UTF-8")
    if schema is not None:
        return r.schema(schema).csv(path)
    inferred = r.option("inferSchema", True).csv(path).schema
    # the id must stay text: inference would turn "007" into 7
    fields = [StructField(f.name, StringType(), True) if f.name == id_col else f for f in inferred.fields]
    return r.schema(StructType(fields)).csv(path)


def read_reviews(spark: SparkSession, path: str | list[str], header: bool = True,
                 col: str = "V1", multi_line: bool = False, escape: str = "\\") -> DataFrame:
    """One-column review CSV, UTF-8 (a byte-order mark before the header is
    dropped by Spark's reader).  A headerless file gets the column ``col``
    (``V1``, as R names it).  Empty strings read as null, as in the
    reference's readers.  ``multi_line`` reads quoted line breaks, in as many
    tasks as the file has splits; it takes one more pass over the file, when
    the reader is called.  ``escape`` is the character before a quote inside
    quotes, or ``"`` for doubled quotes."""
    if multi_line:
        return read_quoted(spark, path, header, None if header else [col], escape=escape).drop("_file")
    r = spark.read.option("header", header).option("encoding", "UTF-8").option("escape", escape)
    df = r.schema(f"`{col}` string").csv(path) if not header else r.csv(path)
    if header and df.columns:
        first = df.columns[0]
        df = df.withColumnRenamed(first, first.lstrip("﻿"))
    return df


def read_review_dir(spark: SparkSession, glob: str, header: bool = True, multi_line: bool = False,
                    escape: str = "\\") -> DataFrame:
    """Many per-SKU review files as one table ``(sku, sentiment, comments)``;
    SKU and sentiment come from each row's file name."""
    if multi_line:
        df = read_quoted(spark, glob, header, None if header else ["V1"], escape=escape)
        fname, text_col = F.col("_file"), df.columns[1]
    else:
        df = read_reviews(spark, glob, header, escape=escape)
        fname, text_col = F.input_file_name(), df.columns[0]
    return df.select(F.regexp_extract(fname, REVIEW_FILE, 1).alias("sku"),
                     F.regexp_extract(fname, REVIEW_FILE, 2).alias("sentiment"),
                     F.col(text_col).alias("comments"))


def read_sku_list(spark: SparkSession, path: str) -> DataFrame:
    """Comma-separated SKU list(s) -> one row per non-empty SKU."""
    t = spark.read.text(path)
    return (t.select(F.explode(F.split("value", ",")).alias("sku"))
             .select(F.trim("sku").alias("sku")).filter(F.col("sku") != ""))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text file as one row per line (``value``)."""
    return spark.read.text(path)
