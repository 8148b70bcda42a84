"""Spark helpers of this package: written intermediate tables, unique row keys, components."""

from __future__ import annotations

import gc
import os
import shutil
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoppulse.session import checkpoint_dir

#: Sorts before every real id; stands for a null doc_id.
NULL_ID = -(1 << 63)


def ship(spark) -> None:
    """Give the executors this library, as ``--py-files`` would; once a context."""
    sc = spark.sparkContext
    if not getattr(sc, "_shoppulse_shipped", False):
        package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        base = os.path.join(sc._temp_dir, "shoppulse")  # the driver's own scratch; Spark serves the file to executors
        sc.addPyFile(shutil.make_archive(base, "zip", os.path.dirname(package), os.path.basename(package)))
        sc._shoppulse_shipped = True


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet below the shared checkpoint folder and read it back.

    Cuts the lineage like ``checkpoint()``, but compressed and column-pruned.
    The files survive the loss of any executor.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark) -> None:
    """Let Spark delete the shuffle files of steps that are written out and no longer referred to."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread_rows(df: DataFrame) -> DataFrame:
    """Deal the rows of an input with fewer splits than cores to all cores.

    A plain file split count decides (``inputFiles`` and sizes are metadata), so
    nothing upstream runs; inputs with enough files are returned unchanged.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def thinned(edges: DataFrame) -> DataFrame:
    """Fewer ``edges(src, dst)`` that connect the same: each src to its smallest dst, and its other dst to that one.

    In a large group the smallest ones coincide, so about one edge a member is left.
    """
    low = edges.groupBy(F.col("src").alias("of")).agg(F.min("dst").alias("low"))
    rest = edges.join(low, F.col("src") == F.col("of")).select(F.col("dst").alias("src"), F.col("low").alias("dst"))
    return low.select(F.col("of").alias("src"), F.col("low").alias("dst")).union(rest).filter("src <> dst").distinct()


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected ``edges(src, dst)`` -> ``(id, component)``.

    ``component`` is the smallest id reachable.  Minimum labels move along the
    edges, then every label jumps to its own label's label, so the rounds grow
    with the logarithm of the longest chain.  Each round is written to the
    shared folder; both sides of every join are plain scans behind an exchange,
    so AQE can split the key of a very large component.
    """
    both = materialise(edges.select("src", "dst").union(edges.select("dst", "src"))
                       .filter("src <> dst").distinct())
    labels = materialise(both.groupBy(F.col("src").alias("id"))
                         .agg(F.min("dst").alias("m"))
                         .select("id", F.least("id", "m").alias("component")))
    while True:
        seen = (both.join(labels, both.dst == labels.id)
                .select(F.col("src").alias("id"), "component", F.lit(None).cast("long").alias("old"))
                .union(labels.select("id", "component", F.col("component").alias("old"))))
        near = materialise(seen.groupBy("id").agg(F.min("component").alias("component"),
                                                  F.max("old").alias("old")))
        up = near.select(F.col("id").alias("up_id"), F.col("component").alias("up"))
        jumped = materialise(near.join(up, near.component == up.up_id)
                             .select("id", F.col("up").alias("component"), "old"))
        moved = jumped.filter("component <> old").limit(1).count()
        labels = jumped.select("id", "component")
        if not moved:
            return labels
