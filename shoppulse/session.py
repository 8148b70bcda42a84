"""Session defaults and small execution helpers shared by every operator."""

from __future__ import annotations

import contextlib
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Settings the operators rely on.  AQE re-plans joins from runtime sizes
# (broadcast only when the measured side is small), splits skewed shuffle
# partitions of joins, and coalesces tiny partitions after a shuffle.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "shoppulse", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the defaults above.

    On a cluster ``master`` stays ``None`` so spark-submit decides; tests pass
    ``local[*]``.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder for lineage cuts.

    The cluster names it in ``spark.checkpoint.dir``.  Only a local-mode
    session (tests) without that setting gets a fresh scratch folder; on a
    cluster a missing setting is an error, because a machine-local folder is
    not visible to other executors and does not survive their loss.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder (HDFS/S3) for checkpoints")
        configured = tempfile.mkdtemp(prefix="shoppulse-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        try:
            spark.conf.set("spark.checkpoint.dir", configured)
        except Exception:  # noqa: BLE001 -- core confs may be read-only at runtime
            pass
    sc.setCheckpointDir(configured)
    return configured


def ship(spark: SparkSession) -> None:
    """Give the executors this library, as ``--py-files`` would; once a context.

    Functions that run in Python workers import it, and a worker has neither
    the driver's folder nor its import path."""
    sc = spark.sparkContext
    if not getattr(sc, "_shoppulse_shipped", False):
        package = os.path.dirname(os.path.abspath(__file__))
        base = os.path.join(sc._temp_dir, "shoppulse")  # the driver's own scratch; Spark serves the file to executors
        sc.addPyFile(shutil.make_archive(base, "zip", os.path.dirname(package), os.path.basename(package)))
        sc._shoppulse_shipped = True


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared folder (survives executor loss)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, read_as=None) -> DataFrame:
    """Write ``df`` as Parquet below the shared checkpoint folder and read it back.

    Like a reliable checkpoint, but column-pruned on reading; the files
    survive the loss of any executor, and what a partition numbered itself
    (ids, places) is fixed once it is written.  ``read_as`` is a schema of the
    same stored form, such as vectors written as their parts."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/written-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(read_as or df.schema).parquet(path)


#: For tables that hold large rows: small batches between the JVM and Python, whose
#: buffers both keep, and no shuffle files once a table is written, which would stay
#: until the driver's heap is collected.
FRUGAL_CONF = {
    "spark.sql.execution.arrow.maxBytesPerBatch": "8m",
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}


@contextlib.contextmanager
def frugal(spark: SparkSession):
    """``FRUGAL_CONF`` holds for the jobs that are started in here."""
    before = {k: spark.conf.get(k, None) for k in FRUGAL_CONF}
    try:
        for k, v in FRUGAL_CONF.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def broadcast_if_small(df: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """Broadcast ``df`` only after proving it has at most ``max_rows`` rows.

    The proof is a bounded action (``limit(max_rows + 1).count()``); beyond
    the bound the plain DataFrame is returned and AQE picks a shuffle join.
    """
    n = df.limit(max_rows + 1).count()
    return F.broadcast(df) if n <= max_rows else df


def spread(df: DataFrame, key: str | None = None, min_partitions: int | None = None) -> DataFrame:
    """Make sure CPU-heavy row work (regexes over long texts) runs on every
    core: when the input has fewer partitions than the cluster's default
    parallelism (e.g. one large file with a single row group), hash-spread the
    rows on ``key`` (deterministic on retry) before the heavy projection.
    Inputs that already have enough splits -- the normal case on a cluster --
    are returned unchanged, so no shuffle is added there.

    Without ``key`` the rows are spread round-robin (Spark sorts each input
    partition first, so a retried task sends the same rows to the same
    place).  The number of splits is read off the plan, or estimated from its
    files and their sizes, so no stage runs to find it out.  Round-robin does not satisfy a later ``groupBy``'s distribution,
    so that aggregation keeps its own exchange, which AQE can reuse when two
    branches of a plan aggregate the same tokens."""
    spark = df.sparkSession
    target = min_partitions or spark.sparkContext.defaultParallelism
    plan = df._jdf.queryExecution()
    known = plan.sparkPlan().outputPartitioning().numPartitions()  # 0: a scan, not planned yet
    if not known:
        files = len(df.inputFiles())
        split = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
        known = max(files, int(str(plan.optimizedPlan().stats().sizeInBytes())) // split) if files else target
    if known >= target:
        return df
    return df.repartition(target, key) if key else df.repartition(target)
