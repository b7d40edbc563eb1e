"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, app: str = "codegauge", **conf: str) -> SparkSession:
    """A session with the settings the operators rely on (UTC, adaptive plans)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        # do not record a call site for every column: wide rule lists are then planned several times faster
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        # generated methods above 8000 bytes are never compiled by the JVM; wide rule lists then run faster unfused
        "spark.sql.codegen.hugeMethodLimit": "8000",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach: ``spark.checkpoint.dir``.

    Only where the cluster names none (a local test session) a temporary folder is set.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        named = tempfile.mkdtemp(prefix="run-codegauge-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(named)
    return named


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for one run below this application's part of the shared folder."""
    return f"{_own_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/codegauge/{spark.sparkContext.applicationId}"


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder below the shared one, in whatever store it is."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def clear_scratch(spark: SparkSession) -> None:
    """Delete all that this application has staged: call it when the results that read from it are stored."""
    drop_path(spark, _own_dir(spark))


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a columnar table in the shared folder and read it back.

    Cuts lineage in a way that survives lost executors, lets every later branch read only its own
    columns, and makes several consumers share one evaluation.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(scan: DataFrame, key: str) -> DataFrame:
    """A plain table scan over at least as many tasks as the cluster runs at once, for work bound by CPU.

    A table of whole texts has more splits than that already if it is large and is left as it is; only a small one, read as a
    few splits, is shuffled.  Meant for scans: asking a plan with joins for its partitions would run them.
    """
    slots = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(slots, key) if scan.rdd.getNumPartitions() < slots else scan


ROWS_PER_TASK = 10_000


def spread_rows(scan: DataFrame, rows: int = ROWS_PER_TASK) -> DataFrame:
    """A scan of keys alone, each of which stands for much work, dealt out over tasks of at most about ``rows`` rows.

    Such a scan is too small in bytes for its splits to tell the work, and the cores that have reported so far may be
    few.  The rows are counted (from the footers of the files) and dealt out in turn, so repeated and null keys spread as well.
    """
    slots = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(max(slots, -(-scan.count() // rows)))
