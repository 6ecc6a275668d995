"""Session defaults shared by every lakelens entry point."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Whole texts go to Python workers: batches are bounded in rows and in bytes.
TEXT_BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "500", "spark.sql.execution.arrow.maxBytesPerBatch": "16m"}
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.inferTimestampNTZ.enabled": "false",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    **TEXT_BATCHES,
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def build_session(master: str | None = None, app: str = "lakelens", **conf: str) -> SparkSession:
    """A session with the engine's defaults; ``conf`` wins over them, cluster settings stay untouched."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> None:
    """Make a session that was built elsewhere fit for registered queries: the package on workers, batches for texts."""
    ship_package(spark)
    for key, value in TEXT_BATCHES.items():
        spark.conf.set(key, value)


def is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder the cluster names; a temporary one only in local mode, and removed with the session."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None:
        if named is None:
            if not is_local(spark):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            named = tempfile.mkdtemp(prefix="lakelens-checkpoint-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        context.setCheckpointDir(named)
    return context.getCheckpointDir()


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one for tables that a query writes and rereads; removed when the session's JVM ends."""
    folder = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    return folder


def ship_package(spark: SparkSession) -> None:
    """Send the package to Python workers that would not find it by their path; once for each session."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if root in map(os.path.abspath, [os.getcwd(), *filter(None, os.environ.get("PYTHONPATH", "").split(os.pathsep))]):
        return
    context = spark.sparkContext
    if getattr(context, "_lakelens_shipped", False):
        return
    # the driver serves the archive for as long as the session lives
    context.addPyFile(shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="lakelens-package-"), "lakelens"), "zip", root, "lakelens"))
    context._lakelens_shipped = True


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt to all cores where an input has fewer partitions than there are cores, as a small file has; else ``df``."""
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and go on from the written copy."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()
