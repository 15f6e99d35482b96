"""Session helpers: a tuned builder and the shared folder that stages write to."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "countwatch", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on and UTC time; ``conf`` wins over defaults."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        # Object aggregates (collect_set per report) stay hash based for longer before sorting.
        "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "4096",
        # Stream state lives off the heap, so it may outgrow an executor's memory.
        "spark.sql.streaming.stateStore.providerClass": (
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
        ),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        **conf,
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application.

    The workers unpickle task functions by importing their module, and on a cluster (or when the
    caller's working folder is elsewhere) they cannot see the driver's ``sys.path``.
    """
    context = spark.sparkContext
    if getattr(context, "_countwatch_shipped", False):
        return
    package = os.path.dirname(os.path.abspath(__file__))
    if os.path.isdir(package):
        into = os.path.join(tempfile.mkdtemp(prefix="countwatch-ship-"), "countwatch_package")
        archive = shutil.make_archive(into, "zip", os.path.dirname(package), os.path.basename(package))
        context.addPyFile(archive)
    context._countwatch_shipped = True


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh path under the cluster's checkpoint folder, removed when this application ends.

    ``spark.checkpoint.dir`` names the shared folder. Only a session on one machine (tests, a
    laptop) may do without: there a temporary folder serves. On any other master each executor
    would write to its own disk, so the setting is asked for instead.
    """
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all executors share (master {context.master})")
        base = getattr(context, "_countwatch_folder", None) or tempfile.mkdtemp(prefix="countwatch-")
        context._countwatch_folder = base
    own = f"{base.rstrip('/')}/countwatch-{context.applicationId}"
    if getattr(context, "_countwatch_own", None) != own:
        context._countwatch_own = own
        atexit.register(remove, spark, own)
    return f"{own}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that ``stage`` wrote, in whatever store it lies; a stopped session keeps it."""
    try:
        jvm = spark.sparkContext._jvm
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    except Exception:  # the session is gone: nothing can be reached any more
        return


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Used where an expensive scan has been reduced to a smaller table that several consumers need:
    the scan then runs once, the lineage is cut in storage that outlives an executor, and the
    planner sees the true size on disk.
    """
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.mode("overwrite").parquet(path)
    staged = spark.read.schema(df.schema).parquet(path)
    staged._countwatch_stage = path
    return staged


def unstage(staged: DataFrame) -> None:
    """Delete what ``stage`` wrote, once nothing reads it any more: a loop's last round, when the next is written."""
    path = getattr(staged, "_countwatch_stage", None)
    if path:
        remove(staged.sparkSession, path)
