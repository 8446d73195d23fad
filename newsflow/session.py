"""Session settings and the two places where lineage is cut."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Settings every job relies on. Sizes are left to AQE: the initial shuffle
# partition number is an upper bound that AQE coalesces to the advisory size.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.files.maxPartitionBytes": "128m",
    # Checkpoints of loops that are over are removed with their frames.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
}


def build_session(app: str = "newsflow", master: str | None = None, **extra: str) -> SparkSession:
    """A session with the settings above; ``extra`` keys use ``__`` for a dot."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application.

    Spark's file server hands the archive out, so that workers need neither the driver's
    folder nor its path.
    """
    context = spark.sparkContext
    if getattr(context, "_newsflow_shipped", False):
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="spark-")) / "newsflow.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._newsflow_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session (where
    driver and executors are one process) may fall back to a temporary folder.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        configured = tempfile.mkdtemp(prefix="spark-", dir=os.environ.get("TMPDIR", "/tmp"))
    context.setCheckpointDir(configured)
    return context.getCheckpointDir()


def new_folder(spark: SparkSession, name: str) -> str:
    """Path of a folder of this call's own in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def spread(df: DataFrame) -> DataFrame:
    """A scan with fewer partitions than cores, spread over all cores.

    For small tables in few files under work that is heavy per row. Large tables have more
    splits than the cluster has cores and pass unchanged, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def cut_lineage(df: DataFrame, tidy: bool = False) -> DataFrame:
    """Write ``df`` as a table in the shared folder and continue from the table.

    The table survives the loss of executors, is evaluated once, and is planned with its
    true size. (A checkpoint keeps the size estimated for its plan; in a loop of joins those
    estimates multiply every round until planning itself takes minutes.) Tables are kept
    in one folder per application, which can be removed when it has ended; :func:`drop_table` removes one before.

    ``tidy``: the shuffle files behind the table go as soon as it is written, and not when the driver happens to collect garbage.
    """
    spark = df.sparkSession
    root = shared_dir(spark).rstrip("/")
    path = f"{root}/tables-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    cleanup = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(cleanup)
    spark.conf.set(cleanup, "true" if tidy else before)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(cleanup, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.path = path
    return out


def cut_tidily(df: DataFrame) -> DataFrame:
    """:func:`cut_lineage` without the shuffle files behind the table, for steps whose files would add up to several times their input."""
    return cut_lineage(df, tidy=True)


def drop_table(df: DataFrame) -> None:
    """Delete a table of :func:`cut_lineage` that nothing reads any more."""
    path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df.path)
    path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def pin_partitions(df: DataFrame) -> DataFrame:
    """Reliable checkpoint of ``df``: evaluated once, partition ids stay as they are."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
