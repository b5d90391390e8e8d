"""Session helpers: code for executors, scratch tables in the shared folder."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

PACKAGE = os.path.dirname(os.path.abspath(__file__))
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ship(spark: SparkSession) -> None:
    """Give executors this package, once per application, wherever the driver found it."""
    context = spark.sparkContext
    if getattr(context, "_tierspan_shipped", False):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="tierspan-"), "tierspan_src.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, names in os.walk(PACKAGE):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(PACKAGE)))
    context.addPyFile(path)
    context._tierspan_shipped = True


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for scratch tables: spark.checkpoint.dir, or where it is unset, on one machine, a folder of our own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = f"file:///tmp/checkpoints/{os.getpid()}"
        spark.sparkContext.setCheckpointDir(base)
    if "://" not in base and not base.startswith("file:"):
        base = f"file://{base}" if base.startswith("/") else base
    return base.rstrip("/")


_CLEANED: set[str] = set()


def _remove_at_exit(spark: SparkSession, folder: str) -> None:
    if folder in _CLEANED:
        return
    _CLEANED.add(folder)

    def remove() -> None:
        try:
            jvm = spark.sparkContext._jvm
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # the session may be gone already; scratch tables are then left to the folder's owner
            pass

    atexit.register(remove)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, removed when the application ends."""
    folder = f"{scratch_root(spark)}/tierspan-{spark.sparkContext.applicationId}"
    _remove_at_exit(spark, folder)
    return f"{folder}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write `df` as a scratch Parquet table in the shared folder and read it back: cuts lineage, survives executors.

    What was shuffled for it isn't needed once it is written, so those files go at once instead of with the driver's garbage.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)
