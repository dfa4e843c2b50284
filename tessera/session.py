"""Session helpers shared by all operators: table access, shared storage, lineage cuts."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes of an Arrow batch handed to Python. Texts may be long, so batches stay small.
ARROW_ROWS, ARROW_BYTES = 256, 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` under `sf_dir`, which may be any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir.

    Only where that setting is absent in a local run, as in tests, is a temporary folder made.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not path:
        known = sc._jsc.sc().getCheckpointDir()
        path = known.get() if known.isDefined() else None
    if not path:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="tessera-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(path)
    return path.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/tessera/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Computes `df` once and cuts its lineage with a checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Estimated bytes of a task's part, where rows are sorted or joined by key.
PART_BYTES = 16 << 20


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deals rows by key to tasks in number proportional to the plan's estimated size, so that a task's part is bounded.

    The engine joins small shuffle partitions by their compressed bytes, and so gave a task millions of like rows to sort.
    Small inputs, and those that the plan knows no size of, stay as they are.
    """
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    parts = -(-size // PART_BYTES)
    if parts <= df.sparkSession.sparkContext.defaultParallelism or size >= 1 << 60:
        return df
    return df.repartition(min(parts, 20_000), *keys)


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, unless they find it on their path as the driver does."""
    home = Path(__file__).resolve().parent
    known = [*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd()]
    sc = spark.sparkContext
    if str(home.parent) in known or getattr(sc, "_tessera_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="tessera-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    sc.addPyFile(shutil.make_archive(f"{folder}/tessera", "zip", home.parent, home.name))
    sc._tessera_shipped = True


def trim() -> None:
    """Gives freed memory back to the system: Python workers stay after their tasks, beside the next ones."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def small_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Makes Python workers ready: the package, and few rows in an Arrow batch, so that long texts fit."""
    ship(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) != rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
