"""Session helpers: lineage cuts and table reads."""

from __future__ import annotations

import atexit
import gc
import os
import shutil
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the session's ``spark.checkpoint.dir``; make one only for local masters that name none."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        sc.setCheckpointDir(named)
    elif sc.master.startswith("local[") or sc.master == "local":
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="graphwright-ckpt-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and go on from its files.

    The files survive lost executors.  Unlike ``DataFrame.checkpoint`` the
    result has table statistics and carries no constraints of the plan before
    it, which would grow with every round of an iteration.  They are removed
    when the process ends.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append(path)
    _collect_garbage(spark)
    return spark.read.schema(df.schema).parquet(path)


#: Seconds between two collections of the driver's garbage.
COLLECT_S = 5.0
_collected = time.monotonic()


def _collect_garbage(spark: SparkSession) -> None:
    """Free the plans and shuffle files of ended jobs.

    Spark removes them only when the driver's collector happens to find them
    unreachable, by default forced every 30 minutes: until then a long iteration
    fills the driver's heap with plans and the disks with shuffle files.
    """
    global _collected
    if time.monotonic() - _collected >= COLLECT_S:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        _collected = time.monotonic()


_WRITTEN: list[str] = []


@atexit.register
def _remove_written() -> None:
    for path in _WRITTEN:
        if path.startswith(("file:", "/")):
            shutil.rmtree("/" + path.removeprefix("file:").lstrip("/"), ignore_errors=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data directory."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
