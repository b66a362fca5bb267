"""Lineage cuts: tables written to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

OWN = "hardwood-tables"
_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """A folder in the cluster's ``spark.checkpoint.dir``.

    Where that is unset, a temporary folder of our own with a local master (driver and executors are one
    process there), else an error: a machine's own folder would lose the executors' files.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = _LOCAL.setdefault(spark.sparkContext.applicationId, None) or tempfile.mkdtemp(prefix="hardwood-")
        _LOCAL[spark.sparkContext.applicationId] = root
    return f"{root.rstrip('/')}/{OWN}"


CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, clean: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a lost executor costs a re-read, not a re-run.

    With ``clean`` Spark deletes the shuffle files of the plan as soon as it is written, not when the driver happens
    to collect its garbage.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN, None)
    if clean:
        spark.conf.set(CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        if clean:
            spark.conf.unset(CLEAN) if before is None else spark.conf.set(CLEAN, before)
    back = spark.read.schema(df.schema).parquet(path)
    back._hardwood_path = path
    return back


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of ours."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables made by :func:`materialize` that nothing will read again; other frames are left alone."""
    for df in tables:
        path = getattr(df, "_hardwood_path", None)
        if path:
            remove(df.sparkSession, path)
