"""Session plumbing: the package on the executors, and tables in the folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Give the executors' Python this package, once per application, wherever the driver found it."""
    sc = spark.sparkContext
    if getattr(sc, "_docloom_shipped", False):
        return
    root = Path(__file__).resolve().parent
    path = os.path.join(tempfile.mkdtemp(prefix="docloom-"), "docloom.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for p in sorted(root.rglob("*.py")):
            out.write(p, p.relative_to(root.parent))
    sc.addPyFile(path)
    sc._docloom_shipped = True


def shipped(fn):
    """``fn``, once the active session's executors have this package."""
    spark = SparkSession.getActiveSession()
    if spark:
        ship(spark)
    return fn


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    A session in one process may be without: it gets a folder of its own. On a cluster that is an error,
    as executors don't see each other's local folders.
    """
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path and not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("Set spark.checkpoint.dir to a folder that the driver and all executors share.")
        sc.setCheckpointDir(path or tempfile.mkdtemp(prefix="docloom-"))
    return sc.getCheckpointDir()


#: Spark's own switch that deletes a query's shuffle files when it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settle(df: DataFrame, name: str = "t", by: list[str] | None = None, tidy: bool = False) -> DataFrame:
    """Write ``df`` as a Parquet table (a folder for each value of ``by``) in the shared folder and read it back.

    It cuts the lineage, so a lost executor costs a re-read and not a recomputation, and what made the
    rows runs once however often they are used. With ``tidy`` the shuffle files of the write go at its end,
    not when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    if tidy:
        spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path, partitionBy=by)
    finally:
        if tidy:
            spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)
