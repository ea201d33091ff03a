"""Lineage cuts that survive lost executors: written tables in the folder that the cluster shares.

All tables of an application stand in one folder, which its driver deletes when it ends; iterative operators give back
a round's table as soon as its successor is written.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of this machine only where that is unset and all of Spark runs on it."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    master = spark.sparkContext.master
    if not known and not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return known or tempfile.gettempdir()


def _folder(spark: SparkSession, path: str):
    """The path and its file system, as the JVM sees them."""
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return there, there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def own_dir(spark: SparkSession) -> str:
    """This application's folder in the shared one."""
    sc = spark.sparkContext
    if not hasattr(sc, "_tessera_dir"):
        path = f"{shared_dir(spark).rstrip('/')}/tessera-{sc.applicationId}-{uuid.uuid4().hex[:8]}"
        folder, store = _folder(spark, path)
        store.mkdirs(folder)
        store.deleteOnExit(folder)
        sc._tessera_dir = path
    return sc._tessera_dir


def cut(df: DataFrame, *done: DataFrame | None) -> DataFrame:
    """df, written and read again. Tables that cut() gave before and that nothing reads any more can be handed back."""
    path = f"{own_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._tessera_path = path
    release(*done)
    return table


def release(*done: DataFrame | None) -> None:
    """Deletes tables that cut() gave."""
    for table in done:
        if table is not None and hasattr(table, "_tessera_path"):
            folder, store = _folder(table.sparkSession, table._tessera_path)
            store.delete(folder, True)
