"""Intermediate tables in the folder that all executors share, and the library itself on executors.

A written table cuts the lineage: if an executor is lost later on, its tasks
read the files again instead of running the whole plan before them.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

PACKAGE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def ship(spark: SparkSession) -> None:
    """Gives the Python workers of all executors this package, once per application; Spark sends the archive."""
    context = spark.sparkContext
    if getattr(context, "_driftwood_shipped", False):
        return
    archive = os.path.join(tempfile.mkdtemp(prefix="spark-driftwood-code-"), "driftwood.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(PACKAGE):
            for name in names:
                if name.endswith(".py"):
                    file = os.path.join(folder, name)
                    z.write(file, os.path.relpath(file, os.path.dirname(PACKAGE)))
    context.addPyFile(archive)
    context._driftwood_shipped = True


def shipped(df: DataFrame) -> DataFrame:
    """``df``, after its application has got this package; for operators whose Python code runs on executors."""
    ship(df.sparkSession)
    return df


def shared_dir(spark: SparkSession) -> str:
    """This application's folder below the cluster's ``spark.checkpoint.dir``.

    Only a local session may run without that setting; it gets a temporary
    folder, which is remembered in the session.
    """
    ship(spark)
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-driftwood-")
        spark.conf.set("spark.checkpoint.dir", path)
    return f"{path.rstrip('/')}/driftwood-{spark.sparkContext.applicationId}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back, with its schema."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def discard(table: DataFrame) -> None:
    """Removes the files of a table from ``written``; nothing may read it any more."""
    spark = table.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(table._written_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def clear(spark: SparkSession) -> None:
    """Removes what this application has written to the shared folder; call it when all results are saved."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
