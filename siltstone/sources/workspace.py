"""Intermediate tables in the shared folder that the cluster names.

They are written as Parquet and read back, so a lost executor costs a retry of single
tasks and never the lineage.  All of an application's lie in one folder, which
:func:`clear` deletes when its results have been used.
"""

from __future__ import annotations

import os
import sys
import tempfile
import uuid
import warnings
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or the checkpoint folder of the context; a private folder
    only where neither is set, as in tests, with a warning unless Spark runs locally."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        if not spark.sparkContext.master.startswith("local"):
            warnings.warn("set spark.checkpoint.dir to a folder that all executors share", stacklevel=2)
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="siltstone-"))
        current = spark.sparkContext.getCheckpointDir()
    return current.rstrip("/")


def own_dir(spark: SparkSession) -> str:
    """The folder of this application."""
    return f"{shared_dir(spark)}/siltstone-{spark.sparkContext.applicationId}"


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the application's folder."""
    return f"{own_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back."""
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application; DataFrames that read them end."""
    path = spark._jvm.org.apache.hadoop.fs.Path(own_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def ship(spark: SparkSession) -> None:
    """Make this package importable on the executors: nothing to do where PYTHONPATH (or
    an installed package) has it; else it goes there as a zip file, once a session."""
    package = Path(__file__).resolve().parents[1]
    root = package.parent
    listed = {os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    context = spark.sparkContext
    if str(root) in listed or root.name in ("site-packages", "dist-packages") or getattr(context, "_siltstone_shipped", False):
        return
    target = Path(tempfile.mkdtemp(prefix="siltstone-zip-")) / f"{package.name}.zip"
    with zipfile.ZipFile(target, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(root))
    before = list(sys.path)
    context.addPyFile(str(target))
    sys.path[:] = before
    context._siltstone_shipped = True
