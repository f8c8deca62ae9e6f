"""Session helpers: tables, shipping the package to executors, and the checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Give this package to the executors, once for each application, so that they can import it."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    _SHIPPED.add(app)
    top = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="lathe-"), "lathe.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("lathe", os.path.relpath(full, top)))
    spark.sparkContext.addPyFile(path)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """The shared folder that spark.checkpoint.dir names; one of our own only on a single machine that names none."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="lathe-checkpoint-")
    context.setCheckpointDir(folder)


def release(spark: SparkSession) -> None:
    """Has the driver collect what no plan refers to any more; Spark's cleaner then deletes its shuffle files."""
    spark.sparkContext._jvm.System.gc()


def checkpointed(df: DataFrame) -> DataFrame:
    """`df` cut from its lineage, in the cluster's checkpoint folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()
