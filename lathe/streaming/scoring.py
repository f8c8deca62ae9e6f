"""Scoring of streams: every scorer and fitted transformer is stateless, so it works on them as it is."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lathe.session import ensure_checkpoint_dir


def read_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The given table as a stream of its files."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def score_available(stream: DataFrame, score: Callable[[DataFrame], DataFrame], folder: str | None = None) -> DataFrame:
    """What a stateless scorer gives for all there is now, as a table of files.

    Rows and the query's progress are written below `folder`, by default a new one in the checkpoint
    folder. A query that is run again on the same folder goes on where it stopped, each row once.
    """
    spark = stream.sparkSession
    if folder is None:
        ensure_checkpoint_dir(spark)
        folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/scored-{uuid.uuid4().hex}"
    scored = score(stream)
    q = scored.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(scored.schema).parquet(f"{folder}/rows")
