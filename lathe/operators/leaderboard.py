"""Candidates' scores, ranked: a table of (candidate, model, params, scores, mean, std, rank)."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lathe.functions.metrics import mean_and_std

SCHEMA = "id long, model string, params string, scores array<double>, fit_time_ms double"


def board(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, SCHEMA)


def ranked(results: DataFrame) -> DataFrame:
    """With mean_score, std_score (population) and rank; equal means rank by id. Failed ones come last.

    A leaderboard has a row for each candidate tried, so one task ranks it.
    """
    mean, std = mean_and_std(F.col("scores"))
    scored = results.withColumn("mean_score", F.when(F.size("scores") > 0, mean)).withColumn("std_score", F.when(F.size("scores") > 0, std))
    return scored.withColumn("rank", F.row_number().over(Window.orderBy(F.col("mean_score").desc_nulls_last(), "id")))


def top(results: DataFrame, k: int) -> DataFrame:
    return ranked(results).orderBy("rank").limit(k)


def best_per_family(board_: DataFrame, n: int = 2) -> DataFrame:
    """The first n ranked rows of each model, with their place in the family."""
    return board_.withColumn("place", F.row_number().over(Window.partitionBy("model").orderBy("rank"))).where(F.col("place") <= n)


def ensemble_pool(board_: DataFrame, size: int) -> DataFrame:
    """Families' best by rank, then seconds by rank, at most 2 * size."""
    return best_per_family(board_).orderBy("place", "rank").limit(2 * size)


def survivors(board_: DataFrame, factor: int) -> DataFrame:
    """The first max(1, ceil(n / factor)) by rank."""
    n = board_.count()
    return board_.where(F.col("rank") <= max(1, -(-n // factor)))


def to_json(board_: DataFrame) -> str:
    return json.dumps([r.asDict(True) for r in board_.orderBy("id").collect()])


def from_json(spark: SparkSession, text: str) -> DataFrame:
    rows = json.loads(text)
    return board(spark, [(r["id"], r["model"], r["params"], r["scores"], r["fit_time_ms"]) for r in rows])
