"""Frames of numeric columns with a row id: coercion, missing values, task detection, sampling.

NULL is the one missing value; NaN becomes NULL on the way in.
"""

from __future__ import annotations

import logging
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lathe.errors import ValidationError
from lathe.functions.ordered import global_rank
from lathe.functions.rng import order_key

MAX_CLASSES = 20
_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_NUMERIC = (*_WHOLE, T.FloatType, T.DoubleType, T.DecimalType, T.BooleanType)


def normalise(df: DataFrame, features: Sequence[str], coercion: str = "auto") -> DataFrame:
    """Features as doubles with NULL for NaN. coercion: auto, warn (log each cast) or error (no cast)."""
    if coercion not in ("auto", "warn", "error"):
        raise ValidationError(f"unknown coercion {coercion!r}")
    out = {}
    for c in features:
        kind = df.schema[c].dataType
        if not isinstance(kind, _NUMERIC):
            raise ValidationError(f"column {c!r} is {kind.simpleString()}, not numeric")
        if not isinstance(kind, T.DoubleType):
            if coercion == "error":
                raise ValidationError(f"column {c!r} is {kind.simpleString()}, not double")
            if coercion == "warn":
                logging.getLogger("lathe").warning("casting %s from %s", c, kind.simpleString())
        x = F.col(c).cast("double")
        out[c] = F.when(~F.isnan(x), x) if isinstance(kind, (T.FloatType, T.DoubleType)) else x
    return df.withColumns(out)


def validate_features(df: DataFrame, features: Sequence[str]) -> None:
    if not features:
        raise ValidationError("at least one feature is needed")
    if missing := [c for c in features if c not in df.columns]:
        raise ValidationError(f"no columns {missing}")


def detect_task(df: DataFrame, y: str) -> str:
    """Whole-number types are classes; other numbers are, too, if whole and of at most 20 kinds."""
    if isinstance(df.schema[y].dataType, (*_WHOLE, T.BooleanType, T.StringType)):
        return "classification"
    row = df.agg(F.max((F.col(y) != F.floor(y)).cast("int")).alias("broken"), F.count_distinct(y).alias("kinds")).first()
    if row["broken"] is None:
        raise ValidationError("a task can't be told from no labels")
    return "regression" if row["broken"] or row["kinds"] > MAX_CLASSES else "classification"


def classes_of(df: DataFrame, y: str) -> list:
    return sorted(r[0] for r in df.select(y).where(F.col(y).isNotNull()).distinct().collect())


def k_fold(df: DataFrame, row_id: str, k: int, seed: int = 42, out: str = "fold") -> DataFrame:
    """Folds 0 to k-1 whose sizes differ by one at most, the first ones larger."""
    n = df.count()
    if k < 2 or n < k:
        raise ValidationError(f"{k} folds of {n} rows")
    size, extra = divmod(n, k)
    ranked = global_rank(df, order_key(F.col(row_id), seed), [row_id], out="_rank")
    r = F.col("_rank") - 1
    fold = F.when(r < extra * (size + 1), F.floor(r / (size + 1))).otherwise(extra + F.floor((r - extra * (size + 1)) / size))
    return ranked.withColumn(out, fold.cast("int")).drop("_rank")


def stratified_k_fold(df: DataFrame, row_id: str, y: str, k: int, seed: int = 42, out: str = "fold") -> DataFrame:
    """Each class dealt in turn to folds 0 to k-1."""
    if k < 2:
        raise ValidationError(f"{k} folds")
    ranked = global_rank(df, order_key(F.col(row_id), seed), [row_id], within=[y], out="_rank")
    return ranked.withColumn(out, F.pmod(F.col("_rank") - 1, F.lit(k)).cast("int")).drop("_rank")


def repeated_k_fold(df: DataFrame, row_id: str, k: int, repeats: int, seed: int = 42) -> DataFrame:
    """Rows for each repeat r, with folds of seed + r."""
    parts = [k_fold(df, row_id, k, seed + r).withColumn("repeat", F.lit(r)) for r in range(repeats)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def train_test_split(df: DataFrame, row_id: str, test_size: float = 0.2, seed: int = 42, out: str = "is_test") -> DataFrame:
    """The last max(1, round(n * test_size)) rows in hash order are the test rows."""
    n = df.count()
    test = max(1, int(n * test_size + 0.5))
    if n < 2 or n - test < 1:
        raise ValidationError(f"{n} rows can't be split into train and test rows")
    return global_rank(df, order_key(F.col(row_id), seed), [row_id], out="_rank").withColumn(out, F.col("_rank") > n - test).drop("_rank")


def subsample(df: DataFrame, row_id: str, fraction: float, seed: int = 42, *more: Column) -> DataFrame:
    """max(1, ceil(n * fraction)) rows, first in hash order."""
    n = df.count()
    keep = max(1, -(-int(round(n * fraction * 1_000_000)) // 1_000_000))
    return global_rank(df, order_key(F.col(row_id), seed, *more), [row_id], out="_rank").where(F.col("_rank") <= keep).drop("_rank")


def train_rows(df: DataFrame, fold: int, column: str = "fold") -> DataFrame:
    return df.where(F.col(column) != fold)


def test_rows(df: DataFrame, fold: int, column: str = "fold") -> DataFrame:
    return df.where(F.col(column) == fold)
