"""Global ranks and running sums without a window over all rows in one task.

Rows are dealt into buckets that keep the order; the sums of the buckets (a few thousand rows) are
added up, and each row's place is its bucket's offset plus its place within the bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def global_rank(df: DataFrame, key: Column, tie: Sequence[str], within: Sequence[str] = (), out: str = "rank") -> DataFrame:
    """`df` with the 1-based rank of each row by a hexadecimal hash `key` (then `tie`), in each group of `within`."""
    hashed = df.withColumn("_key", key).withColumn("_bucket", F.substring("_key", 1, 3))
    groups = [*within, "_bucket"]
    sums = hashed.groupBy(*groups).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*(within or [F.lit(0)])).orderBy("_bucket")  # 4096 rows of each group at most
    offsets = sums.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(groups)], (F.sum("_n").over(before) - F.col("_n")).alias("_offset"))
    ranked = hashed.withColumn("_place", F.row_number().over(Window.partitionBy(*groups).orderBy("_key", *tie)))
    return ranked.join(offsets, _same(groups)).withColumn(out, (F.col("_offset") + F.col("_place")).cast("long")).drop("_key", "_bucket", "_place", "_offset", *[f"_g{i}" for i in range(len(groups))])


def _same(groups: list[str]) -> Column:
    test = F.lit(True)
    for i, c in enumerate(groups):
        test = test & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    return test


def running_sums(df: DataFrame, order: str, values: Sequence[str], descending: bool = False, buckets: int = 256) -> DataFrame:
    """`df` with run_<v>, the sum of each value over the rows up to this one, by a numeric column."""
    edges = sorted(set(df.approxQuantile(order, [i / buckets for i in range(1, buckets)], 0.001)))
    bucket = F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]), lambda e: e <= F.col(order))) if edges else F.lit(0)
    dealt = df.withColumn("_bucket", bucket)
    sums = dealt.groupBy("_bucket").agg(*[F.sum(v).alias(f"_s_{v}") for v in values])
    by = F.col("_bucket").desc() if descending else F.col("_bucket")
    w = Window.partitionBy(F.lit(0)).orderBy(by)  # at most `buckets` rows
    offsets = sums.select("_bucket", *[(F.sum(f"_s_{v}").over(w) - F.col(f"_s_{v}")).alias(f"_o_{v}") for v in values])
    inner = Window.partitionBy("_bucket").orderBy(F.col(order).desc() if descending else F.col(order)).rowsBetween(Window.unboundedPreceding, 0)
    out = dealt.join(F.broadcast(offsets), "_bucket")
    return out.select("*", *[(F.col(f"_o_{v}") + F.sum(v).over(inner)).alias(f"run_{v}") for v in values]).drop("_bucket", *[f"_o_{v}" for v in values])
