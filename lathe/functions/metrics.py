"""Metrics as aggregations: each takes a frame and column names and gives one row (or a small table).

Columns y and p are of one row, so lengths always agree; an empty frame raises in `score`, where a
number is wanted. Ratios with a zero denominator are 0.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lathe.errors import ValidationError
from lathe.functions.ordered import running_sums


def ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def accuracy(y: str, p: str) -> Column:
    return F.avg((F.col(y) == F.col(p)).cast("double"))


def mse(y: str, p: str) -> Column:
    return F.avg(F.pow(F.col(y) - F.col(p), 2))


def mae(y: str, p: str) -> Column:
    return F.avg(F.abs(F.col(y) - F.col(p)))


def r2(y: str, p: str) -> Column:
    """1 - residual over total sum of squares; 0 where y is constant."""
    total = F.var_pop(y)
    return F.when(total == 0, F.lit(0.0)).otherwise(1 - mse(y, p) / total)


def log_loss(p_true: Column, eps: float = 1e-15) -> Column:
    """Mean of -ln of the probability of the true class, clipped on both sides."""
    return F.avg(-F.log(F.greatest(F.lit(eps), F.least(F.lit(1 - eps), p_true))))


#: Scorers by name: (y, p) -> aggregate Column; larger is better.
SCORERS: dict[str, Callable[[str, str], Column]] = {
    "accuracy": accuracy,
    "r2": r2,
    "neg_mse": lambda y, p: -mse(y, p),
    "neg_mae": lambda y, p: -mae(y, p),
    "neg_logloss": lambda y, p: -log_loss(F.col(p)),
}


def scorer(name) -> Callable[[str, str], Column]:
    """A scorer by name, or the callable given."""
    if callable(name):
        return name
    if name not in SCORERS:
        raise ValidationError(f"unknown scorer {name!r}; there are {', '.join(sorted(SCORERS))}")
    return SCORERS[name]


def score(df: DataFrame, y: str, p: str, name="accuracy") -> float:
    row = df.agg(scorer(name)(y, p).alias("s"), F.count(F.lit(1)).alias("n")).first()
    if not row["n"]:
        raise ValidationError("a metric of no rows")
    return float(row["s"])


def label_union(df: DataFrame, y: str, p: str) -> DataFrame:
    """Sorted-able distinct labels, true or predicted (aggregated before the union, so it is small)."""
    return df.select(F.col(y).alias("label")).distinct().union(df.select(F.col(p).alias("label")).distinct()).distinct()


def confusion_matrix(df: DataFrame, y: str, p: str) -> DataFrame:
    """(truth, predicted, n) for all pairs of labels, 0 where none."""
    labels = label_union(df, y, p)
    grid = labels.select(F.col("label").alias("truth")).crossJoin(labels.select(F.col("label").alias("predicted")))
    counts = df.groupBy(F.col(y).alias("truth"), F.col(p).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))
    return grid.join(counts, ["truth", "predicted"], "left").select("truth", "predicted", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def class_counts(df: DataFrame, y: str, p: str) -> DataFrame:
    """(label, tp, fp, fn) for every label, true or predicted."""
    pairs = df.groupBy(F.col(y).alias("_y"), F.col(p).alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    hit = (F.col("_y") == F.col("_p")).cast("long") * F.col("_n")
    miss = (F.col("_y") != F.col("_p")).cast("long") * F.col("_n")
    zero = F.lit(0).cast("long")
    sides = pairs.select(F.explode(F.array(F.struct(F.col("_y").alias("label"), hit.alias("tp"), zero.alias("fp"), miss.alias("fn")), F.struct(F.col("_p").alias("label"), zero.alias("tp"), miss.alias("fp"), zero.alias("fn")))).alias("x")).select("x.*")
    return sides.groupBy("label").agg(*[F.sum(c).cast("long").alias(c) for c in ("tp", "fp", "fn")])


def precision_recall_f1(df: DataFrame, y: str, p: str, average: str = "binary") -> DataFrame:
    """One row of precision, recall and f1: binary (of the larger label), micro or macro."""
    if average not in ("binary", "micro", "macro"):
        raise ValidationError(f"unknown average {average!r}")
    counts = class_counts(df, y, p)
    each = counts.select("label", "tp", "fp", "fn", ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"))
    each = each.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    if average == "macro":
        return each.agg(*[F.avg(c).alias(c) for c in ("precision", "recall", "f1")])
    if average == "micro":
        tp, fp, fn = (F.sum(c) for c in ("tp", "fp", "fn"))
        a, b = ratio(tp, tp + fp), ratio(tp, tp + fn)
        return counts.agg(a.alias("precision"), b.alias("recall"), ratio(2 * a * b, a + b).alias("f1"))
    if counts.count() > 2:
        raise ValidationError("average='binary' of more than two classes; choose micro or macro")
    return each.agg(*[F.max_by(c, "label").alias(c) for c in ("precision", "recall", "f1")])


def roc_auc(df: DataFrame, y: str, score_col: str) -> DataFrame:
    """One row `auc`: area under the curve of the larger of two labels; tied scores are one step."""
    ends = df.agg(F.min(y).alias("lo"), F.max(y).alias("hi"), F.count_distinct(y).alias("k")).first()
    if ends["k"] != 2:
        raise ValidationError(f"an AUC needs two classes; there are {ends['k']}")
    steps = df.groupBy(F.col(score_col).cast("double").alias("s")).agg(F.sum((F.col(y) == F.lit(ends["hi"])).cast("double")).alias("pos"), F.sum((F.col(y) == F.lit(ends["lo"])).cast("double")).alias("neg"))
    run = running_sums(steps, "s", ["pos"], descending=True)
    area = F.sum(F.col("neg") * (F.col("run_pos") - F.col("pos") / 2))
    return run.agg((area / (F.sum("pos") * F.sum("neg"))).alias("auc"))


def balanced_class_weights(df: DataFrame, y: str) -> DataFrame:
    """(label, weight): rows / (classes * rows of the class)."""
    counts = df.where(F.col(y).isNotNull()).groupBy(F.col(y).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("t"), F.count(F.lit(1)).alias("k"))
    return counts.crossJoin(total).select("label", (F.col("t") / (F.col("k") * F.col("n"))).alias("weight"))


def mean_and_std(scores: Column) -> tuple[Column, Column]:
    """Mean and population standard deviation of an array of scores."""
    n = F.size(scores).cast("double")
    mean = F.aggregate(scores, F.lit(0.0), lambda a, x: a + x) / n
    return mean, F.sqrt(F.aggregate(F.transform(scores, lambda x: F.pow(x - mean, 2)), F.lit(0.0), lambda a, x: a + x) / n)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
