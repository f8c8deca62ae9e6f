"""Ensembles over long tables of predictions (row_id, model, class, p) and the driver's weight search."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lathe.errors import ValidationError
from lathe.session import checkpointed


def argmax_label(long: DataFrame, row_id: str = "row_id", p: str = "p", label: str = "label") -> DataFrame:
    """(row_id, prediction): the label of largest p, the smallest of equal ones."""
    return long.groupBy(row_id).agg(F.min(F.struct((-F.col(p)).alias("p"), F.col(label).alias("l")))["l"].alias("prediction"))


def soft_vote(long: DataFrame, weights: dict[str, float] | None = None, row_id: str = "row_id") -> DataFrame:
    """(row_id, label, p): the weighted sum of the models' probabilities; equal weights by default."""
    return long.withColumn("_w", _weight(long, weights)).groupBy(row_id, "label").agg(F.sum(F.col("_w") * F.col("p")).alias("p"))


def hard_vote(long: DataFrame, weights: dict[str, float] | None = None, row_id: str = "row_id") -> DataFrame:
    """(row_id, prediction): the label with the largest sum of weights of (row_id, model, label) votes."""
    votes = long.withColumn("_w", _weight(long, weights)).groupBy(row_id, "label").agg(F.sum("_w").alias("p"))
    return argmax_label(votes.withColumn("p", F.round("p", 9)), row_id)


def regression_vote(long: DataFrame, weights: dict[str, float] | None = None, row_id: str = "row_id") -> DataFrame:
    """(row_id, prediction): the weighted sum of predictions; the weights are taken as they are."""
    return long.withColumn("_w", _weight(long, weights)).groupBy(row_id).agg(F.sum(F.col("_w") * F.col("prediction")).alias("prediction"))


def _weight(long: DataFrame, weights: dict[str, float] | None):
    if weights is None:
        names = [r[0] for r in long.select("model").distinct().collect()]
        weights = {m: 1 / len(names) for m in names}
    out = F.lit(0.0)
    for m, w in weights.items():
        out = F.when(F.col("model") == m, F.lit(float(w))).otherwise(out)
    return out


def average_out_of_fold(long: DataFrame, row_id: str = "row_id") -> DataFrame:
    """(row_id, label, p): the mean over repeats."""
    return long.groupBy(row_id, "label").agg(F.avg("p").alias("p"))


def meta_features(long: DataFrame, models: Sequence[str], labels: Sequence, row_id: str = "row_id") -> DataFrame:
    """One row for each row_id, a column for each model and class (model first), 0 where there is no p."""
    cells = [F.coalesce(F.max(F.when((F.col("model") == m) & (F.col("label") == c), F.col("p"))), F.lit(0.0)).alias(f"{m}_{c}") for m in models for c in labels]
    return long.groupBy(row_id).agg(*cells)


def disagreement(predictions: DataFrame, task: str = "classification", row_id: str = "row_id") -> DataFrame:
    """(a, b, disagreement) of each pair of models.

    Classification: the share of rows on which the predictions differ; regression: 1 - |correlation|,
    and 1 where a model is constant.
    """
    other = predictions.select(F.col(row_id), F.col("model").alias("b"), F.col("prediction").alias("_q"))
    pairs = predictions.select(F.col(row_id), F.col("model").alias("a"), F.col("prediction").alias("_p")).join(other, row_id).where("a < b").groupBy("a", "b")
    if task == "classification":
        return pairs.agg(F.avg((F.col("_p") != F.col("_q")).cast("double")).alias("disagreement"))
    spread = F.stddev_pop("_p") * F.stddev_pop("_q")
    return pairs.agg(F.when(spread < 1e-12, 1.0).otherwise(1 - F.abs(F.covar_pop("_p", "_q") / spread)).alias("disagreement"))


def diversity_filter(order: Sequence[str], apart: dict[frozenset, float], threshold: float = 0.05) -> list[str]:
    """Models in order, each at least `threshold` from all kept; two at least stay."""
    if len(order) <= 2 or threshold <= 0:
        return list(order)
    kept = [order[0]]
    for m in order[1:]:
        if all(apart[frozenset((m, x))] >= threshold for x in kept):
            kept.append(m)
    if len(kept) < 2:
        kept.append(order[1])
    return kept


def project_simplex(v) -> np.ndarray:
    """The nearest point with no negative part and sum 1."""
    v = np.asarray(v, dtype=np.float64)
    if not len(v):
        return v
    down = np.sort(v)[::-1]
    over = (np.cumsum(down) - 1) / np.arange(1, len(v) + 1)
    good = np.flatnonzero(down > over)
    return np.maximum(v - over[good[-1]], 0) if len(good) else np.full(len(v), 1 / len(v))


def project_simplex_frame(df: DataFrame, group: str, item: str, value: str) -> DataFrame:
    """(group, item, weight): each group's values projected onto the simplex, by windows."""
    w = Window.partitionBy(group).orderBy(F.col(value).desc(), item)
    run = df.select(group, item, value, F.row_number().over(w).alias("_k"), F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("_s"))
    run = run.withColumn("_over", (F.col("_s") - 1) / F.col("_k"))
    theta = F.max_by(F.when(F.col(value) > F.col("_over"), F.col("_over")), F.when(F.col(value) > F.col("_over"), F.col("_k"))).over(Window.partitionBy(group))
    return run.select(group, item, F.greatest(F.col(value) - theta, F.lit(0.0)).alias("weight"))


def _loss(pred: np.ndarray, y: np.ndarray, task: str) -> float:
    """Larger is better: accuracy by argmax, or negative mean squared error."""
    return float((pred.argmax(axis=-1) == y).mean()) if task == "classification" else -float(((pred - y) ** 2).mean())


def greedy_selection(predictions: list[np.ndarray], y: np.ndarray, task: str = "classification", size: int = 20, score=None) -> tuple[list[int], list[float], list[float]]:
    """(members, weights, scores): `size` steps of adding, with replacement, what raises the score most.

    Predictions are (rows, classes) or (rows,); the first of equal candidates wins.
    """
    if not predictions:
        raise ValidationError("nothing to select from")
    score = score or (lambda p: _loss(p, y, task))
    stack = np.stack([np.asarray(p, dtype=np.float64) for p in predictions])
    mean, chosen, scores = np.zeros_like(stack[0]), [], []
    for t in range(size):
        trials = (t * mean[None] + stack) / (t + 1)
        values = [score(p) for p in trials]
        best = int(np.argmax(values))
        chosen.append(best)
        scores.append(values[best])
        mean = trials[best]
    members = sorted(set(chosen))
    return members, [chosen.count(m) / size for m in members], scores


def greedy_selection_frame(long: DataFrame, models: Sequence[str], size: int = 20, row_id: str = "row_id", y: str = "y", digits: int = 9) -> tuple[list[int], list[float], list[float]]:
    """`greedy_selection` by accuracy over (row_id, y, model, label, p) of any size, which stay where they are.

    The probabilities are laid out by row once; a step is one aggregation that counts the hits of all
    trials, so the driver gets a number for each model. A row's label is that of the largest mean
    probability at `digits` digits, the smallest of equal ones; a missing p is 0.
    """
    if not models:
        raise ValidationError("nothing to select from")
    own = [F.coalesce(F.max(F.when(F.col("model") == m, F.col("p"))), F.lit(0.0)).alias(f"p{i}") for i, m in enumerate(models)]
    cells = long.repartition(row_id).groupBy(row_id, y, "label").agg(*own)
    rows = checkpointed(cells.groupBy(row_id, y).agg(F.collect_list(F.struct("label", *[f"p{i}" for i in range(len(models))])).alias("_c")).drop(row_id))
    counts, scores = [0] * len(models), []
    for t in range(size):

        def hits(candidate: int):
            share = [n + (i == candidate) for i, n in enumerate(counts)]
            mean = lambda c: F.round(sum((c[f"p{i}"] * k for i, k in enumerate(share) if k), F.lit(0.0)) / (t + 1), digits)  # noqa: B023, E731
            best = F.array_min(F.transform("_c", lambda c: F.struct((-mean(c)).alias("p"), c["label"].alias("label"))))
            return F.sum((best["label"] == F.col(y)).cast("long"))

        found = rows.agg(F.count(F.lit(1)), *[hits(i) for i in range(len(models))]).first()
        if not found[0]:
            raise ValidationError("no rows to select on")
        best = max(range(len(models)), key=lambda i: found[i + 1] or 0)  # the first of equal ones
        counts[best] += 1
        scores.append((found[best + 1] or 0) / found[0])
    members = [i for i, n in enumerate(counts) if n]
    return members, [counts[i] / size for i in members], scores


def optimise_weights(predictions: list[np.ndarray], y: np.ndarray, start, task: str = "classification", rate: float = 0.05, steps: int = 100) -> np.ndarray:
    """Weights on the simplex by projected gradient descent on log loss or squared error."""
    stack = np.stack([np.asarray(p, dtype=np.float64) for p in predictions])
    w = project_simplex(start)
    n = len(y)
    for _ in range(steps):
        mix = np.tensordot(w, stack, axes=1)
        if task == "classification":
            own = stack[:, np.arange(n), y]
            grad = -(own / np.maximum(mix[np.arange(n), y], 1e-15)).mean(axis=1)
        else:
            grad = 2 * ((mix - y)[None] * stack).mean(axis=1)
        w = project_simplex(w - rate * grad)
    return w
