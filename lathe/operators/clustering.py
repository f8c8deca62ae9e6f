"""Clustering and its indices. K-means is Spark's own; density and linkage clustering are local."""

from __future__ import annotations

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lathe.errors import ValidationError


def k_means(df: DataFrame, features: list[str], k: int, seed: int = 0, out: str = "cluster") -> DataFrame:
    ready = VectorAssembler(inputCols=features, outputCol="_v").transform(df)
    return KMeans(k=k, seed=seed, featuresCol="_v", predictionCol=out).fit(ready).transform(ready).drop("_v")


def silhouette(df: DataFrame, features: list[str], cluster: str = "cluster") -> float:
    """Mean silhouette with squared distances (needs two clusters)."""
    ready = VectorAssembler(inputCols=features, outputCol="_v").transform(df)
    return ClusteringEvaluator(featuresCol="_v", predictionCol=cluster).evaluate(ready)


def _moments(df: DataFrame, features: list[str], cluster: str):
    rows = df.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"), *[F.avg(f).alias(f"m_{f}") for f in features]).collect()
    n = np.array([r["n"] for r in rows], float)
    centres = np.array([[r[f"m_{f}"] for f in features] for r in rows])
    return [r[cluster] for r in rows], n, centres


def calinski_harabasz(df: DataFrame, features: list[str], cluster: str = "cluster") -> float:
    """Spread between clusters over spread within, each by its degrees of freedom."""
    ids, n, centres = _moments(df, features, cluster)
    k, total = len(ids), n.sum()
    if k < 2:
        raise ValidationError("the index needs two clusters")
    mean = (n[:, None] * centres).sum(0) / total
    between = (n * ((centres - mean) ** 2).sum(1)).sum()
    all_ = df.agg(*[F.var_pop(f).alias(f) for f in features]).first()
    within = sum(all_[f] for f in features) * total - between
    return float(between / (k - 1) / (within / (total - k))) if within > 0 else float("inf")


def davies_bouldin(df: DataFrame, features: list[str], cluster: str = "cluster") -> float:
    """Mean over clusters of the worst ratio of scatters to the distance of centres."""
    ids, _, centres = _moments(df, features, cluster)
    if len(ids) < 2:
        raise ValidationError("the index needs two clusters")
    spark = df.sparkSession
    at = spark.createDataFrame([(i, *map(float, c)) for i, c in zip(ids, centres, strict=True)], f"{cluster} {df.schema[cluster].dataType.simpleString()}, " + ", ".join(f"c_{f} double" for f in features))
    dist = F.sqrt(sum(((F.col(f) - F.col(f"c_{f}")) ** 2 for f in features), F.lit(0.0)))
    scatter = {r[cluster]: r["s"] for r in df.join(F.broadcast(at), cluster).groupBy(cluster).agg(F.avg(dist).alias("s")).collect()}
    s = np.array([scatter[i] for i in ids])
    gap = np.sqrt(((centres[:, None] - centres[None]) ** 2).sum(2))
    np.fill_diagonal(gap, np.inf)
    return float(((s[:, None] + s[None]) / gap).max(axis=1).mean())


def adjusted_rand(df: DataFrame, a: str, b: str) -> float:
    """Agreement of two labellings over pairs of rows, corrected for chance; counts of pairs are summed where they lie."""
    cells = df.groupBy(a, b).agg(F.count(F.lit(1)).cast("double").alias("n"))

    def pairs_of(counts: DataFrame) -> float:
        return counts.agg(F.coalesce(F.sum(F.col("n") * (F.col("n") - 1) / 2), F.lit(0.0))).first()[0]

    pairs, rows, cols, every = (pairs_of(cells if by is None else cells.groupBy(*by).agg(F.sum("n").alias("n"))) for by in (None, [a], [b], []))
    by_chance = rows * cols / every if every else 0.0
    top = (rows + cols) / 2
    return 1.0 if top == by_chance else float((pairs - by_chance) / (top - by_chance))


def dbscan(x: np.ndarray, eps: float, min_points: int) -> np.ndarray:
    """Cluster of each row by density; -1 is noise."""
    x = np.asarray(x, float)
    near = [np.flatnonzero(((x - p) ** 2).sum(1) <= eps * eps) for p in x]
    core = np.array([len(n) >= min_points for n in near])
    out, cluster = np.full(len(x), -1), 0
    for i in np.flatnonzero(core):
        if out[i] >= 0:
            continue
        todo = [i]
        out[i] = cluster
        while todo:
            for j in near[todo.pop()]:
                if out[j] < 0:
                    out[j] = cluster
                    if core[j]:
                        todo.append(j)
        cluster += 1
    return out


def agglomerate(x: np.ndarray, k: int, linkage: str = "average") -> np.ndarray:
    """k clusters by merging the two nearest: single, complete or average linkage."""
    if linkage not in ("single", "complete", "average"):
        raise ValidationError(f"unknown linkage {linkage!r}")
    x = np.asarray(x, float)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    groups = {i: [i] for i in range(len(x))}
    while len(groups) > k:
        i, j = np.unravel_index(int(d.argmin()), d.shape)
        a, b = len(groups[i]), len(groups[j])
        row = np.minimum(d[i], d[j]) if linkage == "single" else np.maximum(d[i], d[j]) if linkage == "complete" else (a * d[i] + b * d[j]) / (a + b)
        d[i], d[:, i] = row, row
        d[i, i] = np.inf
        d[j], d[:, j] = np.inf, np.inf
        groups[i] += groups.pop(j)
    out = np.empty(len(x), int)
    for c, rows in enumerate(sorted(groups.values(), key=min)):
        out[rows] = c
    return out
