"""Estimators for data that doesn't fit a worker, on Spark's own machine-learning library.

The parameters are those of the local families; regularisation is translated so that the objective
is the same (regParam = 1 / (C * rows), no standardisation).
"""

from __future__ import annotations

from pyspark.ml import Pipeline as SparkPipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lathe.errors import ValidationError
from lathe.functions.ordered import global_rank
from lathe.session import checkpointed


def estimator(family: str, task: str, params: dict, rows: int, classes: int = 2):
    """A pyspark.ml estimator of (features, label)."""
    from pyspark.ml import classification as C
    from pyspark.ml import clustering as K
    from pyspark.ml import regression as R

    kw = {"featuresCol": "features", "labelCol": "label"}
    if family == "linear":
        solver, reg = params.get("solver", 0), 1 / (params.get("C", 1.0) * rows)
        if task == "regression":
            return R.LinearRegression(regParam=reg, standardization=False, **kw)
        if solver == 3:
            one = C.LinearSVC(regParam=reg, standardization=False, **kw)
        else:
            one = C.LogisticRegression(regParam=reg, elasticNetParam=1.0 if solver == 6 else 0.0, standardization=False, fitIntercept=params.get("bias", 1.0) >= 0, **kw)
        return one if classes == 2 else C.OneVsRest(classifier=one, **kw)
    if family == "forest":
        made = C.RandomForestClassifier if task == "classification" else R.RandomForestRegressor
        subset = {"sqrt": "sqrt", "log2": "log2", "third": "onethird", "all": "all"}.get(params.get("max_features", "sqrt"), "auto")
        return made(numTrees=params.get("n_estimators", 100), maxDepth=min(30, params.get("max_depth", 10)), featureSubsetStrategy=subset, minInstancesPerNode=params.get("min_samples_leaf", 1), seed=params.get("seed", 0), **kw)
    if family == "boosting":
        made = C.GBTClassifier if task == "classification" else R.GBTRegressor
        one = made(maxIter=params.get("numRound", 100), stepSize=params.get("eta", 0.1), maxDepth=params.get("max_depth", 4), subsamplingRate=params.get("subsample", 1.0), seed=params.get("seed", 0), **kw)
        return one if task == "regression" or classes == 2 else C.OneVsRest(classifier=one, **kw)
    if family == "fm":
        made = C.FMClassifier if task == "classification" else R.FMRegressor
        return made(factorSize=params.get("k", 4), stepSize=params.get("lr", 0.1), regParam=params.get("lambda", 2e-5), maxIter=params.get("epoch", 30), seed=params.get("seed", 0), **kw)
    if family == "gam":
        return R.GeneralizedLinearRegression(family="binomial" if task == "classification" else "gaussian", regParam=params.get("lambda", 0.0), **kw)
    if family == "kmeans":
        return K.KMeans(k=params.get("k", 3), seed=params.get("seed", 0), featuresCol="features")
    raise ValidationError(f"no distributed form of {family!r}")


def fit(df: DataFrame, features: list[str], y: str | None, family: str, task: str = "classification", **params):
    """A fitted PipelineModel that adds `prediction` (and probabilities where there are any)."""
    named = df.withColumn("label", F.col(y).cast("double")) if y else df
    row = named.agg(F.count(F.lit(1)).alias("n"), *([F.count_distinct("label").alias("k")] if y else [])).first()
    if not row["n"]:
        raise ValidationError("nothing to fit on")
    stage = estimator(family, task, params, row["n"], row["k"] if y else 0)
    return SparkPipeline(stages=[VectorAssembler(inputCols=features, outputCol="features"), stage]).fit(named)


def permutation_importance(model, df: DataFrame, row_id: str, features: list[str], y: str, seed: int = 0) -> DataFrame:
    """(feature, importance): the accuracy over all rows, less that with the feature's values permuted.

    Rows are put in a hash order of their ids; a feature's values move along it by an own distance.
    """
    named = df.select(F.col(row_id).alias("_id"), *features, F.col(y).cast("double").alias("_y"))
    ranked = checkpointed(global_rank(named, F.sha2(F.concat_ws(" ", F.lit(seed), "_id"), 256), ["_id"], out="_rank"))
    n = ranked.count()
    steps = {f: 1 + (i * n) // (len(features) + 1) % max(1, n - 1) for i, f in enumerate(features)}
    moved = F.array(*[F.struct((F.pmod(F.col("_rank") - 1 + F.lit(steps[f]), F.lit(n)) + 1).alias("_rank"), F.lit(i).alias("i"), F.col(f).alias("v")) for i, f in enumerate(features)])
    others = ranked.select(F.explode(moved).alias("x")).groupBy("x._rank").agg(*[F.max(F.when(F.col("x.i") == i, F.col("x.v"))).alias(f"_v{i}") for i in range(len(features))])
    kinds = [F.struct(F.lit(k).alias("k"), *[F.col(f"_v{i}" if i == k else f).alias(f) for i, f in enumerate(features)]) for k in range(-1, len(features))]
    rows = ranked.join(others, "_rank").select("_y", F.explode(F.array(*kinds)).alias("x")).select("_y", "x.*")
    right = model.transform(rows).groupBy("k").agg(F.avg((F.col("prediction") == F.col("_y")).cast("double")).alias("score"))
    scores = {r["k"]: r["score"] for r in right.collect()}
    return df.sparkSession.createDataFrame([(f, scores[-1] - scores[i]) for i, f in enumerate(features)], "feature string, importance double")
