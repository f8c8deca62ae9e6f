"""Trainers, search and streaming scoring; checked by rows, except where SQL can tell the result."""

from __future__ import annotations

from pyspark.sql import functions as F

from lathe.functions import expressions as X
from lathe.operators import automl as am
from lathe.operators import clustering as cl
from lathe.operators import distributed as ds
from lathe.plans.util import query, r6
from lathe.session import table
from lathe.streaming.scoring import read_stream, score_available

FEATURES = [f"x{i}" for i in range(8)]


def _points(spark, d):
    """The first eight coordinates of the embeddings, and whether the label is at least 5."""
    v = table(spark, d, "embeddings")
    return v.select(F.col("vec_id").alias("row_id"), *[F.get("embedding", F.lit(i)).cast("double").alias(c) for i, c in enumerate(FEATURES)], (F.col("label") >= 5).cast("int").alias("y"))


def _local(family: str, **params):
    def run(spark, d):
        df = _points(spark, d)
        data = am.Matrix.gather(df, "row_id", FEATURES, "y", 3)
        rows = am.evaluate(spark, data, [(0, family, params, 1.0)])
        return spark.createDataFrame([(family, int(r["fold"]), float(r["score"])) for r in rows], "model string, fold int, score double")

    run.__doc__ = f"Three-fold accuracy of the local {family} model."
    return run


for _family, _params in {"linear": {}, "svm": {"C": 1.0}, "boosting": {"numRound": 20}, "forest": {"n_estimators": 20}, "additive": {"maxRounds": 40}, "mlp": {"epochs": 10}, "tabm": {"epochs": 5}, "nam": {"epochs": 10}, "fm": {"epoch": 10}, "ffm": {"epoch": 5}, "clauses": {"nEpochs": 2}, "bart": {"numTrees": 8, "numBurnin": 8, "numSamples": 8}}.items():
    query(name=f"fit_{_family}")(_local(_family, **_params))


def _spark_fit(family: str, **params):
    def run(spark, d):
        df = _points(spark, d)
        model = ds.fit(df, FEATURES, "y", family, "classification", **params)
        return model.transform(df).select("row_id", "y", "prediction")

    run.__doc__ = f"In-sample predictions of the distributed {family} model."
    return run


query(name="distributed_linear")(_spark_fit("linear"))
query(name="distributed_forest")(_spark_fit("forest", n_estimators=10, max_depth=5))


_TWO = "p AS (SELECT vec_id, label AS c, vec_id % 4 AS d, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings), m AS (SELECT c, count(*) AS n, avg(x) AS mx, avg(y) AS my FROM p GROUP BY c)"


def _two(spark, d):
    return table(spark, d, "embeddings").select(F.col("label").alias("c"), (F.col("vec_id") % 4).alias("d"), F.get("embedding", F.lit(0)).cast("double").alias("x"), F.get("embedding", F.lit(1)).cast("double").alias("y"))


@query(f"WITH {_TWO}, b AS (SELECT sum(n * ((mx - (SELECT avg(x) FROM p)) ** 2 + (my - (SELECT avg(y) FROM p)) ** 2)) AS between, count(*) AS k FROM m) SELECT round(between / (k - 1) / (((SELECT (var_pop(x) + var_pop(y)) * count(*) FROM p) - between) / ((SELECT count(*) FROM p) - k)), 6) AS score FROM b")
def calinski_harabasz(spark, d):
    return spark.createDataFrame([(round(cl.calinski_harabasz(_two(spark, d), ["x", "y"], "c"), 6),)], "score double")


@query(f"WITH {_TWO}, s AS (SELECT c, mx, my, avg(sqrt((x - mx) ** 2 + (y - my) ** 2)) AS s FROM p JOIN m USING (c) GROUP BY ALL), w AS (SELECT a.c, max((a.s + b.s) / sqrt((a.mx - b.mx) ** 2 + (a.my - b.my) ** 2)) AS r FROM s a JOIN s b ON a.c <> b.c GROUP BY a.c) SELECT round(avg(r), 6) AS score FROM w")
def davies_bouldin(spark, d):
    return spark.createDataFrame([(round(cl.davies_bouldin(_two(spark, d), ["x", "y"], "c"), 6),)], "score double")


@query(f"WITH {_TWO}, t AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM (SELECT count(*) AS n FROM p GROUP BY c, d)) AS i, (SELECT sum(n * (n - 1) / 2) FROM (SELECT count(*) AS n FROM p GROUP BY c)) AS a, (SELECT sum(n * (n - 1) / 2) FROM (SELECT count(*) AS n FROM p GROUP BY d)) AS b, (SELECT count(*) * (count(*) - 1) / 2 FROM p) AS e) SELECT round((i - a * b / e) / ((a + b) / 2 - a * b / e), 6) AS score FROM t")
def adjusted_rand(spark, d):
    return spark.createDataFrame([(round(cl.adjusted_rand(_two(spark, d), "c", "d"), 6),)], "score double")


@query()
def clustering_kmeans(spark, d):
    df = _points(spark, d)
    return ds.fit(df, FEATURES, None, "kmeans", k=4).transform(df).select("row_id", "prediction")


def _searched(strategy: str, **options):
    def run(spark, d):
        data = am.Matrix.gather(_points(spark, d), "row_id", FEATURES, "y", 3)
        spaces = {"knn": {"k": {"type": "int_uniform", "low": 1, "high": 15}}, "linear": {"C": {"type": "log_uniform", "low": 1e-2, "high": 1e2}}}
        found = am.run_search(spark, data, spaces, strategy, **options)
        return spark.createDataFrame([(r["rank"], r["model"], str(r["params"]), r["mean"], r["std"]) for r in found.board()], "rank int, model string, params string, mean double, std double")

    run.__doc__ = f"A {strategy} search over two families as a ranked board."
    return run


for _strategy in ("random", "halving", "progressive"):
    query(name=f"search_{_strategy}")(_searched(_strategy, n_iter=4))


@query()
def autofit_ensemble(spark, d):
    """Search, selection and the weights of the ensemble's members."""
    out = am.auto_fit(spark, _points(spark, d), "row_id", FEATURES, "y", ["knn", "baseline", "linear"], cv=3, n_iter=2, ensemble_size=6)
    return spark.createDataFrame([(m, str(p), float(w)) for (m, p), w in zip(out.members, out.weights, strict=True)], "model string, params string, weight double")


_Z = "abs(value / 100 - 0.5)"
_TAIL = f"exp(-{_Z} * {_Z} / 2) / sqrt(2 * pi()) * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))"


@query(f"SELECT event_id, round(CASE WHEN value / 100 - 0.5 < 0 THEN {_TAIL} ELSE 1 - {_TAIL} END, 6) + 0.0::DOUBLE AS p FROM (SELECT event_id, value, 1 / (1 + 0.2316419 * {_Z}) AS t FROM events)")
def probit_proba(spark, d):
    return table(spark, d, "events").select("event_id", r6(X.probit(F.col("value") / 100 - 0.5)).alias("p"))


@query()
def forest_importance(spark, d):
    """Permutation importances of a forest that is fitted and scored on all rows."""
    df = _points(spark, d)
    return ds.permutation_importance(ds.fit(df, FEATURES, "y", "forest", n_estimators=15, max_depth=5), df, "row_id", FEATURES, "y")


@query("SELECT event_id, round(1 / (1 + exp(-(value / 100 - 0.5))), 6) + 0.0::DOUBLE AS p FROM events")
def streaming_scoring(spark, d):
    """The linear scorer on the events as a stream."""
    scored = lambda s: s.select("event_id", r6(X.sigmoid(X.linear([F.col("value") / 100], [1.0], -0.5))).alias("p"))
    return score_available(read_stream(spark, d, "events"), scored)
