"""Folds, splits, samples, nearest neighbours and cross-validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from lathe.functions import metrics as M
from lathe.functions.rng import INCREMENT, MASK, MULTIPLIER
from lathe.operators import frames as fr
from lathe.operators import neighbours as nn
from lathe.plans.util import query, r6, rounded
from lathe.session import table


def orders(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")


def vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("embedding").alias("vector"), "label")


@query("SELECT o_orderkey, CAST(ntile(5) OVER (ORDER BY md5(concat(CAST(o_orderkey AS VARCHAR), ':42')), o_orderkey) - 1 AS INTEGER) AS fold FROM orders")
def kfold(spark, d):
    return fr.k_fold(orders(spark, d).select("o_orderkey"), "o_orderkey", 5)


@query("SELECT vec_id AS row_id, label, CAST((row_number() OVER (PARTITION BY label ORDER BY md5(concat(CAST(vec_id AS VARCHAR), ':42')), vec_id) - 1) % 5 AS INTEGER) AS fold FROM embeddings")
def stratified_kfold(spark, d):
    return fr.stratified_k_fold(vectors(spark, d).select("row_id", "label"), "row_id", "label", 5)


@query(" UNION ALL ".join(f"SELECT o_orderkey, CAST(ntile(3) OVER (ORDER BY md5(concat(CAST(o_orderkey AS VARCHAR), ':{42 + r}')), o_orderkey) - 1 AS INTEGER) AS fold, {r} AS repeat FROM orders" for r in range(2)))
def repeated_kfold(spark, d):
    return fr.repeated_k_fold(orders(spark, d).select("o_orderkey"), "o_orderkey", 3, 2)


@query("SELECT o_orderkey, row_number() OVER (ORDER BY md5(concat(CAST(o_orderkey AS VARCHAR), ':42')), o_orderkey) > (SELECT count(*) - greatest(1, CAST(floor(count(*) * 0.2 + 0.5) AS BIGINT)) FROM orders) AS is_test FROM orders")
def train_test_split(spark, d):
    return fr.train_test_split(orders(spark, d).select("o_orderkey"), "o_orderkey", 0.2)


@query("SELECT o_orderkey FROM orders QUALIFY row_number() OVER (ORDER BY md5(concat(CAST(o_orderkey AS VARCHAR), ':42:knn:1')), o_orderkey) <= (SELECT greatest(1, ceil(count(*) * 0.3)) FROM orders)")
def subsample_budget(spark, d):
    return fr.subsample(orders(spark, d).select("o_orderkey"), "o_orderkey", 0.3, 42, F.lit("knn"), F.lit(1))


@query("SELECT o_orderkey FROM (SELECT o_orderkey, ntile(5) OVER (ORDER BY md5(concat(CAST(o_orderkey AS VARCHAR), ':42')), o_orderkey) - 1 AS fold FROM orders) WHERE fold <> 2")
def train_complement(spark, d):
    return fr.train_rows(kfold(spark, d), 2).select("o_orderkey")


@query(f"WITH RECURSIVE s(i, state) AS (SELECT 0, CAST(42 AS BIGINT) UNION ALL SELECT i + 1, (state * {MULTIPLIER} + {INCREMENT}) & {MASK} FROM s WHERE i < 50) SELECT i, state, round(state / {MASK}, 9) AS u FROM s WHERE i > 0")
def lcg_sequence(spark, d):
    df = spark.sql(f"WITH RECURSIVE s(i, state) AS (SELECT 0, 42L UNION ALL SELECT i + 1, (state * {MULTIPLIER}L + {INCREMENT}L) & {MASK}L FROM s WHERE i < 50) SELECT i, state FROM s WHERE i > 0")
    return df.withColumn("u", F.round(F.col("state") / MASK, 9))


def _sides(spark, d):
    v = vectors(spark, d)
    queries = v.where("row_id % 10 = 0").select(F.col("row_id").alias("query_id"), "vector", F.col("row_id").alias("own"))
    return queries, v.select(F.col("row_id").alias("train_id"), "vector", "label", F.col("row_id").alias("own"))


def _knn_sql(metric: str, k: int = 5) -> str:
    each = "abs(x - y)" if metric == "l1" else "(x - y) * (x - y)"
    total = "sum(e)" if metric == "l1" else "sqrt(sum(e))"
    return f"""p AS (SELECT q.vec_id AS query_id, t.vec_id AS train_id, t.label, unnest(q.embedding)::DOUBLE AS x, unnest(t.embedding)::DOUBLE AS y FROM embeddings q JOIN embeddings t ON q.vec_id <> t.vec_id WHERE q.vec_id % 10 = 0),
g AS (SELECT query_id, train_id, label, {total} AS distance FROM (SELECT query_id, train_id, label, {each} AS e FROM p) GROUP BY ALL),
n AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, train_id) AS INTEGER) AS rank FROM g QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, train_id) <= {k})"""


@query(f"WITH {_knn_sql('l2')} SELECT query_id, train_id, round(distance, 6) AS distance, rank FROM n")
def knn_neighbors(spark, d):
    q, t = _sides(spark, d)
    return rounded(nn.neighbours(q, t, 5, apart="own"), "distance")


@query(f"WITH {_knn_sql('l1')} SELECT query_id, train_id, round(distance, 6) AS distance, rank FROM n")
def knn_l1(spark, d):
    q, t = _sides(spark, d)
    return rounded(nn.neighbours(q, t, 5, metric="l1", apart="own"), "distance")


@query(f"WITH {_knn_sql('l2')}, c AS (SELECT query_id, label, count(*) AS k FROM n GROUP BY ALL) SELECT query_id, label AS prediction FROM c QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY k DESC, label) = 1")
def knn_classify(spark, d):
    q, t = _sides(spark, d)
    return nn.vote(nn.neighbours(q, t, 5, apart="own"), t.select("train_id", "label"))


@query(f"WITH {_knn_sql('l2')} SELECT query_id, label, round(count(*) / 5, 6) AS p FROM n GROUP BY ALL")
def knn_proba(spark, d):
    q, t = _sides(spark, d)
    return rounded(nn.probabilities(nn.neighbours(q, t, 5, apart="own"), t.select("train_id", "label")), "p")


@query(f"WITH {_knn_sql('l2')} SELECT query_id, round(avg(label * 1.5), 6) AS prediction FROM n GROUP BY query_id")
def knn_regress(spark, d):
    q, t = _sides(spark, d)
    found = nn.neighbours(q, t, 5, apart="own")
    return rounded(nn.mean_of_neighbours(found, t.select("train_id", (F.col("label") * 1.5).alias("y"))), "prediction")


@query()
def knn_leaderboard(spark, d):
    """Nearest-neighbour models of k = 1, 3, 5 and 7, cross-validated over 5 folds and ranked."""
    v = fr.stratified_k_fold(vectors(spark, d), "row_id", "label", 5)
    labels = v.select(F.col("row_id").alias("train_id"), "label")
    parts = []
    for f in range(5):
        test = v.where(F.col("fold") == f).select(F.col("row_id").alias("query_id"), "vector")
        train = v.where(F.col("fold") != f).select(F.col("row_id").alias("train_id"), "vector")
        parts.append(nn.neighbours(test, train, 7).withColumn("fold", F.lit(f)))
    found = M.union_all(parts).join(labels, "train_id")
    ks = spark.createDataFrame([(k,) for k in (1, 3, 5, 7)], "k int")
    counts = found.join(F.broadcast(ks), F.col("rank") <= F.col("k")).groupBy("k", "fold", "query_id", "label").agg(F.count(F.lit(1)).alias("n"))
    voted = counts.groupBy("k", "fold", "query_id").agg(F.min(F.struct((-F.col("n")).alias("n"), F.col("label").alias("l")))["l"].alias("prediction"))
    truth = v.select(F.col("row_id").alias("query_id"), F.col("label").alias("y"))
    folds = voted.join(truth, "query_id").groupBy("k", "fold").agg(M.accuracy("y", "prediction").alias("score"))
    board = folds.groupBy("k").agg(r6(F.avg("score")).alias("mean_score"), r6(F.stddev_pop("score")).alias("std_score"))
    from pyspark.sql import Window

    return board.select("k", "mean_score", "std_score", F.row_number().over(Window.orderBy(F.col("mean_score").desc(), "k")).alias("rank"))


_KNN_BOARD = """WITH f AS (SELECT vec_id, label, embedding, (row_number() OVER (PARTITION BY label ORDER BY md5(concat(CAST(vec_id AS VARCHAR), ':42')), vec_id) - 1) % 5 AS fold FROM embeddings),
p AS (SELECT q.vec_id AS q, q.fold, q.label AS y, t.vec_id AS t, t.label, unnest(q.embedding)::DOUBLE AS a, unnest(t.embedding)::DOUBLE AS b FROM f q JOIN f t ON q.fold <> t.fold),
g AS (SELECT q, fold, y, t, label, sqrt(sum((a - b) * (a - b))) AS dist FROM p GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY dist, t) AS r FROM g),
c AS (SELECT k, q, fold, y, label, count(*) AS m FROM n JOIN (SELECT unnest([1, 3, 5, 7]) AS k) ON r <= k GROUP BY ALL),
v AS (SELECT k, q, fold, y, label FROM c QUALIFY row_number() OVER (PARTITION BY k, q ORDER BY m DESC, label) = 1),
s AS (SELECT k, fold, avg(CASE WHEN y = label THEN 1.0 ELSE 0.0 END) AS score FROM v GROUP BY ALL),
b AS (SELECT k, round(avg(score), 6) AS mean_score, round(stddev_pop(score), 6) AS std_score FROM s GROUP BY k)
SELECT CAST(k AS INTEGER) AS k, mean_score, std_score, CAST(row_number() OVER (ORDER BY mean_score DESC, k) AS INTEGER) AS rank FROM b"""
query(_KNN_BOARD)(knn_leaderboard)

_FOLDED = "f AS (SELECT vec_id, label AS y, (row_number() OVER (PARTITION BY label ORDER BY md5(concat(CAST(vec_id AS VARCHAR), ':42')), vec_id) - 1) % 5 AS fold FROM embeddings)"


@query(f"""WITH {_FOLDED}, c AS (SELECT t.fold, f.y, count(*) AS n FROM f JOIN (SELECT DISTINCT fold FROM f) t ON f.fold <> t.fold GROUP BY ALL),
m AS (SELECT fold, y AS p FROM c QUALIFY row_number() OVER (PARTITION BY fold ORDER BY n DESC, y) = 1)
SELECT CAST(fold AS INTEGER) AS fold, round(avg(CASE WHEN y = p THEN 1.0 ELSE 0.0 END), 6) AS score FROM f JOIN m USING (fold) GROUP BY fold""")
def cross_val_majority(spark, d):
    """Accuracy of the majority class of the other folds."""
    v = fr.stratified_k_fold(vectors(spark, d).select("row_id", F.col("label").alias("y")), "row_id", "y", 5)
    cells = v.groupBy("fold", "y").agg(F.count(F.lit(1)).alias("n"))
    other = cells.select(F.col("fold").alias("f"), "y", "n").join(cells.select("fold").distinct(), F.col("f") != F.col("fold")).groupBy("fold", "y").agg(F.sum("n").alias("n"))
    best = other.groupBy("fold").agg(F.min(F.struct((-F.col("n")).alias("n"), F.col("y").alias("p")))["p"].alias("p"))
    return v.join(F.broadcast(best), "fold").groupBy("fold").agg(r6(M.accuracy("y", "p")).alias("score"))


@query("""WITH f AS (SELECT o_totalprice AS y, ntile(5) OVER (ORDER BY md5(concat(CAST(o_orderkey AS VARCHAR), ':42')), o_orderkey) - 1 AS fold FROM orders),
m AS (SELECT t.fold, avg(y) AS p FROM f JOIN (SELECT DISTINCT fold FROM f) t ON f.fold <> t.fold GROUP BY t.fold)
SELECT CAST(fold AS INTEGER) AS fold, round(-avg((y - p) ** 2), 2) AS score FROM f JOIN m USING (fold) GROUP BY fold""")
def cross_val_mean(spark, d):
    """Negative squared error of the mean of the other folds, from each fold's sums."""
    v = fr.k_fold(orders(spark, d).select("o_orderkey", F.col("o_totalprice").alias("y")), "o_orderkey", 5)
    sums = v.groupBy("fold").agg(F.sum("y").alias("s"), F.count(F.lit(1)).alias("n"))
    total = sums.agg(F.sum("s").alias("ts"), F.sum("n").alias("tn"))
    means = sums.crossJoin(total).select("fold", ((F.col("ts") - F.col("s")) / (F.col("tn") - F.col("n"))).alias("p"))
    return v.join(F.broadcast(means), "fold").groupBy("fold").agg(r6(M.scorer("neg_mse")("y", "p"), 2).alias("score"))
