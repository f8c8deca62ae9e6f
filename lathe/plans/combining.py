"""Ensembles, leaderboards, search strategies and bundles."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lathe.operators import ensembles as en
from lathe.operators import frames as fr
from lathe.operators import leaderboard as lb
from lathe.operators import search as se
from lathe.plans.util import query, r6, rounded
from lathe.session import table
from lathe.sources import bundle as bn


def _members(spark, d):
    """(row_id, model, label, p): three fixed members over ten classes of the embeddings."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("label").alias("y"))
    cells = v.withColumn("label", F.explode(F.sequence(F.lit(0), F.lit(9))))
    own = (F.col("label") == F.col("y")).cast("double")
    near = (F.col("label") == (F.col("y") + F.col("row_id") % 3) % 10).cast("double")
    ps = {"a": 0.55 * own + 0.045, "b": 0.7 * near + 0.03, "c": F.lit(0.1) + 0.02 * (F.col("label") - 4.5) / 4.5}
    return cells.select("row_id", "y", "label", F.explode(F.array(*[F.struct(F.lit(m).alias("model"), p.alias("p")) for m, p in ps.items()])).alias("x")).select("row_id", "y", "label", "x.*")


_MEMBERS = """cells AS (SELECT vec_id AS row_id, label AS y, unnest(range(0, 10))::INTEGER AS label FROM embeddings),
m AS (SELECT row_id, y, label, 'a' AS model, 0.55::DOUBLE * (CASE WHEN label = y THEN 1 ELSE 0 END) + 0.045 AS p FROM cells
UNION ALL SELECT row_id, y, label, 'b', 0.7::DOUBLE * (CASE WHEN label = (y + row_id % 3) % 10 THEN 1 ELSE 0 END) + 0.03 FROM cells
UNION ALL SELECT row_id, y, label, 'c', 0.1::DOUBLE + 0.02 * (label - 4.5) / 4.5 FROM cells),
t AS (SELECT row_id, model, label AS prediction FROM m QUALIFY row_number() OVER (PARTITION BY row_id, model ORDER BY p DESC, label) = 1)"""
_W = {"a": 0.5, "b": 0.3, "c": 0.2}
_W_SQL = "(CASE model WHEN 'a' THEN 0.5 WHEN 'b' THEN 0.3 ELSE 0.2 END)::DOUBLE"


@query(f"WITH {_MEMBERS}, s AS (SELECT row_id, label, round(sum({_W_SQL} * p), 9) AS p FROM m GROUP BY ALL) SELECT row_id, label AS prediction, round(p, 6) AS p FROM s QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY p DESC, label) = 1")
def voting_soft(spark, d):
    mixed = en.soft_vote(_members(spark, d), _W).withColumn("p", F.round("p", 9))
    best = mixed.groupBy("row_id").agg(F.min(F.struct((-F.col("p")).alias("q"), F.col("label").alias("l"))).alias("x"))
    return best.select("row_id", F.col("x.l").alias("prediction"), F.round(-F.col("x.q"), 6).alias("p"))


def _labels(spark, d):
    return en.argmax_label(_members(spark, d).withColumn("row", F.struct("row_id", "model")), "row").select("row.row_id", "row.model", "prediction")


@query(f"WITH {_MEMBERS}, s AS (SELECT row_id, prediction, round(sum({_W_SQL}), 9) AS w FROM t GROUP BY ALL) SELECT row_id, prediction FROM s QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY w DESC, prediction) = 1")
def voting_hard(spark, d):
    return en.hard_vote(_labels(spark, d).withColumnRenamed("prediction", "label"), _W)


@query("SELECT o_orderkey AS row_id, round(0.6 * (0.9 * o_totalprice) + 0.5 * (o_custkey * 2.0), 4) AS prediction FROM orders")
def voting_regression(spark, d):
    o = table(spark, d, "orders")
    each = F.array(F.struct(F.lit("a").alias("model"), (0.9 * F.col("o_totalprice")).alias("prediction")), F.struct(F.lit("b").alias("model"), (F.col("o_custkey") * 2.0).alias("prediction")))
    long = o.select(F.col("o_orderkey").alias("row_id"), F.explode(each).alias("x")).select("row_id", "x.*")
    return rounded(en.regression_vote(long, {"a": 0.6, "b": 0.5}), "prediction", digits=4)


@query(f"WITH {_MEMBERS} SELECT row_id, " + ", ".join(f"round(max(p) FILTER (model = '{m}' AND label = {c}), 6) AS {m}_{c}" for m in ("a", "b") for c in range(10)) + " FROM m GROUP BY row_id")
def stacking_meta(spark, d):
    wide = en.meta_features(_members(spark, d), ["a", "b"], range(10))
    return rounded(wide, *[c for c in wide.columns if c != "row_id"])


def _fold_priors(spark, d, seed: int):
    """Out-of-fold class shares: each row gets those of the rows of other folds."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("label").alias("y"))
    v = fr.k_fold(v, "row_id", 5, seed)
    cells = v.groupBy("fold", "y").agg(F.count(F.lit(1)).alias("n"))
    folds = cells.groupBy("fold").agg(F.sum("n").alias("held"))
    total = cells.groupBy(F.col("y").alias("label")).agg(F.sum("n").alias("all"))
    rows = folds.crossJoin(total).crossJoin(cells.agg(F.sum("n").alias("rows")))
    rows = rows.join(cells.select("fold", F.col("y").alias("label"), F.col("n").alias("own")), ["fold", "label"], "left")
    priors = rows.select("fold", "label", ((F.col("all") - F.coalesce("own", F.lit(0))) / (F.col("rows") - F.col("held"))).alias("p"))
    return v.select("row_id", "fold").join(F.broadcast(priors), "fold").select("row_id", "label", "p")


def _prior_sql(seed: int) -> str:
    return f"""(WITH f AS (SELECT vec_id AS row_id, label AS y, ntile(5) OVER (ORDER BY md5(concat(CAST(vec_id AS VARCHAR), ':{seed}')), vec_id) - 1 AS fold FROM embeddings),
g AS (SELECT DISTINCT fold FROM f), k AS (SELECT DISTINCT y AS label FROM f),
p AS (SELECT g.fold, k.label, avg(CASE WHEN f.y = k.label THEN 1.0 ELSE 0.0 END) AS p FROM g, k, f WHERE f.fold <> g.fold GROUP BY ALL)
SELECT row_id, label, p FROM f JOIN p USING (fold))"""


@query(f"SELECT row_id, label, round(p, 6) AS p FROM {_prior_sql(42)}")
def oof_predictions(spark, d):
    return rounded(_fold_priors(spark, d, 42), "p")


@query(f"SELECT row_id, label, round(avg(p), 6) AS p FROM ({' UNION ALL '.join('SELECT * FROM ' + _prior_sql(42 + r) for r in range(3))}) GROUP BY ALL")
def bagging_oof(spark, d):
    parts = [_fold_priors(spark, d, 42 + r) for r in range(3)]
    return rounded(en.average_out_of_fold(parts[0].unionByName(parts[1]).unionByName(parts[2])), "p")


@query(f"WITH {_MEMBERS} SELECT x.model AS a, y.model AS b, round(avg(CASE WHEN x.prediction <> y.prediction THEN 1.0 ELSE 0.0 END), 6) AS disagreement FROM t x JOIN t y ON x.row_id = y.row_id AND x.model < y.model GROUP BY ALL")
def disagreement_cls(spark, d):
    return rounded(en.disagreement(_labels(spark, d)), "disagreement")


_NUMBERS = "n AS (SELECT o_orderkey AS row_id, 'a' AS model, o_totalprice AS prediction FROM orders UNION ALL SELECT o_orderkey, 'b', o_totalprice * 0.5 + o_custkey * 40 FROM orders UNION ALL SELECT o_orderkey, 'c', 7.0 FROM orders)"


@query(f"WITH {_NUMBERS} SELECT x.model AS a, y.model AS b, round(CASE WHEN stddev_pop(x.prediction) * stddev_pop(y.prediction) < 1e-12 THEN 1 ELSE 1 - abs(corr(x.prediction, y.prediction)) END, 6)::DOUBLE AS disagreement FROM n x JOIN n y ON x.row_id = y.row_id AND x.model < y.model GROUP BY ALL")
def disagreement_reg(spark, d):
    p = F.col("o_totalprice")
    each = F.array(*[F.struct(F.lit(m).alias("model"), v.cast("double").alias("prediction")) for m, v in (("a", p), ("b", p * 0.5 + F.col("o_custkey") * 40), ("c", F.lit(7.0)))])
    long = table(spark, d, "orders").select(F.col("o_orderkey").alias("row_id"), F.explode(each).alias("x")).select("row_id", "x.*")
    return rounded(en.disagreement(long, "regression"), "disagreement")


@query(f"""WITH {_MEMBERS}, dis AS (SELECT x.model AS a, y.model AS b, avg(CASE WHEN x.prediction <> y.prediction THEN 1.0 ELSE 0.0 END) AS d FROM t x JOIN t y ON x.row_id = y.row_id AND x.model < y.model GROUP BY ALL),
p AS (SELECT max(d) FILTER (a = 'a' AND b = 'b') AS ab, max(d) FILTER (a = 'a' AND b = 'c') AS ac, max(d) FILTER (a = 'b' AND b = 'c') AS bc FROM dis),
k AS (SELECT ab >= 0.05 AS kb, ac >= 0.05 AND (ab < 0.05 OR bc >= 0.05) AS kc FROM p)
SELECT model FROM (SELECT 'a' AS model, true AS keep UNION ALL SELECT 'b', kb OR NOT kc FROM k UNION ALL SELECT 'c', kc FROM k) WHERE keep""")
def diversity_filter(spark, d):
    apart = {frozenset((r["a"], r["b"])): r["disagreement"] for r in en.disagreement(_labels(spark, d)).collect()}
    return spark.createDataFrame([(m,) for m in en.diversity_filter(["a", "b", "c"], apart, 0.05)], "model string")


@query("""WITH v AS (SELECT s_nationkey AS grp, s_suppkey AS item, s_acctbal / 10000 AS x FROM supplier), r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY x DESC, item) AS k, sum(x) OVER (PARTITION BY grp ORDER BY x DESC, item ROWS UNBOUNDED PRECEDING) AS s FROM v),
t AS (SELECT grp, max_by((s - 1) / k, k) AS theta FROM r WHERE x > (s - 1) / k GROUP BY grp) SELECT grp, item, round(greatest(x - theta, 0), 6) AS weight FROM v JOIN t USING (grp)""")
def project_simplex(spark, d):
    v = table(spark, d, "supplier").select(F.col("s_nationkey").alias("grp"), F.col("s_suppkey").alias("item"), (F.col("s_acctbal") / 10000).alias("x"))
    return rounded(en.project_simplex_frame(v, "grp", "item", "x"), "weight")


@query(f"""WITH RECURSIVE {_MEMBERS.replace('m AS (SELECT row_id, y, label,', 'm AS (SELECT row_id, y, label,', 1)},
q AS (SELECT row_id, y, label, max(p) FILTER (model = 'a') AS pa, max(p) FILTER (model = 'b') AS pb, max(p) FILTER (model = 'c') AS pc FROM m GROUP BY ALL),
trial AS (SELECT i, j, k, row_id, y, label, round((i * pa + j * pb + k * pc) / (i + j + k), 9) AS p FROM q, (SELECT unnest(range(0, 5)) AS i), (SELECT unnest(range(0, 5)) AS j), (SELECT unnest(range(0, 5)) AS k) WHERE i + j + k BETWEEN 1 AND 4),
hit AS (SELECT i, j, k, row_id, y, label FROM trial QUALIFY row_number() OVER (PARTITION BY i, j, k, row_id ORDER BY p DESC, label) = 1),
score AS (SELECT i, j, k, avg(CASE WHEN y = label THEN 1.0 ELSE 0.0 END) AS s FROM hit GROUP BY ALL),
path(step, i, j, k) AS (SELECT 0, 0::BIGINT, 0::BIGINT, 0::BIGINT UNION ALL SELECT * FROM (SELECT step + 1 AS step, n.i, n.j, n.k FROM path, score n WHERE step < 4 AND n.i + n.j + n.k = step + 1 AND n.i >= path.i AND n.j >= path.j AND n.k >= path.k ORDER BY n.s DESC, n.i - path.i DESC, n.j - path.j DESC LIMIT 1))
SELECT unnest([1, 2, 3])::INTEGER AS member, unnest([i, j, k]) / 4 AS weight FROM path WHERE step = 4""")
def caruana_select(spark, d):
    """Greedy selection of four steps, each one aggregation over the members' probabilities."""
    members, weights, _ = en.greedy_selection_frame(_members(spark, d), ["a", "b", "c"], size=4)
    found = dict(zip(members, weights, strict=True))
    return spark.createDataFrame([(i + 1, float(found.get(i, 0.0))) for i in range(3)], "member int, weight double")


# A leaderboard from the lines' groups: a candidate for each line number and flag, its folds by part.
_BOARD = """c AS (SELECT (dense_rank() OVER (ORDER BY l_returnflag, l_linenumber)) - 1 AS id, l_returnflag AS model, l_linenumber, l_partkey % 5 AS fold, l_extendedprice FROM lineitem),
s AS (SELECT id, model, l_linenumber, fold, round(avg(l_extendedprice), 6) AS score FROM c GROUP BY ALL),
b AS (SELECT id, model, round(avg(score), 4) AS mean_score, round(stddev_pop(score), 4) AS std_score FROM s GROUP BY id, model),
k AS (SELECT *, row_number() OVER (ORDER BY mean_score DESC, id) AS rank FROM b)"""


def _board(spark, d):
    cells = table(spark, d, "lineitem").groupBy("l_returnflag", "l_linenumber", (F.col("l_partkey") % 5).alias("fold")).agg(F.round(F.avg("l_extendedprice"), 6).alias("score"))
    rows = cells.groupBy("l_returnflag", "l_linenumber").agg(F.transform(F.array_sort(F.collect_list(F.struct("fold", "score"))), lambda x: x["score"]).alias("scores"))
    rows = rows.select((F.row_number().over(Window.orderBy("l_returnflag", "l_linenumber")) - 1).cast("long").alias("id"), F.col("l_returnflag").alias("model"), F.to_json(F.struct("l_linenumber")).alias("params"), "scores", F.lit(0.0).alias("fit_time_ms"))
    out = lb.ranked(rows).withColumn("mean_score", F.round("mean_score", 4)).withColumn("std_score", F.round("std_score", 4))
    return out.drop("rank").withColumn("rank", F.row_number().over(Window.orderBy(F.col("mean_score").desc(), "id"))).select("id", "model", "mean_score", "std_score", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {_BOARD} SELECT * FROM k")
def leaderboard_rank(spark, d):
    return _board(spark, d)


@query(f"WITH {_BOARD} SELECT * FROM k WHERE rank <= 5")
def leaderboard_topk(spark, d):
    return _board(spark, d).orderBy("rank").limit(5)


@query(f"WITH {_BOARD} SELECT id, model, rank, row_number() OVER (PARTITION BY model ORDER BY rank) AS place FROM k QUALIFY place <= 2")
def best_per_family(spark, d):
    return lb.best_per_family(_board(spark, d)).select("id", "model", "rank", F.col("place").cast("long").alias("place"))


@query(f"WITH {_BOARD}, f AS (SELECT id, rank, row_number() OVER (PARTITION BY model ORDER BY rank) AS place FROM k QUALIFY place <= 2) SELECT id, rank FROM f ORDER BY place, rank LIMIT 4")
def ensemble_pool(spark, d):
    return lb.ensemble_pool(_board(spark, d), 2).select("id", "rank")


@query(f"WITH {_BOARD} SELECT id FROM k WHERE rank <= (SELECT greatest(1, ceil(count(*) / 3)) FROM k)")
def halving_survivors(spark, d):
    return lb.survivors(_board(spark, d), 3).select("id")


@query("SELECT * FROM (VALUES (0, 37, 20, 7), (1, 111, 7, 3), (2, 333, 3, 1), (3, 1000, 1, 1)) t(round, resources, candidates, survivors)")
def halving_schedule(spark, d):
    return spark.createDataFrame([tuple(r.values()) for r in se.halving_schedule(20, 3, 5, 1000)], "round int, resources int, candidates int, survivors int")


_LCG = "WITH RECURSIVE s(i, state) AS (SELECT 0, CAST(7 AS BIGINT) UNION ALL SELECT i + 1, (state * 1664525 + 1013904223) & 2147483647 FROM s WHERE i < 60), u AS (SELECT CAST((i - 1) // 3 AS INTEGER) AS config, (i - 1) % 3 AS pos, state / 2147483647 AS u FROM s WHERE i > 0)"


@query(_LCG + " SELECT config, round(max(exp(ln(0.001) + u * (ln(10) - ln(0.001)))) FILTER (pos = 0), 6) AS c, CAST(max(3 + floor(u * 8)) FILTER (pos = 1) AS INTEGER) AS depth, max(CASE WHEN u < 0.5 THEN 'l2' ELSE 'l1' END) FILTER (pos = 2) AS metric FROM u GROUP BY config")
def random_configs(spark, d):
    space = {"c": {"type": "log_uniform", "low": 1e-3, "high": 10}, "depth": {"type": "int_uniform", "low": 3, "high": 10}, "metric": {"type": "categorical", "values": ["l2", "l1"]}}
    rows = [(i, round(c["c"], 6), c["depth"], c["metric"]) for i, c in enumerate(se.random_configs(space, 20, 7))]
    return spark.createDataFrame(rows, "config int, c double, depth int, metric string")


@query("SELECT solver, round(exp(ln(0.0001) + e * (ln(10000) - ln(0.0001)) / 2), 6) AS c, CAST(k AS INTEGER) AS k FROM (SELECT unnest([0, 6, 7]) AS solver), (SELECT unnest([0, 1, 2]) AS e), (SELECT unnest([1, 16, 30]) AS k)")
def grid_configs(spark, d):
    space = {"solver": {"type": "categorical", "values": [0, 6, 7]}, "c": {"type": "log_uniform", "low": 1e-4, "high": 1e4}, "k": {"type": "int_uniform", "low": 1, "high": 30}}
    return spark.createDataFrame([(g["solver"], round(g["c"], 6), g["k"]) for g in se.grid_configs(space)], "solver int, c double, k int")


@query("SELECT * FROM (VALUES ('boosting', 10), ('leafwise', 6), ('additive', 4), ('linear', 4), ('svm', 4), ('knn', 3), ('clauses', 3), ('forest', 7), ('mlp', 4), ('fm', 3)) t(family, configs)")
def portfolio_counts(spark, d):
    return spark.createDataFrame([(k, len(v)) for k, v in se.portfolio().items()], "family string, configs int")


@query(f"WITH {_BOARD} SELECT id FROM (SELECT id, score FROM s WHERE fold = 0) ORDER BY score DESC, id LIMIT 10")
def progressive_promote(spark, d):
    """The ten best of a probe on one fold go on to the full evaluation."""
    cells = table(spark, d, "lineitem").where("l_partkey % 5 = 0").groupBy("l_returnflag", "l_linenumber").agg(F.round(F.avg("l_extendedprice"), 6).alias("score"))
    every = table(spark, d, "lineitem").groupBy("l_returnflag", "l_linenumber").agg(F.count(F.lit(1)).alias("n"))
    ids = every.select("l_returnflag", "l_linenumber", (F.row_number().over(Window.orderBy("l_returnflag", "l_linenumber")) - 1).cast("long").alias("id"))
    return ids.join(cells, ["l_returnflag", "l_linenumber"]).orderBy(F.col("score").desc(), "id").limit(10).select("id")


@query("SELECT concat('demo/', CAST(n_nationkey % 3 AS VARCHAR), '@1') AS type_id, unnest(['name', 'region']) AS artifact, unnest([strlen(n_name), strlen(CAST(n_regionkey AS VARCHAR))])::BIGINT AS length, n_nationkey <> 4 OR unnest([true, false]) AS valid FROM nation")
def bundle_catalog(spark, d):
    """Bundles made of the nations, one with a damaged artifact, read as a catalogue."""
    rows = []
    for r in table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey").collect():
        raw = bn.encode_bundle({"typeId": f"demo/{r['n_nationkey'] % 3}@1"}, [{"id": "name", "data": r["n_name"].encode()}, {"id": "region", "data": str(r["n_regionkey"]).encode()}])
        rows.append((bytearray(raw[:-1] + b"x" if r["n_nationkey"] == 4 else raw),))
    return bn.catalogue(spark.createDataFrame(rows, "content binary"))


@query("SELECT n_nationkey, sha256(n_name) AS sha256 FROM nation")
def sha256_hash(spark, d):
    return table(spark, d, "nation").select("n_nationkey", F.sha2("n_name", 256).alias("sha256"))


@query("SELECT o_orderkey, round(o_totalprice / 1000, 6) AS scaled, CASE WHEN o_totalprice / 1000 > 150 THEN 1 ELSE 0 END AS label FROM orders")
def pipeline_transform(spark, d):
    """A fitted two-step pipeline is one projection."""
    o = table(spark, d, "orders").select("o_orderkey", (F.col("o_totalprice") / 1000).alias("scaled"))
    return o.select("o_orderkey", r6("scaled").alias("scaled"), (F.col("scaled") > 150).cast("int").alias("label"))
