"""Row-local scorers with fixed models: linear, factorisation, additive, clauses, trees, networks."""

from __future__ import annotations

from pyspark.sql import functions as F

from lathe.functions import expressions as X
from lathe.plans.util import query, r6
from lathe.session import table

_KEYS = "l_orderkey, l_linenumber"


def _lines(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")


def _xs():
    return [F.col("l_quantity") / 50.0, F.col("l_discount") * 10.0, F.col("l_tax") * 10.0]


_A, _B, _C = "(l_quantity / 50.0)", "(l_discount * 10.0)", "(l_tax * 10.0)"
_LINE = f"(0.5 + 1.5 * {_A} - 0.7 * {_B} + 0.2 * {_C})"


@query(f"SELECT {_KEYS}, round({_LINE}, 6) + 0.0::DOUBLE AS score, round(1 / (1 + exp(-{_LINE})), 6) AS p, CASE WHEN 1 / (1 + exp(-{_LINE})) > 0.5 THEN 1 ELSE 0 END AS label FROM lineitem")
def linear_score(spark, d):
    z = X.linear(_xs(), [1.5, -0.7, 0.2], 0.5)
    return _lines(spark, d).select("l_orderkey", "l_linenumber", r6(z).alias("score"), r6(X.sigmoid(z)).alias("p"), (X.sigmoid(z) > 0.5).cast("int").alias("label"))


_NORM = f"CASE WHEN {_A} * {_A} + {_B} * {_B} + {_C} * {_C} = 0 THEN 1.0 ELSE 1 / ({_A} * {_A} + {_B} * {_B} + {_C} * {_C}) END"


@query(f"""WITH n AS (SELECT {_KEYS}, {_A} AS a, {_B} AS b, {_C} AS c, {_NORM} AS inv FROM lineitem)
SELECT {_KEYS}, round(0.5 + (0.1 * a - 2 * b + 3 * c) * sqrt(inv) + 0.5 * inv * inv * ((0.2 * a + b - c) ** 2 - 0.04 * a * a - b * b - c * c + (0.3 * a - 0.5 * b + 0.4 * c) ** 2 - 0.09 * a * a - 0.25 * b * b - 0.16 * c * c), 6) AS score FROM n""")
def fm_score(spark, d):
    z = X.factorisation(_xs(), [0.1, -2.0, 3.0], 0.5, [[0.2, 0.3], [1.0, -0.5], [-1.0, 0.4]])
    return _lines(spark, d).select("l_orderkey", "l_linenumber", r6(z).alias("score"))


@query(f"""WITH n AS (SELECT {_KEYS}, {_A} AS a, {_B} AS b, {_C} AS c, {_NORM} AS inv FROM lineitem)
SELECT {_KEYS}, round(-0.25 + (0.1 * a - 2 * b + 3 * c) * sqrt(inv) + inv * inv * (a * b * (0.5 * 0.3 + 0.1 * 0.2) + a * c * (0.5 * 0.7 - 0.1 * 0.4) + b * c * (0.6 * 0.7 - 0.2 * 0.4)), 6) AS score FROM n""")
def ffm_score(spark, d):
    factors = [{0: [0.9, 0.9], 1: [0.5, 0.1]}, {0: [0.3, 0.2], 1: [0.6, 0.2]}, {0: [0.7, -0.4], 1: [0.7, -0.4]}]
    z = X.field_aware(_xs(), [0, 1, 1], [0.1, -2.0, 3.0], -0.25, factors)
    return _lines(spark, d).select("l_orderkey", "l_linenumber", r6(z).alias("score"))


_Z = [f"({_A} - {_B})", f"(0.5 * {_C})", f"({_B} - 0.3)"]


@query(f"WITH z AS (SELECT {_KEYS}, exp({_Z[0]}) AS a, exp({_Z[1]}) AS b, exp({_Z[2]}) AS c FROM lineitem), p AS (SELECT {_KEYS}, round(a / (a + b + c), 9) AS p0, round(b / (a + b + c), 9) AS p1, round(c / (a + b + c), 9) AS p2 FROM z) SELECT *, CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END AS label FROM p")
def softmax_proba(spark, d):
    a, b, c = _xs()
    ps = [F.round(p, 9) for p in X.softmax([a - b, 0.5 * c, b - 0.3])]
    return _lines(spark, d).select("l_orderkey", "l_linenumber", *[p.alias(f"p{i}") for i, p in enumerate(ps)]).withColumn("label", X.argmax([F.col(f"p{i}") for i in range(3)]))


_CUTS = [10.0, 20.0, 30.0, 45.0]
_TERM = [-0.8, -0.1, 0.3, 0.9, 1.4, 0.0]
_GRID = [[-0.2, 0.1], [0.0, 0.3], [0.25, -0.4], [0.1, 0.2], [0.5, 0.6], [0.0, 0.0]]
_BIN = "(CASE WHEN p_size IS NULL THEN 5 ELSE " + " + ".join(f"(CASE WHEN p_size >= {c} THEN 1 ELSE 0 END)" for c in _CUTS) + " END)"
_SIDE = "(CASE WHEN p_retailprice >= 1500 THEN 1 ELSE 0 END)"
_TERM_SQL = "(CASE " + _BIN + " " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(_TERM)) + " END)"
_GRID_SQL = "(CASE " + f"{_BIN} * 2 + {_SIDE} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(x for r in _GRID for x in r)) + " END)"


def _additive(spark, d):
    size = F.when(F.col("p_size") % 11 != 0, F.col("p_size").cast("double"))
    df = table(spark, d, "part").select("p_partkey", size.alias("p_size"), "p_retailprice")
    at = X.bin_index(F.col("p_size"), _CUTS)
    side = X.bin_index(F.col("p_retailprice"), [1500.0])
    return df.withColumn("bin", at.cast("int")).withColumn("term", X.pick(_TERM, at)).withColumn("pair", X.pick([x for r in _GRID for x in r], at * 2 + side))


_PARTS = "s AS (SELECT p_partkey, CASE WHEN p_size % 11 <> 0 THEN p_size END AS p_size, p_retailprice FROM part)"


@query(f"WITH {_PARTS} SELECT p_partkey, CAST({_BIN} AS INTEGER) AS bin FROM s")
def additive_bins(spark, d):
    return _additive(spark, d).select("p_partkey", "bin")


@query(f"WITH {_PARTS} SELECT p_partkey, round((0.1 + {_TERM_SQL} + {_GRID_SQL})::DOUBLE, 6) + 0.0::DOUBLE AS margin, round(1 / (1 + exp(-(0.1 + {_TERM_SQL} + {_GRID_SQL}))), 6) AS p FROM s")
def additive_score(spark, d):
    z = 0.1 + F.col("term") + F.col("pair")
    return _additive(spark, d).select("p_partkey", r6(z).alias("margin"), r6(X.sigmoid(z)).alias("p"))


@query(f"WITH {_PARTS} SELECT p_partkey, 'size' AS term, round({_TERM_SQL}::DOUBLE, 6) AS contribution FROM s UNION ALL SELECT p_partkey, 'size x price', round({_GRID_SQL}::DOUBLE, 6) FROM s")
def additive_explain(spark, d):
    each = F.array(F.struct(F.lit("size").alias("term"), r6("term").alias("contribution")), F.struct(F.lit("size x price").alias("term"), r6("pair").alias("contribution")))
    return _additive(spark, d).select("p_partkey", F.explode(each).alias("x")).select("p_partkey", "x.*")


@query("SELECT 'size' AS term, round((0.8 + 0.1 + 0.3 + 0.9 + 1.4 + 0) / 6, 6)::DOUBLE AS importance UNION ALL SELECT 'size x price', round((0.2 + 0.1 + 0 + 0.3 + 0.25 + 0.4 + 0.1 + 0.2 + 0.5 + 0.6 + 0 + 0) / 12, 6)::DOUBLE")
def additive_importance(spark, d):
    rows = [("size", float(v)) for v in _TERM] + [("size x price", float(v)) for r in _GRID for v in r]
    return spark.createDataFrame(rows, "term string, score double").groupBy("term").agg(r6(F.avg(F.abs("score"))).alias("importance"))


_BITS = "(CASE WHEN p_size > 15 THEN 1 ELSE 8 END) + (CASE WHEN p_size > 30 THEN 2 ELSE 16 END) + (CASE WHEN p_retailprice > 1400 THEN 4 ELSE 32 END)"
_CLAUSES = [1, 5, 0, 40, 16, 2]


def _bits():
    return X.literals([F.col("p_size"), F.col("p_retailprice")], [[15, 30], [1400]])


@query(f"SELECT p_partkey, CAST({_BITS} AS BIGINT) AS bits FROM part")
def clause_binarize(spark, d):
    return table(spark, d, "part").select("p_partkey", _bits().alias("bits"))


def _clause(m: int, sign: str) -> str:
    return f" {sign} (CASE WHEN {m} <> 0 AND (b & {m}) = {m} THEN 1 ELSE 0 END)"


@query(f"WITH x AS (SELECT p_partkey, CAST({_BITS} AS BIGINT) AS b FROM part), v AS (SELECT p_partkey, 0" + "".join(_clause(m, "+" if i < 3 else "-") for i, m in enumerate(_CLAUSES)) + " AS v FROM x) SELECT p_partkey, CAST(v AS BIGINT) AS votes, round(10 + greatest(0, least(2, v)) / 2.0 * 40, 6)::DOUBLE AS scaled FROM v")
def clause_votes(spark, d):
    votes = X.clause_votes(_bits(), _CLAUSES)
    scaled = 10.0 + F.greatest(F.lit(0), F.least(F.lit(2), F.col("votes"))) / 2.0 * 40.0
    return table(spark, d, "part").select("p_partkey", votes.alias("votes")).withColumn("scaled", r6(scaled))


_TREES = [("l_quantity", 25, ("l_discount", 0.05, 1.0, 2.0), 3.0), ("l_tax", 0.03, -1.0, ("l_quantity", 10, 0.5, 4.0)), 0.25]
_TREE_SQL = ["CASE WHEN l_quantity <= 25 THEN CASE WHEN l_discount <= 0.05 THEN 1.0 ELSE 2.0 END ELSE 3.0 END", "CASE WHEN l_tax <= 0.03 THEN -1.0 ELSE CASE WHEN l_quantity <= 10 THEN 0.5 ELSE 4.0 END END"]


@query(f"SELECT {_KEYS}, ({_TREE_SQL[0]})::DOUBLE AS leaf FROM lineitem")
def tree_traverse(spark, d):
    return _lines(spark, d).select("l_orderkey", "l_linenumber", X.tree(_TREES[0], {c: F.col(c) for c in ("l_quantity", "l_discount", "l_tax")}).alias("leaf"))


@query(f"SELECT {_KEYS}, round((({_TREE_SQL[0]}) + ({_TREE_SQL[1]}) + 0.25) / 3.0 * 1.7 + 0.4, 6)::DOUBLE AS prediction FROM lineitem")
def forest_mean(spark, d):
    return _lines(spark, d).select("l_orderkey", "l_linenumber", r6(X.forest_mean(_TREES, {c: F.col(c) for c in ("l_quantity", "l_discount", "l_tax")}, 1.7, 0.4)).alias("prediction"))


@query(f"SELECT {_KEYS}, CASE WHEN {_LINE} >= 1.10037 THEN 1 ELSE 0 END AS label FROM lineitem")
def probit_label(spark, d):
    """A probit's label needs no error function: it is the sign of the margin."""
    return _lines(spark, d).select("l_orderkey", "l_linenumber", (X.linear(_xs(), [1.5, -0.7, 0.2], 0.5) - 1.10037 >= 0).cast("int").alias("label"))


@query(f"WITH h AS (SELECT {_KEYS}, greatest(0, {_A} - {_B} + 0.1) AS h0, greatest(0, -{_A} + 2 * {_C}) AS h1 FROM lineitem) SELECT {_KEYS}, round(0.3 + 1.2 * h0 - 0.6 * h1, 6) + 0.0::DOUBLE AS output FROM h")
def mlp_forward(spark, d):
    hidden = [X.relu(h) for h in X.dense(_xs(), [[1, -1, 0], [-1, 0, 2]], [0.1, 0.0])]
    return _lines(spark, d).select("l_orderkey", "l_linenumber", r6(X.dense(hidden, [[1.2, -0.6]], [0.3])[0]).alias("output"))


@query("SELECT o_orderkey, n_both, n_0 + n_1 - 2 * n_both AS n_one, round((n_0 + n_1) / 2.0 / greatest(1, n - 1), 6)::DOUBLE AS mean_proximity FROM (SELECT o_orderkey, count(*) OVER (PARTITION BY o_orderkey % 7, o_orderkey % 5) - 1 AS n_both, count(*) OVER (PARTITION BY o_orderkey % 7) - 1 AS n_0, count(*) OVER (PARTITION BY o_orderkey % 5) - 1 AS n_1, count(*) OVER () AS n FROM orders)")
def forest_proximity(spark, d):
    """For every row: how many others share its leaf in both trees or in one, and the mean proximity.

    From the sizes of leaves and of their meets, so no pairs are made.
    """
    rows = table(spark, d, "orders").select("o_orderkey", *[(F.col("o_orderkey") % m).alias(f"t{i}") for i, m in enumerate((7, 5))])
    sizes = rows.groupBy("t0", "t1").agg(F.count(F.lit(1)).alias("both")).toDF("t0", "t1", "both")
    zero, one = (sizes.groupBy(t).agg(F.sum("both").alias(f"in_{t}")) for t in ("t0", "t1"))
    every = sizes.agg(F.sum("both").alias("every"))
    named = sizes.join(F.broadcast(zero), "t0").join(F.broadcast(one), "t1").crossJoin(F.broadcast(every))
    both, first, second = F.col("both") - 1, F.col("in_t0") - 1, F.col("in_t1") - 1
    mean = (first + second) / 2.0 / F.greatest(F.lit(1), F.col("every") - 1)
    return rows.join(F.broadcast(named), ["t0", "t1"]).select("o_orderkey", both.alias("n_both"), (first + second - 2 * both).alias("n_one"), r6(mean).alias("mean_proximity"))
