"""Metrics, scalers, preprocessing and task detection over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lathe.functions import metrics as M
from lathe.operators import frames as fr
from lathe.operators.scaling import MinMaxScaler, Preprocessor, StandardScaler, column_types, quantile_thresholds
from lathe.plans.util import query, r6, rounded
from lathe.session import table

NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "constant"]


def lines(spark, d):
    return table(spark, d, "lineitem").withColumn("constant", 0 * F.col("l_tax"))


def _each(template: str, sep: str = ", ") -> str:
    return sep.join(template.format(c=c) for c in NUMBERS)


_LINES = "l AS (SELECT *, 0 * l_tax AS constant FROM lineitem)"


@query(f"WITH {_LINES} " + _each("SELECT '{c}' AS feature, round(avg({c}), 7) AS mean, round(coalesce(stddev_samp({c}), 0), 7) AS std FROM l", " UNION ALL "))
def standard_scaler_fit(spark, d):
    s = StandardScaler(NUMBERS).fit(lines(spark, d))
    return rounded(spark.createDataFrame([(c, *s.state[c]) for c in NUMBERS], "feature string, mean double, std double"), "mean", "std", digits=7)


@query(f"WITH {_LINES}, s AS (SELECT " + _each("avg({c}) AS m_{c}, stddev_samp({c}) AS s_{c}") + " FROM l) SELECT l_orderkey, l_linenumber, " + _each("round(CASE WHEN s_{c} > 0 THEN ({c} - m_{c}) / s_{c} ELSE 0 END, 6) AS {c}") + " FROM l, s")
def standard_scaler_transform(spark, d):
    df = StandardScaler(NUMBERS).fit_transform(lines(spark, d))
    return rounded(df.select("l_orderkey", "l_linenumber", *NUMBERS), *NUMBERS)


@query(f"WITH {_LINES} " + _each("SELECT '{c}' AS feature, round(min({c}), 6) AS low, round(max({c}), 6) AS high FROM l WHERE l_linenumber <= 3", " UNION ALL "))
def minmax_scaler_fit(spark, d):
    s = MinMaxScaler(NUMBERS).fit(lines(spark, d).where("l_linenumber <= 3"))
    return rounded(spark.createDataFrame([(c, *s.state[c]) for c in NUMBERS], "feature string, low double, high double"), "low", "high")


@query(f"WITH {_LINES}, s AS (SELECT " + _each("min({c}) AS a_{c}, max({c}) AS b_{c}") + " FROM l WHERE l_linenumber <= 3) SELECT l_orderkey, l_linenumber, " + _each("round(CASE WHEN b_{c} > a_{c} THEN ({c} - a_{c}) / (b_{c} - a_{c}) ELSE 0 END, 6) AS {c}") + " FROM l, s")
def minmax_scaler_transform(spark, d):
    df = lines(spark, d)
    out = MinMaxScaler(NUMBERS).fit(df.where("l_linenumber <= 3")).transform(df)
    return rounded(out.select("l_orderkey", "l_linenumber", *NUMBERS), *NUMBERS)


_TYPED = ["l_quantity", "l_discount", "l_linenumber", "l_tax", "l_suppkey"]


@query(" UNION ALL ".join(f"SELECT '{c}' AS feature, count(DISTINCT {c}) AS n_distinct, CASE WHEN max(CASE WHEN {c} <> floor({c}) THEN 1 ELSE 0 END) = 0 AND count(DISTINCT {c}) BETWEEN 2 AND 20 THEN 'categorical' ELSE 'numeric' END AS kind FROM lineitem" for c in _TYPED))
def infer_column_types(spark, d):
    return column_types(table(spark, d, "lineitem"), _TYPED)


_HOLES = "h AS (SELECT p_partkey, nullif(p_retailprice, (SELECT min(p_retailprice) FROM part)) AS price, CASE WHEN p_size % 9 <> 4 THEN CAST(p_size % 7 AS DOUBLE) END AS grade, CASE WHEN p_size % 5 <> 1 THEN CAST(p_size AS DOUBLE) END AS size FROM part)"


def holes(spark, d):
    p = table(spark, d, "part")
    least = p.agg(F.min("p_retailprice").alias("m"))
    return p.crossJoin(F.broadcast(least)).select(
        "p_partkey",
        F.nullif("p_retailprice", "m").alias("price"),
        F.when(F.col("p_size") % 9 != 4, (F.col("p_size") % 7).cast("double")).alias("grade"),
        F.when(F.col("p_size") % 5 != 1, F.col("p_size").cast("double")).alias("size"),
    )


@query(f"WITH {_HOLES} SELECT p_partkey, round(coalesce(price, (SELECT avg(price) FROM h)), 6) AS price, round(coalesce(size, (SELECT avg(size) FROM h)), 6) AS size FROM h")
def impute_mean(spark, d):
    df = holes(spark, d).select("p_partkey", "price", "size")
    return rounded(Preprocessor(["price", "size"], encode=False).fit_transform(df), "price", "size")


@query(f"WITH {_HOLES} SELECT p_partkey, coalesce(grade, (SELECT grade FROM h WHERE grade IS NOT NULL GROUP BY grade ORDER BY count(*) DESC, grade LIMIT 1)) AS grade FROM h")
def impute_mode(spark, d):
    df = holes(spark, d).select("p_partkey", "grade")
    p = Preprocessor(["grade"], encode="label").fit(df)
    return df.select("p_partkey", F.coalesce("grade", F.lit(p.plans[0].fill)).alias("grade"))


@query(f"WITH {_HOLES} SELECT p_partkey, round(coalesce(size, (SELECT quantile_cont(size, 0.5) FROM h)), 6) AS size FROM h")
def impute_median(spark, d):
    df = holes(spark, d).select("p_partkey", "size")
    return rounded(Preprocessor(["size"], encode=False, impute="median").fit_transform(df), "size")


@query(f"WITH {_HOLES} SELECT p_partkey, coalesce(size, 0.0::DOUBLE) AS size FROM h")
def impute_zero(spark, d):
    return Preprocessor(["size"], encode=False, impute="zero").fit_transform(holes(spark, d).select("p_partkey", "size"))


_CODES = "c AS (SELECT p_partkey, CAST(p_size % 7 AS DOUBLE) AS code FROM part), k AS (SELECT code, CAST(row_number() OVER (ORDER BY code) - 1 AS DOUBLE) AS place FROM (SELECT DISTINCT code FROM c WHERE code < 5))"


def _codes(spark, d):
    return table(spark, d, "part").select("p_partkey", (F.col("p_size") % 7).cast("double").alias("code"))


@query(f"WITH {_CODES} SELECT p_partkey, coalesce(place, -1.0::DOUBLE) AS code FROM c LEFT JOIN k USING (code)")
def label_encode(spark, d):
    df = _codes(spark, d)
    return Preprocessor(["code"], encode="label").fit(df.where("code < 5")).transform(df)


@query(f"WITH {_CODES} SELECT p_partkey, " + ", ".join(f"CASE WHEN code = {v} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS code_{v}" for v in range(5)) + " FROM c")
def one_hot_encode(spark, d):
    df = _codes(spark, d)
    return Preprocessor(["code"]).fit(df.where("code < 5")).transform(df)


@query("SELECT l_orderkey, l_linenumber, round((l_quantity - (SELECT avg(l_quantity) FROM lineitem)) / (SELECT stddev_pop(l_quantity) FROM lineitem), 6) AS l_quantity, round((l_tax - (SELECT avg(l_tax) FROM lineitem)) / (SELECT stddev_pop(l_tax) FROM lineitem), 6) AS l_tax FROM lineitem")
def preprocess_scale_pop(spark, d):
    df = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_tax")
    return rounded(Preprocessor(["l_quantity", "l_tax"], scale="standard").fit_transform(df), "l_quantity", "l_tax")


@query(f"""WITH {_HOLES}, g AS (SELECT p_partkey, coalesce(price, (SELECT avg(price) FROM h)) AS price, coalesce(grade, (SELECT grade FROM h WHERE grade IS NOT NULL GROUP BY grade ORDER BY count(*) DESC, grade LIMIT 1)) AS grade FROM h)
SELECT p_partkey, round((price - (SELECT min(price) FROM h)) / (SELECT max(price) - min(price) FROM h), 6) AS price, """ + ", ".join(f"CASE WHEN grade = {v} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS grade_{v}" for v in range(7)) + " FROM g")
def preprocess_full(spark, d):
    df = holes(spark, d).select("p_partkey", "price", "grade")
    return rounded(Preprocessor(["price", "grade"], scale="minmax").fit_transform(df), "price")


@query("""SELECT 'l_discount' AS label, CASE WHEN max(CASE WHEN l_discount <> floor(l_discount) THEN 1 ELSE 0 END) = 1 OR count(DISTINCT l_discount) > 20 THEN 'regression' ELSE 'classification' END AS task FROM lineitem
UNION ALL SELECT 'l_linenumber', 'classification' UNION ALL SELECT 'l_quantity', CASE WHEN max(CASE WHEN l_quantity <> floor(l_quantity) THEN 1 ELSE 0 END) = 1 OR count(DISTINCT l_quantity) > 20 THEN 'regression' ELSE 'classification' END FROM lineitem""")
def detect_task(spark, d):
    df = table(spark, d, "lineitem")
    return spark.createDataFrame([(c, fr.detect_task(df, c)) for c in ("l_discount", "l_linenumber", "l_quantity")], "label string, task string")


@query("SELECT o_orderkey, o_custkey::DOUBLE AS o_custkey, CASE WHEN o_totalprice < 50000 THEN NULL ELSE o_totalprice END AS price FROM orders")
def normalise_columns(spark, d):
    o = table(spark, d, "orders")
    nan = o.select("o_orderkey", "o_custkey", F.when(F.col("o_totalprice") < 50000, F.lit(float("nan"))).otherwise(F.col("o_totalprice")).alias("price"))
    return fr.normalise(nan, ["o_custkey", "price"])


# Metrics of a fixed rule on documents with labels (classes), and on orders (numbers).
_JUDGED = "j AS (SELECT doc_id, quality AS y, CASE WHEN n_chars > 800 THEN 1 ELSE 0 END AS p, round(1 / (1 + exp(-(n_chars - 1500) / 1000.0)), 9) AS s FROM documents JOIN labels USING (doc_id))"
_THREE = "j AS (SELECT vec_id, label AS y, CASE WHEN vec_id % 4 = 0 THEN (label + 1) % 10 WHEN vec_id % 7 = 0 THEN (label + 3) % 10 ELSE label END AS p FROM embeddings)"
_PRICED = "j AS (SELECT o_orderkey, o_totalprice AS y, 0.9 * o_totalprice + o_custkey AS p FROM orders)"


def judged(spark, d):
    df = table(spark, d, "documents").select("doc_id", "n_chars").join(table(spark, d, "labels"), "doc_id")
    return df.select("doc_id", F.col("quality").alias("y"), (F.col("n_chars") > 800).cast("int").alias("p"), F.round(1 / (1 + F.exp(-(F.col("n_chars") - 1500) / 1000.0)), 9).alias("s"))


def ten(spark, d):
    v, lab = F.col("vec_id"), F.col("label")
    return table(spark, d, "embeddings").select("vec_id", lab.alias("y"), F.when(v % 4 == 0, (lab + 1) % 10).when(v % 7 == 0, (lab + 3) % 10).otherwise(lab).alias("p"))


def priced(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("y"), (0.9 * F.col("o_totalprice") + F.col("o_custkey")).alias("p"))


@query(f"WITH {_JUDGED} SELECT round(avg(CASE WHEN y = p THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM j")
def accuracy(spark, d):
    return judged(spark, d).agg(r6(M.accuracy("y", "p")).alias("accuracy"))


_REGRESSION = "round(1 - avg((y - p) ** 2) / var_pop(y), 6) AS r2, round(avg((y - p) ** 2), 2) AS mse, round(avg(abs(y - p)), 4) AS mae"


@query(f"WITH {_PRICED} SELECT {_REGRESSION} FROM j")
def regression_metrics(spark, d):
    return priced(spark, d).agg(r6(M.r2("y", "p")).alias("r2"), r6(M.mse("y", "p"), 2).alias("mse"), r6(M.mae("y", "p"), 4).alias("mae"))


@query(f"WITH {_PRICED} SELECT 0.0::DOUBLE AS r2_constant, round(-avg((y - p) ** 2), 2) AS neg_mse, round(-avg(abs(y - p)), 4) AS neg_mae FROM j")
def negated_scores(spark, d):
    df = priced(spark, d).withColumn("c", F.lit(3.0))
    return df.agg(M.scorer("r2")("c", "p").alias("r2_constant"), r6(M.scorer("neg_mse")("y", "p"), 2).alias("neg_mse"), r6(M.scorer("neg_mae")("y", "p"), 4).alias("neg_mae"))


@query(f"WITH {_THREE}, u AS (SELECT y AS v FROM j UNION SELECT p FROM j) SELECT a.v AS truth, b.v AS predicted, (SELECT count(*) FROM j WHERE y = a.v AND p = b.v) AS n FROM u a, u b")
def confusion_matrix(spark, d):
    return M.confusion_matrix(ten(spark, d), "y", "p")


_EACH = """u AS (SELECT y AS v FROM j UNION SELECT p FROM j), c AS (SELECT v AS label, count(*) FILTER (y = v AND p = v) AS tp, count(*) FILTER (p = v AND y <> v) AS fp, count(*) FILTER (y = v AND p <> v) AS fn FROM u, j GROUP BY v),
e AS (SELECT label, tp, fp, fn, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS precision, CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS recall FROM c),
f AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM e)"""
_PRF = ", ".join(f"round({{0}}({c}), 6) AS {c}" for c in ("precision", "recall", "f1"))


@query(f"WITH {_THREE}, {_EACH} SELECT label, tp, fp, fn FROM c")
def class_counts(spark, d):
    return M.class_counts(ten(spark, d), "y", "p")


@query(f"WITH {_JUDGED}, {_EACH} SELECT round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM f WHERE label = 1")
def precision_recall_f1_binary(spark, d):
    return rounded(M.precision_recall_f1(judged(spark, d), "y", "p", "binary"), "precision", "recall", "f1")


@query(f"WITH {_THREE}, {_EACH} SELECT {_PRF.format('avg')} FROM f")
def precision_recall_f1_macro(spark, d):
    return rounded(M.precision_recall_f1(ten(spark, d), "y", "p", "macro"), "precision", "recall", "f1")


@query(f"WITH {_THREE}, {_EACH} SELECT round(sum(tp) / (sum(tp) + sum(fp)), 6) AS precision, round(sum(tp) / (sum(tp) + sum(fn)), 6) AS recall, round(2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 6) AS f1 FROM f")
def precision_recall_f1_micro(spark, d):
    return rounded(M.precision_recall_f1(ten(spark, d), "y", "p", "micro"), "precision", "recall", "f1")


@query(f"WITH {_JUDGED} SELECT round(avg(-ln(greatest(1e-15, least(1 - 1e-15, CASE WHEN y = 1 THEN s ELSE 1 - s END)))), 6) AS log_loss FROM j")
def log_loss(spark, d):
    own = F.when(F.col("y") == 1, F.col("s")).otherwise(1 - F.col("s"))
    return judged(spark, d).agg(r6(M.log_loss(own)).alias("log_loss"))


@query(f"WITH {_JUDGED}, r AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2 AS k FROM j) SELECT round((sum(k) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)), 6) AS auc FROM r")
def roc_auc(spark, d):
    return rounded(M.roc_auc(judged(spark, d), "y", "s"), "auc")


@query("SELECT quality AS label, round((SELECT count(*) FROM labels) / (2.0 * count(*)), 6) AS weight FROM labels GROUP BY quality")
def class_weights_balanced(spark, d):
    return rounded(M.balanced_class_weights(table(spark, d, "labels"), "quality"), "weight")


@query("SELECT DISTINCT label FROM embeddings")
def class_discovery(spark, d):
    return table(spark, d, "embeddings").select("label").distinct()


@query("SELECT round(unnest(quantile_cont(p_retailprice, [0.25, 0.5, 0.75])), 6) AS threshold FROM part")
def clause_thresholds(spark, d):
    return spark.createDataFrame([(round(t, 6),) for t in quantile_thresholds(table(spark, d, "part"), "p_retailprice", 3)], "threshold double")
