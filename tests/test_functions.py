"""Hand-computed values of metrics, numbers and expressions."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lathe.errors import ValidationError
from lathe.functions import expressions as X
from lathe.functions import metrics as M
from lathe.functions import rng
from lathe.functions.ordered import global_rank, running_sums


def pairs(spark, y, p, s=None):
    return spark.createDataFrame([(i, a, b, c) for i, (a, b, c) in enumerate(zip(y, p, s or [0.0] * len(y), strict=True))], "i int, y int, p int, s double")


def test_sequence_and_shuffle():
    draw = rng.lcg(42)
    got = [draw() for _ in range(5)]
    assert got == pytest.approx([0.5046903498026963, 0.17625009090465033, 0.15456239653498047, 0.44510853218152585, 0.7513203945715541])
    assert rng.shuffled(list(range(10)), rng.lcg(42)) == [2, 7, 9, 6, 0, 4, 3, 8, 1, 5]


def test_hash_and_seed():
    assert rng.hash_text("test") == 802189797
    assert rng.seed_for("test", 0, 42) == 406503344


@given(st.lists(st.integers(), max_size=30), st.integers(0, 2**31 - 1), st.integers(0, 40))
def test_first_shuffled_is_a_sample(items, seed, k):
    got = rng.first_shuffled(items, k, rng.lcg(seed))
    assert len(got) == min(k, len(items))
    left = list(items)
    for x in got:
        left.remove(x)


def test_accuracy_and_scores(spark):
    df = pairs(spark, [0, 1, 0, 1], [0, 1, 1, 0])
    assert M.score(df, "y", "p") == 0.5
    r = M.precision_recall_f1(df, "y", "p").first()
    assert (r["precision"], r["recall"], r["f1"]) == (0.5, 0.5, 0.5)
    with pytest.raises(ValidationError):
        M.score(df.limit(0), "y", "p")
    with pytest.raises(ValidationError):
        M.scorer("nothing")


def test_regression_metrics(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 3.0), (3.0, 4.0)], "y double, p double")
    assert M.score(df, "y", "p", "neg_mse") == -1.0
    flat = spark.createDataFrame([(3.0, 1.0), (3.0, 2.0)], "y double, p double")
    assert M.score(flat, "y", "p", "r2") == 0.0
    mean = spark.createDataFrame([(float(i), 3.0) for i in range(1, 6)], "y double, p double")
    assert M.score(mean, "y", "p", "r2") == pytest.approx(0.0)


def test_multiclass(spark):
    df = pairs(spark, [0, 1, 2, 0, 1, 2], [0, 2, 1, 0, 2, 1])
    assert M.precision_recall_f1(df, "y", "p", "micro").first()["precision"] == pytest.approx(2 / 6)
    df = pairs(spark, [0, 1, 2, 0, 1, 2], [0, 1, 1, 0, 2, 2])
    assert M.precision_recall_f1(df, "y", "p", "macro").first()["f1"] == pytest.approx((1 + 0.5 + 0.5) / 3)
    with pytest.raises(ValidationError):
        M.precision_recall_f1(df, "y", "p", "binary")
    with pytest.raises(ValidationError):
        M.precision_recall_f1(df, "y", "p", "weird")


def test_confusion_fills_zeros(spark):
    got = {(r["truth"], r["predicted"]): r["n"] for r in M.confusion_matrix(pairs(spark, [0, 0, 1], [0, 1, 2]), "y", "p").collect()}
    assert got == {(t, p): int((t, p) in {(0, 0), (0, 1), (1, 2)}) for t in range(3) for p in range(3)}


def test_auc(spark):
    auc = lambda y, s: M.roc_auc(pairs(spark, y, y, s), "y", "s").first()["auc"]
    assert auc([0, 0, 1, 1], [0.1, 0.2, 0.8, 0.9]) == 1.0
    assert auc([1, 1, 0, 0], [0.1, 0.2, 0.8, 0.9]) == 0.0
    assert auc([0, 1, 0, 1], [0.5, 0.5, 0.2, 0.9]) == pytest.approx(0.875)
    with pytest.raises(ValidationError):
        auc([1, 1], [0.1, 0.2])


def test_log_loss(spark):
    df = spark.createDataFrame([(0.5,), (0.5,)], "p double")
    assert df.agg(M.log_loss(F.col("p")).alias("l")).first()["l"] == pytest.approx(math.log(2))


def test_class_weights(spark):
    got = {r["label"]: r["weight"] for r in M.balanced_class_weights(pairs(spark, [0, 0, 0, 1], [0] * 4), "y").collect()}
    assert got == {0: pytest.approx(4 / 6), 1: pytest.approx(2.0)}


def test_global_rank_and_running_sums(spark):
    df = spark.range(500)
    ranked = global_rank(df, rng.order_key(F.col("id"), 7), ["id"])
    want = sorted(range(500), key=lambda i: __import__("hashlib").md5(f"{i}:7".encode()).hexdigest())
    assert [r["id"] for r in ranked.orderBy("rank").collect()] == want
    run = running_sums(df.withColumn("v", F.lit(1)), "id", ["v"], descending=True)
    assert all(r["run_v"] == 500 - r["id"] for r in run.collect())


def test_expressions(spark):
    row = spark.createDataFrame([(1.0, 2.0, 3.0)], "a double, b double, c double")
    xs = [F.col(c) for c in "abc"]
    v = [[0.2], [1.0], [-1.0]]
    got = row.select(
        X.factorisation(xs, [0.1, -2, 3], 0.5, v).alias("n"), X.factorisation(xs, [0.1, -2, 3], 0.5, v, normalise=False).alias("r"),
        *[X.bin_index(F.lit(x), [1, 2, 3]).alias(f"b{i}") for i, x in enumerate((0.5, 1.0, 1.5, 3.0, 9.0))],
        X.bin_index(F.lit(None).cast("double"), [1, 2, 3]).alias("missing"), X.argmax([F.lit(0.4), F.lit(0.4), F.lit(0.2)]).alias("top"),
    ).first()
    assert got["n"] == pytest.approx(1.8313996806921398)
    assert got["r"] == pytest.approx(-0.6)
    assert [got[f"b{i}"] for i in range(5)] == [0, 1, 1, 3, 3]
    assert (got["missing"], got["top"]) == (4, 0)


def test_zero_row_of_a_factorisation(spark):
    row = spark.createDataFrame([(0.0, 0.0)], "a double, b double")
    assert row.select(X.factorisation([F.col("a"), F.col("b")], [1, 1], 0.25, [[1.0], [1.0]]).alias("z")).first()["z"] == 0.25


@settings(max_examples=20, deadline=None)
@given(st.integers(0, 2**31 - 1))
def test_sequence_stays_in_range(seed):
    draw = rng.lcg(seed)
    assert all(0 <= draw() <= 1 for _ in range(50))
