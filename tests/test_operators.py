"""Scalers, preprocessing, folds, neighbours, ensembles, search, bundles and pipelines."""

import itertools
import json
import math
import struct
import tracemalloc

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Row
from pyspark.sql import functions as F

from lathe.errors import BundleError, DisposedError, NotFittedError, RegistryError, ValidationError
from lathe.functions import expressions
from lathe.operators import automl as am
from lathe.operators import distributed as ds
from lathe.operators import ensembles as en
from lathe.operators import estimators as es
from lathe.operators import frames as fr
from lathe.operators import leaderboard as lb
from lathe.operators import neighbours as nn
from lathe.operators import search as se
from lathe.operators.estimators import FAMILIES, create
from lathe.operators.pipeline import Pipeline
from lathe.operators.scaling import MinMaxScaler, Preprocessor, Scaler, StandardScaler, column_types, quantile_thresholds
from lathe.plans.catalogue import QUERIES
from lathe.sources import bundle as bn
from lathe.sources.registry import load, register


@pytest.fixture(scope="module")
def four(spark):
    return spark.createDataFrame([(i, float(i), 10.0 * i, 7.0) for i in range(1, 5)], "id int, a double, b double, c double")


def test_standard_scaler(four):
    s = StandardScaler(["a", "b", "c"]).fit(four)
    assert s.state["a"] == pytest.approx([2.5, 1.29099445])
    got = [tuple(r) for r in s.transform(four).orderBy("id").select("a", "c").collect()]
    assert [g[0] for g in got] == pytest.approx([-1.161895, -0.387298, 0.387298, 1.161895], abs=1e-6)
    assert all(g[1] == 0 for g in got)
    assert StandardScaler(["a"]).fit_transform(four.limit(1)).first()["a"] == 0
    with pytest.raises(ValidationError):
        s.fit(four.limit(0))
    with pytest.raises(NotFittedError):
        StandardScaler(["a"]).transform(four)
    assert Scaler.from_state(json.loads(json.dumps(s.get_state()))).transform(four).count() == 4


def test_minmax_scaler_does_not_clip(four):
    s = MinMaxScaler(["a", "c"]).fit(four.where("id <= 3"))
    got = {r["id"]: (r["a"], r["c"]) for r in s.transform(four).collect()}
    assert got[4] == (1.5, 0.0) and got[1] == (0.0, 0.0)


def test_preprocessor(spark):
    df = spark.createDataFrame([(1, 1.0, 0.5), (2, 2.0, None), (3, 2.0, 2.5), (4, None, 3.0)], "id int, g double, x double")
    p = Preprocessor(["g", "x"], scale="standard").fit(df)
    assert p.output_columns == ["g_1", "g_2", "x"]
    got = {r["id"]: (r["g_1"], r["g_2"], r["x"]) for r in p.transform(df).collect()}
    assert got[4][:2] == (0.0, 1.0) and got[2][2] == pytest.approx(0.0)
    new = spark.createDataFrame([(9, 5.0, 1.0)], "id int, g double, x double")
    assert p.transform(new).select("g_1", "g_2").first() == (0.0, 0.0)
    assert Preprocessor(["g"], encode="label").fit(df).transform(new).first()["g"] == -1.0
    q = Preprocessor.from_state(json.loads(json.dumps(p.get_state())))
    assert q.transform(df).collect() == p.transform(df).collect()
    assert Preprocessor(["x"], encode=False, impute="median").fit(df).plans[0].fill == 2.5
    with pytest.raises(ValidationError):
        Preprocessor(["x"], impute="what")


def test_all_missing_and_constant_columns(spark):
    df = spark.createDataFrame([(1, None, 3.0), (2, None, 3.0)], "id int, m double, c double")
    got = Preprocessor(["m", "c"], scale="minmax").fit_transform(df).collect()
    assert [r["m"] for r in got] == [None, None] and [r["c"] for r in got] == [0.0, 0.0]
    kinds = {r["feature"]: r["kind"] for r in column_types(df, ["m", "c"]).collect()}
    assert kinds == {"m": "numeric", "c": "numeric"}


def test_detect_task(spark):
    task = lambda v, t: fr.detect_task(spark.createDataFrame([(x,) for x in v], f"y {t}"), "y")
    assert task([float(i) for i in range(100)], "double") == "regression"
    assert task([0.0, 1.0, 2.0, 0.0], "double") == "classification"
    assert task([1.5, 2.0], "double") == "regression"
    assert task(list(range(100)), "int") == "classification"


def test_normalise(spark):
    df = spark.createDataFrame([(1, float("nan"), 2)], "id int, x double, k int")
    got = fr.normalise(df, ["x", "k"]).first()
    assert got["x"] is None and got["k"] == 2.0
    with pytest.raises(ValidationError):
        fr.normalise(df, ["k"], "error")


@settings(max_examples=6, deadline=None)
@given(st.integers(5, 60), st.integers(2, 5), st.integers(0, 1000))
def test_folds_partition(spark, n, k, seed):
    df = spark.range(n).withColumn("y", F.col("id") % 3)
    plain = [r["fold"] for r in fr.k_fold(df, "id", k, seed).collect()]
    sizes = np.bincount(plain, minlength=k)
    assert len(plain) == n and sizes.max() - sizes.min() <= 1 and list(sizes) == sorted(sizes, reverse=True)
    strat = fr.stratified_k_fold(df, "id", "y", k, seed).collect()
    for c in range(3):
        s = np.bincount([r["fold"] for r in strat if r["y"] == c], minlength=k)
        assert s.max() - s.min() <= 1


def test_split_and_subsample(spark):
    df = spark.range(10)
    assert fr.train_test_split(df, "id").where("is_test").count() == 2
    assert fr.subsample(df, "id", 0.25).count() == 3
    with pytest.raises(ValidationError):
        fr.train_test_split(spark.range(1), "id")
    with pytest.raises(ValidationError):
        fr.k_fold(df, "id", 11)


def test_neighbours_against_numpy(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(60, 4))
    df = spark.createDataFrame([(i, v.tolist(), int(i % 3)) for i, v in enumerate(x)], "id long, vector array<double>, label int").repartition(5)
    found = nn.neighbours(df.where("id < 10").select(F.col("id").alias("query_id"), "vector", "id"), df.select(F.col("id").alias("train_id"), "vector", "id"), 4, apart="id")
    for q in range(10):
        d = np.sqrt(((x[q] - x) ** 2).sum(1))
        d[q] = np.inf
        assert [r["train_id"] for r in found.where(f"query_id = {q}").orderBy("rank").collect()] == list(np.argsort(d)[:4])
    labels = df.select(F.col("id").alias("train_id"), "label")
    assert nn.vote(found, labels).count() == 10
    assert nn.probabilities(found, labels).groupBy("query_id").agg(F.sum("p").alias("s")).where("abs(s - 1) > 1e-9").count() == 0
    with pytest.raises(ValidationError):
        nn.neighbours(df, df, 0)


def test_simplex(spark):
    assert en.project_simplex([5]).tolist() == [1]
    assert en.project_simplex([1, 1, 1, 1]).tolist() == [0.25] * 4
    assert en.project_simplex([2, -1, -1]).tolist() == [1, 0, 0]
    assert en.project_simplex([0.5, 0.8]) == pytest.approx([0.35, 0.65])
    frame = spark.createDataFrame([(1, "a", 0.5), (1, "b", 0.8), (2, "a", 2.0), (2, "b", -1.0)], "g int, m string, v double")
    got = {(r["g"], r["m"]): r["weight"] for r in en.project_simplex_frame(frame, "g", "m", "v").collect()}
    assert got == pytest.approx({(1, "a"): 0.35, (1, "b"): 0.65, (2, "a"): 1.0, (2, "b"): 0.0})


def test_greedy_selection_and_weights():
    y = np.array([0, 1, 0, 1])
    good, bad = np.eye(2)[y] * 0.8 + 0.1, np.eye(2)[1 - y] * 0.8 + 0.1
    members, weights, scores = en.greedy_selection([good, bad], y, size=5)  # the first of equal ones wins
    assert members == [0] and weights == [1.0] and scores[-1] == 1.0
    w = en.optimise_weights([good, bad], y, [0.5, 0.5])
    assert w[0] > 0.9 and w.sum() == pytest.approx(1)
    assert en.diversity_filter(["a", "b", "c"], {frozenset("ab"): 0.01, frozenset("ac"): 0.5, frozenset("bc"): 0.5}) == ["a", "c"]


def test_greedy_selection_in_place(spark):
    """The frame form takes the steps of the local one, ties and missing cells included."""
    r = np.random.default_rng(7)
    y, pool = r.integers(0, 3, 60), [np.round(r.dirichlet(np.ones(3), 60), 2) for _ in range(4)]
    for m in pool[:2]:
        m[np.arange(60), y] += 0.2
    pool[3] = pool[0].copy()  # a tie with the first
    long = spark.createDataFrame([(i, int(y[i]), f"m{k}", c, float(p[i, c])) for k, p in enumerate(pool) for i in range(60) for c in range(3) if p[i, c] > 0], "row_id int, y int, model string, label int, p double")
    got = en.greedy_selection_frame(long, [f"m{k}" for k in range(4)], size=6)
    want = en.greedy_selection(pool, y, size=6, score=lambda p: float((np.round(p, 9).argmax(axis=1) == y).mean()))
    assert got[0] == want[0] and got[1] == want[1] and got[2] == pytest.approx(want[2])
    with pytest.raises(ValidationError):
        en.greedy_selection_frame(long.limit(0), ["m0"])
    with pytest.raises(ValidationError):
        en.greedy_selection_frame(long, [])


def test_leaderboard(spark):
    b = lb.ranked(lb.board(spark, [(0, "m", "{}", [0.5, 0.7], 1.0), (1, "n", "{}", [0.6, 0.6], 1.0), (2, "m", "{}", [], 1.0)]))
    got = [(r["id"], r["rank"]) for r in b.orderBy("rank").collect()]
    assert got == [(0, 1), (1, 2), (2, 3)]
    assert lb.from_json(spark, lb.to_json(b)).count() == 3


def test_search_space():
    assert se.sample_param({"type": "int_uniform", "low": 3, "high": 10}, 0.5) == 7
    assert se.sample_param({"type": "log_uniform", "low": 1e-3, "high": 10}, 0.5) == pytest.approx(0.1)
    assert se.sample_param({"type": "categorical", "values": [1, 2]}, 1.0) == 2
    for c in se.random_configs(se.SPACES["svm"], 40):
        assert ("degree" in c) == (c["kernel"] == 1) and ("nu" in c) == (c["svmType"] == 1)
    assert [tuple(r.values()) for r in se.halving_schedule(9, 3, 2, 10)] == [(0, 4, 9, 3), (1, 10, 3, 1), (2, 10, 1, 1)]
    assert len(se.portfolio_of("boosting")) == 10 and se.portfolio_of("unknown") == [{}]


def test_bundle_roundtrip_and_damage(spark):
    raw = bn.encode_bundle({"typeId": "x@1"}, [{"id": "b", "data": b"22"}, {"id": "a", "data": b""}, {"id": "c", "data": b"abc"}])
    manifest, toc, blobs = bn.validate_bundle(raw)
    assert manifest == {"typeId": "x@1", "bundleVersion": 1} and [e["id"] for e in toc] == ["a", "b", "c"] and blobs["c"] == b"abc"
    for bad in (b"", b"XXXX" + raw[4:], raw[:4] + struct.pack("<I", 9) + raw[8:], raw[:30], raw[:-1]):
        with pytest.raises(BundleError):
            bn.decode_bundle(bad)
    with pytest.raises(BundleError):
        bn.validate_bundle(raw[:-1] + b"x")
    overlapping = bn.encode_json([{"id": "a", "offset": 0, "length": 2, "sha256": ""}, {"id": "b", "offset": 1, "length": 2, "sha256": ""}])
    with pytest.raises(BundleError):
        bn.decode_bundle(struct.pack("<4sIII", b"WLRN", 1, 2, len(overlapping)) + b"{}" + overlapping + b"abc")
    rows = bn.catalogue(spark.createDataFrame([(bytearray(raw),)], "content binary")).collect()
    assert len(rows) == 3 and all(r["valid"] for r in rows)


def test_registry():
    with pytest.raises(RegistryError):
        register("nameless", lambda *a: None)
    with pytest.raises(RegistryError):
        load(bn.encode_bundle({"typeId": "never@1"}, []))


@pytest.mark.parametrize("family", sorted(set(FAMILIES) - {"baseline"}))
def test_estimators_learn_and_persist(family):
    r = np.random.default_rng(42)
    x = r.normal(size=(100, 3))
    y = np.where(x[:, 0] + x[:, 1] > 0, 7, 3)
    m = create(family).fit(x, y)
    assert m.score(x, y) > 0.8 and m.classes == [3, 7]
    p = m.predict_proba(x)
    assert p.sum(axis=1) == pytest.approx(np.ones(100))
    assert load(m.save()).predict_proba(x) == pytest.approx(p)
    m.dispose()
    with pytest.raises(DisposedError):
        m.predict(x)
    x2 = r.normal(size=(100, 2))
    y2 = 2 * x2[:, 0] + 3 * x2[:, 1] + 0.5 * r.normal(size=100)
    assert create(family, "regression").fit(x2, y2).score(x2, y2) > 0.5


def test_one_class_and_unfitted():
    m = create("boosting").fit(np.ones((3, 2)), np.array([1, 1, 1]))
    assert m.predict(np.ones((2, 2))).tolist() == [1, 1]
    with pytest.raises(NotFittedError):
        create("knn").predict(np.ones((1, 1)))
    with pytest.raises(ValidationError):
        create("nothing")


@pytest.fixture(scope="module")
def points(spark):
    r = np.random.default_rng(5)
    x = r.normal(size=(120, 3))
    return spark.createDataFrame([(i, *map(float, v), int(v[0] + v[1] > 0)) for i, v in enumerate(x)], "row_id long, a double, b double, c double, y int")


def test_search_survives_failures(spark, points):
    data = am.Matrix.gather(points, "row_id", ["a", "b", "c"], "y", 3)
    rows = am.evaluate(spark, data, [(0, "knn", {"k": 3}, 1.0), (1, "knn", {"metric": "l2", "k": "three"}, 1.0)])
    assert all(r["error"] for r in rows if r["id"] == 1) and all(r["score"] > 0.7 for r in rows if r["id"] == 0)


@pytest.mark.parametrize("strategy", ["random", "halving", "progressive", "portfolio"])
def test_strategies(spark, points, strategy):
    data = am.Matrix.gather(points, "row_id", ["a", "b", "c"], "y", 3)
    found = am.run_search(spark, data, ["knn"], strategy, n_iter=4)
    assert found.best()["mean"] > 0.7


def test_own_strategy(spark, points):
    class Widening:
        """Larger k in batches until one of them is no better than the one before."""

        def __init__(self):
            self.k, self.reported, self.stop = 1, [], False

        def next(self):
            self.k += 2
            return [("knn", {"k": self.k}), ("knn", {"k": "bad"})] if self.k < 8 else ("knn", {"k": self.k})

        def report(self, row):
            self.reported.append((row["params"]["k"], row["mean"]))

        def is_done(self):
            return self.k >= 9

    data, own = am.Matrix.gather(points, "row_id", ["a", "b", "c"], "y", 3), Widening()
    board = am.run_strategy(spark, data, own).board()
    assert [k for k, _ in own.reported] == [3, 5, 7, 9] and all(m > 0.7 for _, m in own.reported)
    assert len(board) == 7 and sum(r["error"] is not None for r in board) == 3 and board[0]["mean"] == max(m for _, m in own.reported)
    assert am.run_strategy(spark, data, Widening(), timeout=-1).rows == []


def test_auto_fit(spark, points):
    out = am.auto_fit(spark, points, "row_id", ["a", "b", "c"], "y", ["knn", "linear"], cv=3, n_iter=2, ensemble_size=4)
    assert sum(out.weights) == pytest.approx(1)
    x = np.array([[2.0, 2.0, 0.0], [-2.0, -2.0, 0.0]])
    assert out.model.predict(x).tolist() == [1, 0]


def test_auto_fit_with_a_preprocessor(spark, points):
    holes = points.withColumn("a", F.when(F.col("row_id") % 7 != 0, F.col("a")))
    out = am.auto_fit(spark, holes, "row_id", ["a", "b", "c"], "y", ["linear", "boosting"], "portfolio", cv=3, ensemble=False, preprocessor=Preprocessor(["a", "b", "c"], scale="standard"))
    got = out.predict(holes, "row_id", ["a", "b", "c"]).join(points.select("row_id", "y"), "row_id")
    assert got.where("prediction = y").count() > 85


def test_ensembles_in_memory():
    r = np.random.default_rng(2)
    x = r.normal(size=(90, 3))
    y = np.digitize(x[:, 0], [-0.4, 0.4])
    for m in (am.Voting([("knn", {}), ("linear", {})]), am.Voting([("knn", {}), ("linear", {})], voting="hard"), am.Bagged(("linear", {}), 3, 2), am.Stacking([("knn", {}), ("linear", {})], passthrough=True)):
        assert m.fit(x, y).score(x, y) > 0.7
    with pytest.raises(ValidationError):
        am.Voting([("knn", {})], voting="hard").fit(x, y).predict_proba(x)


def test_ensembles_persist_and_take_fitted_members():
    r = np.random.default_rng(2)
    x = r.normal(size=(60, 3))
    y = (x[:, 0] > 0).astype(int)
    bag = am.Bagged(("linear", {}), 3).fit(x, y)
    for m in (am.Voting([("knn", {}), ("linear", {})], [0.4, 0.6]), bag, am.Stacking([("knn", {}), ("mine", bag)])):
        m.fit(x, y)
        again = load(m.save())
        assert again.predict_proba(x) == pytest.approx(m.predict_proba(x))
    assert load(bag.save()).oof_predictions == pytest.approx(bag.oof_predictions)
    assert am.with_rounds("boosting", {}, 7) == {"numRound": 7} and am.with_rounds("boosting", {"numRound": 3}, 7) == {"numRound": 3}


def test_cross_val_score(spark, points):
    assert len(am.cross_val_score(spark, points, "row_id", ["a", "b", "c"], "y", "linear", cv=3)) == 3
    own = points.withColumn("f", (F.col("row_id") % 2).cast("int"))
    assert min(am.cross_val_score(spark, own, "row_id", ["a", "b", "c"], "y", "linear", cv="f")) > 0.8


def test_pipeline(spark, points):
    p = Pipeline([("scale", StandardScaler(["a", "b", "c"])), ("model", create("linear"))])
    with pytest.raises(NotFittedError):
        p.predict(points)
    p.fit(points, "y", "row_id")
    got = p.predict(points).select("row_id", "prediction").orderBy("row_id").collect()
    again = load(p.save()).predict(points).select("row_id", "prediction").orderBy("row_id").collect()
    assert got == again and p.predict(points).where("prediction = y").count() > 100
    with pytest.raises(ValidationError):
        Pipeline([])
    with pytest.raises(ValidationError):
        p.fit(points, "y", "row_id", max_cells=10)


def test_distributed(spark, points):
    m = ds.fit(points, ["a", "b", "c"], "y", "linear", "classification", C=10.0)
    assert m.transform(points).where("prediction = y").count() > 110
    with pytest.raises(ValidationError):
        ds.fit(points.limit(0), ["a"], "y", "linear")


def test_importances_count_all_rows(spark, tmp_path):
    """The first 400 ids hold one label; only later rows show that x0 tells the labels apart."""
    rows = [(i, [float(i < 400 or i % 2), *[float(i * k % 7) for k in range(3, 10)]], 9 if i < 400 or i % 2 else 0) for i in range(1000)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r["feature"]: r["importance"] for r in QUERIES["forest_importance"](spark, str(tmp_path)).collect()}
    assert list(got) == [f"x{i}" for i in range(8)] and got["x0"] > 0.2 and max(v for f, v in got.items() if f != "x0") < 0.1


def test_thresholds(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 6)], "x double")
    assert quantile_thresholds(df, "x", 3) == [2, 3, 4]


def test_every_key_of_every_space_is_read():
    for family, space in se.SPACES.items():
        assert set(space) <= set(FAMILIES[family].defaults), family
        create(family, **se.random_configs(space, 1, 3)[0])
    with pytest.raises(ValidationError):
        create("additive", max_bins=3)
    with pytest.raises(ValidationError):
        create("knn").set_params({"neighbours": 3})
    x = np.arange(60.0)[:, None]
    sizes = [len(create("additive", maxBins=n, maxRounds=2).fit(x, x[:, 0]).state["cuts"][0]) for n in (4, 16)]
    assert sizes[0] < sizes[1]


def test_leafwise_trees_and_forest_options():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(int)
    few, many = (create("leafwise", num_leaves=n, numRound=20).fit(x, y) for n in (2, 15))
    leaves = [max(int((t[:, 0] < 0).sum()) for t in m.state["trees"]) for m in (few, many)]
    assert leaves[0] == 2 and 4 < leaves[1] <= 15 and many.score(x, y) > 0.95 > few.score(x, y)
    back = load(many.save())
    assert (back.predict(x) == many.predict(x)).all()
    assert create("leafwise", reg_alpha=1e9, numRound=3).fit(x, x[:, 0]).predict(x).std() < 1e-9
    for options in ({"criterion": "entropy"}, {"extra_trees": 1, "n_estimators": 60}, {"class_weight": "balanced"}, {"histogram_binning": 0}, {"min_samples_split": 8}):
        assert create("forest", **({"n_estimators": 30} | options)).fit(x, y).score(x, y) > 0.85, options
    rare = np.where(np.arange(400) < 20, 1, 0)
    noise = rng.normal(size=(400, 2)) + 0.8 * rare[:, None]
    plain, even = (create("forest", n_estimators=30, max_depth=2, class_weight=w).fit(noise, rare).predict_proba(noise)[:, 1].mean() for w in (None, "balanced"))
    assert even > 2 * plain
    assert create("boosting", numRound=10, num_parallel_tree=3, subsample=0.7, alpha=0.1).fit(x, y).score(x, y) > 0.8


def test_probit_is_close(spark):
    z = [-6.0, -3.0, -1.0, -0.1, 0.0, 0.1, 1.0, 3.0, 6.0]
    got = [r["p"] for r in spark.createDataFrame([(v,) for v in z], "z double").select(expressions.probit(F.col("z")).alias("p")).collect()]
    assert all(abs(p - 0.5 * math.erfc(-v / math.sqrt(2))) < 7.5e-8 for v, p in zip(z, got, strict=True))


def test_scaler_lifecycle(spark):
    s = StandardScaler(["a"]).fit(spark.createDataFrame([(1.0, 2.0), (3.0, 4.0)], "a double, b double"))
    assert s.is_fitted and s.get_params() == {"features": ["a"]}
    assert not s.set_params({"features": ["b"]}).is_fitted and s.features == ["b"]
    with pytest.raises(ValidationError):
        s.set_params({"columns": []})
    s.dispose()
    with pytest.raises(NotFittedError):
        s.transform(spark.range(1))


class Here:
    """Stands for a session; runs a job's tasks in this process, so that their memory can be measured."""

    def __init__(self):
        self.sparkContext = type("Context", (), {"defaultParallelism": 1})

    def createDataFrame(self, rows, _schema):
        self.rows = rows
        return self

    def repartition(self, _n):
        return self

    def mapInPandas(self, run, _schema):
        self.run = run
        return self

    def collect(self):
        frames = list(self.run(iter([pd.DataFrame(self.rows, columns=["id", "model", "params", "fold", "share"])])))
        return [Row(**r) for f in frames for r in f.to_dict("records")]


def peak_mb(work):
    tracemalloc.start()
    try:
        out = work()
        return out, tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_neighbours_of_many_rows_in_bounded_memory():
    """The same rows, distances and order of equal ones as by sorting all distances."""
    r = np.random.default_rng(11)
    for width, n, metric, make in itertools.product((1, 8), (40, 2500), ("l1", "l2"), (lambda v: v, np.round, np.zeros_like, lambda v: 1e9 + v / 1e3)):
        rows, x = make(r.normal(size=(n, width))), make(r.normal(size=(150, width)))
        apart = x[:, None] - rows[None]
        d = np.abs(apart).sum(2) if metric == "l1" else np.sqrt((apart**2).sum(2))
        order = np.argsort(d, axis=1, kind="stable")[:, :9]
        i, near = create("knn", k=9, metric=metric).fit(rows, np.arange(n) % 2).kneighbors(x)
        assert (i == order).all() and (near == np.take_along_axis(d, order, 1)).all()
    rows = r.normal(size=(60_000, 8))
    _, mb = peak_mb(lambda: create("knn", k=9).fit(rows, np.arange(60_000) % 2).kneighbors(rows[:300]))
    assert mb < 80


def test_a_kernel_machine_of_many_rows_in_bounded_memory(monkeypatch):
    """As a factor or by columns it is the machine on the whole matrix."""
    r = np.random.default_rng(13)
    x = r.normal(size=(600, 4))
    y, more = (x[:, 0] * x[:, 1] + r.normal(size=600) / 3 > 0).astype(int), r.normal(size=(500, 4))
    for kernel in range(4):
        whole = create("svm", kernel=kernel).fit(x, y).decision_function(more)
        with monkeypatch.context() as m:
            m.setattr(es, "GRAM_CELLS", 0)
            for cells in (es.FACTOR_CELLS, 0) if kernel < 3 else (0,):
                m.setattr(es, "FACTOR_CELLS", cells)
                assert np.abs(create("svm", kernel=kernel).fit(x, y).decision_function(more) - whole).max() < 2e-2 * max(1, np.abs(whole).std())
    near = r.normal(size=(8000, 8)) / 8
    _, mb = peak_mb(lambda: create("svm").fit(near, (near[:, 0] > 0).astype(int)).predict(near))
    assert mb < 200


@pytest.mark.parametrize("copies", [1, 3])
def test_a_kernel_machine_of_many_rows_reaches_the_optimum_and_predicts_by_pivots(copies, monkeypatch):
    """Primal and dual meet; margins go through the pivots, as the sums over all rows have them."""
    r = np.random.default_rng(23)
    x = np.tile(r.normal(size=(3000 // copies, 8)) / 8, (copies, 1))
    y, more = np.tile((r.random(3000 // copies) < 0.5).astype(int), copies), r.normal(size=(4000, 8)) / 8
    model, cells, kernel = create("svm").fit(x, y), [], es.KernelMachine.kernel
    s = model.state
    fit = ((kernel(model, x, s["x"]) + 1) @ s["a"].T)[:, 0]
    size = float(s["a"][0] @ (kernel(model, s["x"], s["x"]) + 1) @ s["a"][0]) / 2
    dual, primal = np.abs(s["a"]).sum() - size, size + np.maximum(0, 1 - np.where(y == 1, 1, -1) * fit).sum()
    assert s["count"].sum() == 3000 and primal - dual < 1e-5 * dual
    whole = ((kernel(model, more, s["x"]) + 1) @ s["a"].T)[:, 0]
    monkeypatch.setattr(es.KernelMachine, "kernel", lambda m, a, b: cells.append(len(a) * len(b)) or kernel(m, a, b))
    assert np.abs(model.decision_function(more)[:, 0] - whole).max() <= es.MARGIN and (model.predict(more) == (whole > 0)).all()
    assert sum(cells) < len(more) * np.sum(s["count"]) / 2


@pytest.mark.parametrize("strategy", ["random", "halving", "progressive"])
def test_searches_over_many_rows_in_bounded_memory(strategy):
    """A search's tasks hold blocks of distances, not one of 256 rows against all."""
    r = np.random.default_rng(17)
    n = 30_000
    x = r.normal(size=(n, 8))
    data = am.Matrix(np.arange(n), x, (x[:, 0] > 0).astype(int), np.arange(n) % 3, "classification")
    spaces = {"knn": {"k": {"type": "int_uniform", "low": 1, "high": 15}}}
    found, mb = peak_mb(lambda: am.run_search(Here(), data, spaces, strategy, n_iter=1))
    assert found.best()["mean"] > 0.9 and mb < 150


@pytest.mark.parametrize("strategy", ["random", "halving", "progressive"])
def test_searches_over_many_copies_in_bounded_memory(strategy):
    """Rows that are copies of a few: scores as by sorting all distances, equal ones by place, in bounded memory."""
    r = np.random.default_rng(19)
    n, kinds = 15_000, r.normal(size=(40, 8))
    own = r.integers(0, 40, n)
    y, fold = ((kinds[own, 0] > 0) ^ (r.random(n) < 0.3)).astype(int), np.arange(n) % 3
    data = am.Matrix(np.arange(n), kinds[own], y, fold, "classification")
    spaces = {"knn": {"k": {"type": "int_uniform", "low": 1, "high": 15}}}
    found, mb = peak_mb(lambda: am.run_search(Here(), data, spaces, strategy, n_iter=2))
    assert found.best()["fraction"] == 1.0 and mb < 100
    for row in (w for w in found.board() if w["fraction"] == 1.0):
        for f, score in enumerate(row["scores"]):
            train = np.flatnonzero(fold != f)
            apart = np.sqrt(((kinds[:, None] - kinds[own[train]][None]) ** 2).sum(axis=2))
            near = np.argsort(apart, axis=1, kind="stable")[:, : row["params"]["k"]]
            votes = (y[train][near].mean(axis=1) > 0.5).astype(int)
            assert score == (votes[own] == y)[fold == f].mean()
