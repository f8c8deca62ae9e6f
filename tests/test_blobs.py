"""Blobs, clustering and what streams give."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lathe.errors import BundleError
from lathe.functions import expressions as X
from lathe.operators import clustering as cl
from lathe.sources import blobs as B
from lathe.streaming.scoring import read_stream, score_available


def test_neighbours_blob(spark):
    x = np.array([[1.0, 2.0], [3.0, 4.0]])
    for y, regression in ((np.array([3, 7], np.int32), False), (np.array([0.5, 1.5]), True)):
        got = B.NeighboursBlob.decode(B.NeighboursBlob(x, y, regression).encode())
        assert (got.x == x).all() and (got.y == y).all() and got.regression == regression
    assert got.frame(spark).count() == 2
    with pytest.raises(BundleError):
        B.NeighboursBlob.decode(b"NF02" + bytes(12))
    with pytest.raises(BundleError):
        B.NeighboursBlob.decode(B.NeighboursBlob(x, y, True).encode()[:-1])


def test_clauses_blob():
    cuts = [np.array([0.5, 1.5]), np.array([2.0])]
    state = np.zeros((2, 4, 1, 3), np.uint32)
    state[0, 0, 0, 2] = 0b000001  # x0 > 0.5 votes for class 0
    state[1, 0, 0, 2] = 0b001000  # x0 <= 0.5 votes for class 1
    blob = B.ClausesBlob(4, 3, 10, 3.9, False, True, 2, (0.0, 1.0), cuts, state, np.array([5, 9], np.int32))
    got = B.ClausesBlob.decode(blob.encode())
    assert got.predict(np.array([[1.0, 0.0], [0.0, 3.0]])).tolist() == [5, 9]
    assert (got.state == state).all() and got.words == 1
    with pytest.raises(BundleError):
        B.ClausesBlob.decode(blob.encode()[:-1])


def test_factorisation_blob(spark):
    row = spark.createDataFrame([(1.0, 2.0, 3.0)], "a double, b double, c double")
    xs = [F.col(c) for c in "abc"]
    blob = B.FactorisationBlob("fm", "cross-entropy", np.array([0.1, -2, 3]), 0.5, np.array([[0.2], [1.0], [-1.0]]))
    got = B.FactorisationBlob.decode(blob.encode())
    assert row.select(got.margin(xs)).first()[0] == pytest.approx(1.8313996806921398, abs=1e-6)
    assert B.FactorisationBlob.decode(B.FactorisationBlob("linear", "squared", np.array([1.0, 2.0, 0.5]), 0.25).encode()).w.tolist() == [1.0, 2.0, 0.5]
    ffm = B.FactorisationBlob.decode(B.FactorisationBlob("ffm", "squared", np.ones(2), 0.0, np.arange(12.0).reshape(2, 2, 3)).encode())
    assert ffm.v.tolist() == np.arange(12.0).reshape(2, 2, 3).tolist()


def test_additive_blob(spark):
    blob = B.AdditiveBlob("classification", [0.5], [[1.0, 2.0, 3.0], [10.0]], [{"features": [0], "binCounts": [4], "scores": [1.0, 2.0, 3.0, 4.0]}, {"features": [0, 1], "binCounts": [4, 2], "scores": [float(i) for i in range(8)]}])
    got = B.AdditiveBlob.decode(blob.encode())
    df = spark.createDataFrame([(0.0, 5.0), (1.0, 10.0), (None, 99.0)], "a double, b double")
    assert [r[0] for r in df.select(got.margins([F.col("a"), F.col("b")])[0]).collect()] == [0.5 + 1 + 0, 0.5 + 2 + 3, 0.5 + 4 + 7]
    with pytest.raises(BundleError):
        B.AdditiveBlob.decode(b'{"format": "other"}')


def test_forest_blob(spark):
    tree = {"node_type": [1, 0, 0], "split_index": [0, -1, -1], "threshold": [0.5, 0, 0], "left": [1, -1, -1], "right": [2, -1, -1], "leaf_value": [0, 1.0, 3.0]}
    blob = B.ForestBlob({"y_bar": 10.0, "y_std": 2.0, "forest_container": {"num_samples": 2, "forest_0": {"num_trees": 1, "tree_0": tree}, "forest_1": {"num_trees": 1, "tree_0": tree}}})
    got = B.ForestBlob.decode(blob.encode())
    assert got.margin(np.array([[0.5], [0.6]])).tolist() == [12.0, 16.0]
    assert got.frame(spark).count() == 6


@pytest.fixture(scope="module")
def three(spark):
    r = np.random.default_rng(0)
    x = np.concatenate([r.normal(c, 0.1, (30, 2)) for c in ((0, 0), (5, 5), (0, 5))])
    return x, spark.createDataFrame([(i, *map(float, p), i // 30) for i, p in enumerate(x)], "id int, a double, b double, truth int")


def test_clusters(three):
    x, df = three
    found = cl.k_means(df, ["a", "b"], 3).cache()
    assert cl.adjusted_rand(found, "truth", "cluster") == 1.0
    assert cl.silhouette(found, ["a", "b"]) > 0.9
    assert cl.davies_bouldin(found, ["a", "b"]) < 0.2 and cl.calinski_harabasz(found, ["a", "b"]) > 1000
    for got in (cl.dbscan(x, 0.6, 4), *(cl.agglomerate(x, 3, k) for k in ("single", "complete", "average"))):
        assert [len(set(got[i : i + 30].tolist())) for i in (0, 30, 60)] == [1, 1, 1] and len(set(got.tolist())) == 3
    assert cl.dbscan(np.array([[0.0], [100.0]]), 1, 2).tolist() == [-1, -1]


def test_scoring_a_stream(spark):
    stream = read_stream(spark, "/root/testdata/sf0.001", "events")
    got = score_available(stream, lambda s: s.select("event_id", X.sigmoid(F.col("value")).alias("p")))
    assert got.count() == spark.read.parquet("/root/testdata/sf0.001/events.parquet").count()


def test_a_scored_stream_goes_on_where_it_stopped(spark, tmp_path):
    schema, score = "id long", lambda s: s.select((F.col("id") * 2).alias("twice"))
    (tmp_path / "in").mkdir()
    stream = lambda: spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    assert score_available(stream(), score, str(tmp_path / "none")).count() == 0
    for upto in (3, 5):
        spark.range(upto - 2, upto).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        got = score_available(stream(), score, str(tmp_path / "out"))
        assert sorted(r["twice"] for r in got.collect()) == [2 * i for i in range(1, upto)]
