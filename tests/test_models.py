import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from shoal.functions.features import FeatureSpec
from shoal.operators import cluster, som
from shoal.plans import session
from shoal.plans.lineage import lineage


def blobs(spark, centres, n, seed=42):
    rng = np.random.default_rng(seed)
    rows = [(int(i % len(centres)), (np.array(centres[i % len(centres)]) + rng.normal(0, 0.2, len(centres[0]))).tolist()) for i in range(n)]
    return spark.createDataFrame(rows, "truth int, features array<double>")


def test_nearest_ties(spark):
    df = spark.createDataFrame([([0.0, 0.0],), ([1.0, 1.0],), ([0.5, 0.5],), ([0.9, 0.9],)], "features array<double>")
    got = cluster.nearest(df, "features", [[0, 0], [1, 1]], "manhattan").collect()
    assert [r.cluster for r in got] == [0, 1, 0, 1] and got[3].distance == pytest.approx(0.2)


@pytest.mark.parametrize("k", [0, 3])
def test_kmedoids_finds_centres(spark, k):
    centres = [[0.0, 0.0], [5.0, 5.0], [0.0, 8.0]]
    df = blobs(spark, centres, 300)
    model = cluster.KMedoids(k=k, seed=7, max_iterations=10).fit(df)
    assert model.k == 3
    assert all(min(np.abs(np.array(m) - c).max() for m in model.medoids) < 0.4 for c in centres)
    pairs = model.transform(df).select("truth", "cluster").distinct()
    assert pairs.count() == 3


def test_kmedoids_checks():
    with pytest.raises(ValueError):
        cluster.KMedoids(k=-1)
    with pytest.raises(ValueError):
        cluster.KMedoids(k=3).fit_rows(np.zeros((5, 2)))


def test_forest(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(float(a), float(a if rng.random() < 0.95 else 1 - a), float(rng.random())) for a in rng.integers(0, 2, 400)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    spec = FeatureSpec.of(F.col("a"), F.col("b"), F.col("c")).with_names("a", "b", "c")
    model = cluster.RandomForestCluster(spec, trees=5, depth=3, clusters=cluster.KMedoids(metric="hamming", k=2, seed=1), seed=1).fit(df)
    assert {r.cluster for r in model.transform(df).select("cluster").distinct().collect()} <= {0, 1}
    nodes = cluster.node_table(model.forest, str(tmp_path / "forest"), spark)
    rules = cluster.rules(nodes, spec.names.values)
    assert {t for t, *_ in rules} == set(range(5)) and any("(a <= " in c for *_, path in rules for c in path)
    features = np.array([[r.a, r.b, r.c] for r in df.limit(20).collect()])
    assert {tuple(model.predict(x)) for x in features} == {(r.cluster, r.distance) for r in model.transform(df.limit(20), F.array("a", "b", "c")).collect()}
    by_name = {r.value: r.freq for r in cluster.feature_hist(nodes, spec.names.values).collect()}
    assert by_name == {spec.names(r.feature): r.n for r in cluster.feature_counts(nodes).collect()}
    walk = cluster.breadth_first(nodes)
    assert len(walk) == nodes.count() and all(1 << depth <= i < 2 << depth for _, i, depth, _ in walk)
    both = model.leaves(df).select("leaf_ids", cluster.heap_leaves(nodes, spec.array()).alias("heap")).collect()
    for tree in range(5):
        pairs = {(r.leaf_ids[tree], r.heap[tree]) for r in both}
        assert len(pairs) == len({o for o, _ in pairs}) == len({h for _, h in pairs})
    assert cluster.feature_counts(nodes).agg(F.sum("n")).first()[0] == nodes.where("left >= 0").count()


def test_forest_by_cells(spark, tmp_path, monkeypatch):
    df = spark.range(3000).select((F.col("id") % 50).cast("double").alias("a"), (F.col("id") % 50 * 7 % 11).cast("double").alias("b"))
    spec = FeatureSpec.of(F.col("a"), F.col("b")).with_names("a", "b")
    one = cluster.RandomForestCluster(spec, trees=3, depth=4, clusters=cluster.KMedoids(metric="hamming", k=2, seed=1), seed=1)
    both = df.select(spec.array().alias("features"), F.lit(1.0).alias("label"))
    cells, thresholds = one._cells(both, 3000)
    assert sum(r.n for r in cells) == 3000 and len(cells) <= 25 and [len(t) for t in thresholds] == [4, 4]
    model = one.fit(df)
    nodes = cluster.node_table(model.forest, str(tmp_path / "cells"), spark)
    trees = {r.tree for r in nodes.select("tree").collect()}
    assert trees == {0, 1, 2} and {v for r in nodes.where("left >= 0").collect() for v in r["values"]} <= {v for t in thresholds for v in t} | {x + 0.5 for x in range(50)}
    assert type(model.forest).load(str(tmp_path / "cells")).getNumTrees == 3
    both = model.leaves(df).select("leaf_ids", cluster.heap_leaves(nodes, spec.array()).alias("heap")).distinct().collect()
    assert all(len({(r.leaf_ids[t], r.heap[t]) for r in both}) == len({r.heap[t] for r in both}) > 1 for t in trees)
    monkeypatch.setattr(cluster, "CELLS", 3)  # the rows themselves
    assert one.fit(df).forest.getNumTrees == 3


def test_split_points():
    assert cluster.split_points(np.array([3.0, 1.0, 1.0, 2.0]), 5) == [1.5, 2.5] and cluster.split_points(np.ones(4), 5) == []
    assert cluster.split_points(np.arange(100.0), 5) == [19.5, 39.5, 59.5, 79.5]


def test_medoid_step(spark):
    data = [(i, i % 2, [float(i % 7), float(i * i % 5)]) for i in range(60)]
    df = spark.createDataFrame(data, "vec_id long, cluster int, f array<double>")
    for metric, of in (("manhattan", lambda a, b: sum(abs(x - y) for x, y in zip(a, b))), ("hamming", lambda a, b: sum(x != y for x, y in zip(a, b))), ("euclidean", lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b)) ** 0.5)):
        totals = {(c, i): round(sum(of(f, g) for _, o, g in data if o == c), 6) for i, c, f in data}
        best = {c: min((v, i) for (o, i), v in totals.items() if o == c) for c in (0, 1)}
        step = cluster.medoid_step(df, "vec_id", "f", metric)
        assert {r.cluster: (round(r.total, 6), r.vec_id) for r in step.collect()} == best
        if metric != "euclidean":
            assert "Join" not in step._jdf.queryExecution().optimizedPlan().toString()  # no pairs


def test_categorical_rules_and_leaves(spark):
    nodes = spark.createDataFrame(
        [(0, 0, 0.0, 1, 4, 1, [0.0, 2.0], 4), (0, 1, 0.0, 2, 3, 0, [1.5], -1), (0, 2, 1.0, -1, -1, -1, [], -1), (0, 3, 0.0, -1, -1, -1, [], -1), (0, 4, 1.0, -1, -1, -1, [], -1)],
        "tree int, id int, prediction double, left int, right int, feature int, values array<double>, categories int",
    )
    assert [r[4] for r in cluster.rules(nodes, {1: "kind"})] == [["(kind in [1.0,3.0])"], ["(kind in [0.0,2.0])", "(f_0 <= 1.5)"], ["(kind in [0.0,2.0])", "(f_0 > 1.5)"]]
    assert cluster.rules(nodes, {1: "kind"}, all_known=False)[0][4] == ["(kind not-in [0.0,2.0])"]
    rows = spark.createDataFrame([([1.5, 2.0],), ([1.6, 0.0],), ([0.0, 3.0],)], "f array<double>")
    assert [r.h for r in rows.select(cluster.heap_leaves(nodes, F.col("f")).alias("h")).collect()] == [[4], [5], [3]]
    assert [(i, depth) for _, i, depth, _ in cluster.breadth_first(nodes)] == [(1, 0), (2, 1), (3, 1), (4, 2), (5, 2)]


def test_som(spark, tmp_path):
    rng = np.random.default_rng(0)
    df = spark.createDataFrame([(rng.random(3).tolist(),) for _ in range(400)], "f array<double>")
    seen = []
    trained = som.train(df, "f", 4, 3, 3, seed=1, hook=lambda t, m: seen.append(t))
    assert seen == [0, 1, 2, 3] and trained.quality["n"] == 400 and trained.quality["mean"] > 0.9
    trained.save(spark, str(tmp_path / "som"))
    assert np.allclose(som.SOM.load(spark, str(tmp_path / "som")).codebook, trained.codebook)
    assert trained.pixels(spark).count() == 12
    vectors = df.select(array_to_vector("f").alias("features"))
    model = som.SOMEstimator(x=3, y=3, epochs=1, seed=2).fit(vectors)
    out = model.transform(vectors)
    assert out.columns == ["features", "prediction", "similarity"] and out.count() == 400
    assert model.copy().som is not None
    with pytest.raises(ValueError, match="already"):
        model.transform(out)


def test_som_with_empty_partitions(spark):
    df = spark.range(40, numPartitions=8).select(F.array((F.col("id") + 1).cast("double"), F.lit(1.0)).alias("f"))
    assert som.train(df.where("f[0] < 3"), "f", 2, 2, 2, seed=1).quality["n"] == 2


def test_session_and_lineage(spark):
    app = session.App("x").add_config({"a": "1"}).add_config(lambda c: c | {"b": c["a"] + "2"})
    assert app.settings()["b"] == "12"
    assert session.register_function(spark, "plus_one", lambda x: x + 1, "int") and not session.register_function(spark, "plus_one", lambda x: x + 9, "int")
    assert session.is_registered(spark, "plus_one") and spark.sql("select plus_one(1) as x").first().x == 2
    depths = [d for d, _, _ in lineage(spark.range(3).union(spark.range(4)))]
    assert depths[0] == 0 and depths == sorted(depths)
