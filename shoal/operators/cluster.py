"""k-medoids, and clustering by the leaves of a random forest."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from ..functions.arrays import hamming, manhattan
from ..functions.features import FeatureSpec
from ..functions.stats import fit_pdf
from .histogram import hist_by
from .sampling import iid_features, sample_by_size, sample_fraction

#: A metric over columns and the same over rows of a matrix: distances of all rows to one.
METRICS: dict[str, tuple[Callable[[Column, Column], Column], Callable]] = {
    "manhattan": (manhattan, lambda rows, x: np.abs(rows - x).sum(1)),
    "euclidean": (lambda a, b: F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y).cast("double") * (x - y)), F.lit(0.0), lambda s, x: s + x)), lambda rows, x: np.sqrt(((rows - x) ** 2).sum(1))),
    "hamming": (hamming, lambda rows, x: (rows != x).sum(1).astype(float)),
}


def nearest(df: DataFrame, features: str, medoids: list, metric: str = "euclidean") -> DataFrame:
    """df with (cluster, distance): the medoid of least distance, ties to the lowest; medoids are few and literal."""
    of = METRICS[metric][0]
    each = F.array(*[F.struct(of(F.col(features), F.array(*[F.lit(float(x)) for x in m])).alias("distance"), F.lit(j).alias("cluster")) for j, m in enumerate(medoids)])
    return df.withColumn("_near", F.array_min(each)).withColumn("cluster", F.col("_near.cluster")).withColumn("distance", F.col("_near.distance")).drop("_near")


def cost(df: DataFrame, features: str, medoids: list, metric: str = "euclidean") -> DataFrame:
    """One row: total and mean (0 if empty) distance to the nearest medoid."""
    near = nearest(df, features, medoids, metric)
    return near.agg(F.coalesce(F.sum("distance"), F.lit(0.0)).alias("total"), F.coalesce(F.avg("distance"), F.lit(0.0)).alias("mean"))


def medoid_step(assigned: DataFrame, key: str, features: str, metric: str = "euclidean") -> DataFrame:
    """(cluster, key, total): the member of least total distance to its cluster, ties (to six places) to the least key.

    Manhattan and Hamming distances are sums over places, so the totals come from the values of each place in order,
    without pairs. Euclidean members meet all members of their cluster: for that, assigned must be of bounded size.
    """
    a = assigned.select("cluster", F.col(key).alias("k"), F.col(features).alias("f"))
    if metric in ("manhattan", "hamming"):
        totals = _totals_by_place(a, metric)
    else:
        b = assigned.select("cluster", F.col(features).alias("g"))
        totals = a.join(b, "cluster").groupBy("cluster", "k").agg(F.sum(METRICS[metric][0](F.col("f"), F.col("g"))).alias("total"))
    best = totals.groupBy("cluster").agg(F.min(F.struct(F.round("total", 6), "k")).alias("m"), F.min("total").alias("total"))
    return best.select("cluster", F.col("m.k").alias(key), "total")


def _totals_by_place(members: DataFrame, metric: str) -> DataFrame:
    """(cluster, k, total) of (cluster, k, f): what a value adds to a total depends on the values of its cluster and place alone."""
    each = members.select("cluster", "k", F.posexplode("f").alias("place", "x"))
    own = Window.partitionBy("cluster", "place")
    if metric == "hamming":
        part = (F.count(F.lit(1)).over(own) - F.count(F.lit(1)).over(Window.partitionBy("cluster", "place", "x"))).cast("double")
    else:
        x = F.col("x").cast("double")
        upto = own.orderBy("x").rangeBetween(Window.unboundedPreceding, Window.currentRow)
        n, s = F.count(F.lit(1)), F.sum(x)
        part = x * (2 * n.over(upto) - n.over(own)) + s.over(own) - 2 * s.over(upto)
    return each.withColumn("part", part).groupBy("cluster", "k").agg(F.sum("part").alias("total"))


@dataclass(frozen=True)
class KMedoidsModel:
    medoids: list
    metric: str
    features: str = "features"

    @property
    def k(self) -> int:
        return len(self.medoids)

    def transform(self, df: DataFrame) -> DataFrame:
        return nearest(df, self.features, self.medoids, self.metric)

    def cost(self, df: DataFrame, normalized: bool = False) -> float:
        row = cost(df, self.features, self.medoids, self.metric).first()
        return row["mean"] if normalized else row["total"]

    def predict(self, point) -> tuple[int, float]:
        d = METRICS[self.metric][1](np.asarray(self.medoids, dtype=float), np.asarray(point, dtype=float))
        return int(np.argmin(d)), float(d.min())


@dataclass(frozen=True)
class KMedoids:
    """k = 0 chooses the number of clusters, at most max_iterations, by description length.

    Fitted on a sample of about sample_size rows, which the driver holds.
    """

    metric: str = "euclidean"
    k: int = 2
    max_iterations: int = 25
    epsilon: float = 0.0
    fraction_epsilon: float = 1e-4
    sample_size: int = 1000
    seed: int = 0
    features: str = "features"

    def __post_init__(self):
        if self.k < 0 or self.max_iterations <= 0 or self.epsilon < 0 or self.fraction_epsilon < 0 or self.sample_size <= 0:
            raise ValueError("a parameter is out of range")

    def set(self, **changes) -> KMedoids:
        return replace(self, **changes)

    def fit(self, df: DataFrame) -> KMedoidsModel:
        return self.fit_all(sample_by_size(df.select(self.features), self.sample_size, self.seed))

    def fit_all(self, sample: DataFrame) -> KMedoidsModel:
        """fit to all rows of a sample that was drawn already."""
        return self.fit_rows(np.array(sorted(tuple(map(float, r[0])) for r in sample.select(self.features).collect())))

    def fit_rows(self, rows: np.ndarray) -> KMedoidsModel:
        if not len(rows):
            raise ValueError("no rows to cluster")
        medoids = self._fixed(rows) if self.k else self._described(rows)
        return KMedoidsModel([m.tolist() for m in medoids], self.metric, self.features)

    def _distances(self, rows: np.ndarray, medoids: np.ndarray) -> np.ndarray:
        return np.stack([METRICS[self.metric][1](rows, m) for m in medoids], axis=1)

    def _medoid(self, rows: np.ndarray) -> np.ndarray:
        return rows[int(np.argmin([METRICS[self.metric][1](rows, x).sum() for x in rows]))]

    def _fixed(self, rows: np.ndarray) -> np.ndarray:
        different = np.unique(rows, axis=0)
        if len(different) < self.k:
            raise ValueError(f"fewer than {self.k} distinct rows")
        start = different[np.random.default_rng(self.seed).choice(len(different), self.k, replace=False)]
        return self._refine(rows, start)[0]

    def _refine(self, rows: np.ndarray, medoids: np.ndarray) -> tuple[np.ndarray, float]:
        """Assign, take medoids, until the cost falls no more; clusters without members vanish."""
        now = self._distances(rows, medoids).min(1).mean()
        for _ in range(self.max_iterations):
            own = self._distances(rows, medoids).argmin(1)
            after = np.stack([self._medoid(rows[own == j]) for j in np.unique(own)])
            then = self._distances(rows, after).min(1).mean()
            if then >= now:
                break
            gain, medoids, now = now - then, after, then
            if gain <= self.epsilon or now > 0 and gain / now <= self.fraction_epsilon:
                break
        return medoids, float(now)

    def _length(self, rows: np.ndarray, medoids: np.ndarray) -> float:
        near = self._distances(rows, medoids).min(1)
        density, parameters = fit_pdf(near)
        values = [density(x) for x in near]
        return sum(-math.log(p) if p > 0 else 100.0 for p in values) + (len(medoids) + len(medoids) * parameters / 2) * math.log(len(rows))

    def _described(self, rows: np.ndarray) -> np.ndarray:
        """Split the cluster whose split costs least, again and again; keep the number of least description length."""
        medoids = self._medoid(rows)[None]
        best = (self._length(rows, medoids), medoids)
        far = METRICS[self.metric][1]
        while len(medoids) < self.max_iterations:
            own, tried = self._distances(rows, medoids).argmin(1), []
            for j in range(len(medoids)):
                part = rows[own == j]
                if len(part) < 2:
                    continue
                a = part[int(far(part, medoids[j]).argmax())]
                b = part[int(far(part, a).argmax())]
                if not (a != b).any():
                    continue
                halves = self._refine(part, np.stack([a, b]))[0]
                tried.append(self._refine(rows, np.concatenate([np.delete(medoids, j, axis=0), halves])))
            tried = [t for t in tried if len(t[0]) == len(medoids) + 1]  # those that lost a cluster are no candidates
            if not tried:
                break
            medoids = min(tried, key=lambda t: t[1])[0]
            best = min(best, (self._length(rows, medoids), medoids), key=lambda t: t[0])
        return best[1]


#: Cells of binned rows that the driver holds at most, and bins that rows are told apart by at most.
CELLS, BINS = 100_000, 64


def split_points(values: np.ndarray, bins: int) -> list[float]:
    """Thresholds of one feature of a sample, as Spark's forests choose them: all midpoints if they are few, else by even strides."""
    different, counts = np.unique(values, return_counts=True)
    middle = ((different[:-1] + different[1:]) / 2).tolist()
    if len(middle) < bins:
        return middle
    out, stride, seen = [], len(values) / bins, np.cumsum(counts)
    target = stride
    for i, m in enumerate(middle):
        if abs(seen[i] - target) < abs(seen[i + 1] - target):
            out.append(m)
            target += stride
    return out


def _by_value(jvm, node, thresholds: list):
    """A Java node that splits by number of bin, and those below, as nodes that split by value."""
    if node.subtreeDepth() == 0:
        return node
    split, tree = node.split(), jvm.org.apache.spark.ml.tree
    if thresholds[split.featureIndex()] is not None:
        split = tree.ContinuousSplit(split.featureIndex(), thresholds[split.featureIndex()][math.floor(split.threshold())])
    left, right = (_by_value(jvm, x, thresholds) for x in (node.leftChild(), node.rightChild()))
    return tree.InternalNode(node.prediction(), node.impurity(), node.gain(), left, right, split, node.impurityStats())


@dataclass(frozen=True)
class RandomForestCluster:
    """Real rows against rows with independent columns, a forest that tells them apart, and its leaves clustered.

    A forest sees of a row no more than its bins. So rows are counted by label and bins; each tree's bootstrap gives
    every row a Poisson weight of mean 1, and thus a cell of n rows one of mean n. Where there are too many cells, the
    forest is trained on the rows themselves.
    """

    extractor: FeatureSpec
    synthetic: int = 0
    trees: int = 10
    depth: int = 5
    bins: int = 5
    clusters: KMedoids = KMedoids(metric="hamming", k=0)
    seed: int = 0

    def fit(self, df: DataFrame) -> RandomForestClusterModel:
        rows = df.select(self.extractor.array().cast("array<double>").alias("features"))
        real = rows.count()
        n = self.synthetic or real
        other = iid_features(rows, n, seed=self.seed).select("features", F.lit(0.0).alias("label"))
        both = rows.withColumn("label", F.lit(1.0)).unionByName(other)
        model = RandomForestClusterModel(self.extractor, self._forest(both, real + n), None)
        few = sample_by_size(df, self.clusters.sample_size, self.clusters.seed)
        return replace(model, medoids=self.clusters.set(features="leaf_ids").fit_all(model.leaves(few)))

    def _classifier(self, **more) -> RandomForestClassifier:
        return RandomForestClassifier(featuresCol="vector", labelCol="label", maxDepth=self.depth, maxBins=self.bins, impurity="gini", leafCol="leaf", **more)

    def _vector(self) -> Column:
        return array_to_vector(F.col("features")).alias("vector", metadata=self.extractor.metadata())

    def _forest(self, both: DataFrame, n: int) -> RandomForestClassificationModel:
        cells, thresholds = self._cells(both, n) if 1 < self.bins <= BINS else (None, None)
        if cells is None:
            return self._classifier(numTrees=self.trees, featureSubsetStrategy="auto", seed=self.seed).fit(both.select(self._vector(), "label"))
        counts = np.array([r["n"] for r in cells])
        drawn = np.random.default_rng(self.seed).poisson(counts, (self.trees, len(counts)))
        drawn[drawn.sum(1) == 0] = counts  # of very few rows a bootstrap may take none
        table = [([float(x) for x in r["cell"]], r["label"], w) for r, w in zip(cells, drawn.T.astype(float).tolist(), strict=True)]
        spark = both.sparkSession
        held = spark.createDataFrame(table, "features array<double>, label double, weights array<double>").coalesce(1)
        label = F.col("label").alias("label", metadata={"ml_attr": {"type": "nominal", "vals": ["0", "1"]}})
        jvm, width = spark._jvm, self.extractor.width
        classification = jvm.org.apache.spark.ml.classification
        java = spark.sparkContext._gateway.new_array(classification.DecisionTreeClassificationModel, self.trees)
        for i in range(self.trees):
            own = held.select(self._vector(), label, F.col("weights")[i].alias("weight")).where("weight > 0")
            fitted = self._classifier(numTrees=1, weightCol="weight", bootstrap=False, featureSubsetStrategy="sqrt" if self.trees > 1 else "all", seed=self.seed + i).fit(own)  # its Java object lasts as long as it
            tree = fitted._java_obj.trees()[0]
            java[i] = classification.DecisionTreeClassificationModel(tree.uid(), _by_value(jvm, tree.rootNode(), thresholds), width, 2)
        one = fitted._java_obj
        made = classification.RandomForestClassificationModel(one.uid(), java, width, 2)
        for name in ("impurity", "featuresCol", "labelCol", "leafCol", "maxDepth", "maxBins"):
            made.set(made.getParam(name), one.getOrDefault(one.getParam(name)))
        made.set(made.getParam("numTrees"), self.trees)
        return RandomForestClassificationModel(made)

    def _cells(self, both: DataFrame, n: int) -> tuple[list[Row] | None, list]:
        """Rows (cell, label, n), none if they are too many, and the thresholds of each feature, None for categories."""
        fraction = sample_fraction(n, max(self.bins**2, 10_000))
        sample = both.select("features")
        sample = np.array([r[0] for r in (sample if fraction >= 1 else sample.sample(False, fraction, self.seed)).collect()], dtype=float)
        if not len(sample):
            raise ValueError("no rows to tell apart")
        thresholds = [None if j in self.extractor.categories else split_points(sample[:, j], self.bins) for j in range(self.extractor.width)]
        columns = []
        for j, points in enumerate(thresholds):
            x, bin_of = F.col("features")[j], F.lit(0)
            for p in points or ():
                bin_of = bin_of + (x > F.lit(p)).cast("int")
            columns.append((x if points is None else bin_of.cast("double")).alias(f"c{j}"))
        names = [f"c{j}" for j in range(len(columns))]
        cells = both.select("label", *columns).groupBy("label", *names).agg(F.count(F.lit(1)).alias("n")).select("label", "n", F.array(*names).alias("cell")).limit(CELLS + 1).collect()
        return (sorted(cells, key=lambda r: (r["label"], r["cell"])) if len(cells) <= CELLS else None), thresholds


@dataclass(frozen=True)
class RandomForestClusterModel:
    extractor: FeatureSpec
    forest: object
    medoids: KMedoidsModel | None

    def leaves(self, df: DataFrame, features: Column | None = None) -> DataFrame:
        """df with leaf_ids, one for each tree, by the extractor or by an array of features that there is already."""
        scored = self.forest.transform(df.withColumn("vector", array_to_vector(self.extractor.array() if features is None else features)))
        return scored.withColumn("leaf_ids", vector_to_array("leaf")).select(*df.columns, "leaf_ids")

    def transform(self, df: DataFrame, features: Column | None = None) -> DataFrame:
        return self.medoids.transform(self.leaves(df, features)).drop("leaf_ids")

    def predict(self, features) -> tuple[int, float]:
        """(cluster, distance) of one vector of features."""
        return self.medoids.predict([self.forest.trees[i].predictLeaf(Vectors.dense(features)) for i in range(self.forest.getNumTrees)])


def node_table(model, path: str, spark) -> DataFrame:
    """(tree, id, prediction, left, right, feature, values, categories) of a fitted forest, by way of its saved form."""
    model.write().overwrite().save(path)
    n = F.col("nodeData")
    data = spark.read.parquet(path + "/data")
    return data.select(F.col("treeID").alias("tree"), n["id"].alias("id"), n["prediction"].alias("prediction"), n["leftChild"].alias("left"), n["rightChild"].alias("right"), n["split"]["featureIndex"].alias("feature"), n["split"]["leftCategoriesOrThreshold"].alias("values"), n["split"]["numCategories"].alias("categories"))


def feature_counts(nodes: DataFrame) -> DataFrame:
    """(feature, n): inner nodes that split on each feature, most first."""
    return nodes.where("left >= 0").groupBy("feature").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "feature")


def feature_hist(nodes: DataFrame, names: dict[int, str] | None = None, normalized: bool = False, cumulative: bool = False) -> DataFrame:
    """(value, freq, place): how often inner nodes split on each feature, by index or, where names are given, by name."""
    by = F.col("feature")
    if names:
        of = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
        by = F.coalesce(F.try_element_at(of, by), F.concat(F.lit("f_"), by.cast("string")))
    return hist_by(nodes.where("left >= 0"), by, normalized, cumulative)


def breadth_first(nodes: DataFrame) -> list[tuple[int, int, int, Row]]:
    """(tree, heap id, depth, node) of a forest of bounded depth, tree by tree from the root; the root is 1, the children of i are 2i and 2i + 1."""
    trees: dict[int, dict[int, Row]] = {}
    for r in nodes.collect():
        trees.setdefault(r["tree"], {})[r["id"]] = r
    out = []
    for tree, table in sorted(trees.items()):
        level = [(1, 0, table[0])]
        while level:
            out += [(tree, *node) for node in level]
            level = [(2 * i + side, depth + 1, table[r[way]]) for i, depth, r in level if r["left"] >= 0 for side, way in enumerate(("left", "right"))]
    return out


def heap_leaves(nodes: DataFrame, features: Column) -> Column:
    """Heap ids of the leaves where an array of features ends, one for each tree: at most the threshold, or among the categories, goes left."""
    below: dict[tuple[int, int], Column] = {}
    walk = breadth_first(nodes)
    for tree, i, _, r in reversed(walk):  # children come after their parents
        if r["left"] < 0:
            below[tree, i] = F.lit(i)
            continue
        x = F.element_at(features, r["feature"] + 1)
        goes = x <= F.lit(r["values"][0]) if r["categories"] < 0 else x.isin(*r["values"])
        below[tree, i] = F.when(goes, below.pop((tree, 2 * i))).otherwise(below.pop((tree, 2 * i + 1)))
    return F.array(*[below[tree, 1] for tree in sorted({tree for tree, *_ in walk})])


def rules(nodes: DataFrame, names: dict[int, str] | None = None, all_known: bool = True) -> list[tuple[int, int, float, int, list[str]]]:
    """(tree, leaf, prediction, depth, conditions) from root to leaf; the nodes of a forest of bounded depth.

    The right side of categories names the other ones, or, unless all are known, denies those of the left.
    """
    names, out, trees = names or {}, [], {}
    for r in nodes.collect():
        trees.setdefault(r["tree"], {})[r["id"]] = r
    for tree, table in sorted(trees.items()):
        level = [(0, [])]
        while level:
            below = []
            for i, path in level:
                r = table[i]
                if r["left"] < 0:
                    out.append((tree, i, r["prediction"], len(path), path))
                    continue
                name, values = names.get(r["feature"], f"f_{r['feature']}"), list(r["values"])
                if r["categories"] < 0:
                    yes, no = f"({name} <= {values[0]})", f"({name} > {values[0]})"
                else:
                    rest = [float(c) for c in range(r["categories"]) if float(c) not in values]
                    shown = [f"[{','.join(map(str, v))}]" for v in (values, rest)]
                    yes, no = f"({name} in {shown[0]})", f"({name} in {shown[1]})" if all_known else f"({name} not-in {shown[0]})"
                below += [(r["left"], [*path, yes]), (r["right"], [*path, no])]
            level = below
    return out
