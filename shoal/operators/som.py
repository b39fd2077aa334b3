"""Self-organising maps: batch training, scoring, and pipeline stages."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasPredictionCol, HasSeed
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def hood(centre: int, size: int, sigma: float) -> np.ndarray:
    return np.exp(-((np.arange(size) - centre) ** 2) / sigma**2)


class SOM:
    """A codebook of xdim * ydim cells; a cell's number is x * ydim + y."""

    def __init__(self, xdim: int, ydim: int, codebook: np.ndarray, quality: dict | None = None):
        self.xdim, self.ydim, self.codebook, self.quality = xdim, ydim, codebook, quality

    @classmethod
    def random(cls, xdim: int, ydim: int, width: int, seed: int = 0) -> SOM:
        return cls(xdim, ydim, np.random.default_rng(seed).random((xdim * ydim, width)))

    def closest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell of greatest cosine similarity (lowest of equals), and the similarity; NaN for a row of zeros."""
        with np.errstate(invalid="ignore", divide="ignore"):
            sims = (rows / np.linalg.norm(rows, axis=1, keepdims=True)) @ (self.codebook / np.linalg.norm(self.codebook, axis=1, keepdims=True)).T
        cell = np.argmax(np.nan_to_num(sims, nan=-2.0), axis=1)
        return cell, sims[np.arange(len(rows)), cell]

    def step(self, counts: np.ndarray, sums: np.ndarray, sigma_x: float, sigma_y: float) -> np.ndarray:
        """Cells after an epoch; a cell without mass keeps its weights."""
        near_x = np.stack([hood(i, self.xdim, sigma_x) for i in range(self.xdim)])
        near_y = np.stack([hood(i, self.ydim, sigma_y) for i in range(self.ydim)])
        near = np.kron(near_x, near_y)
        mass = near @ counts
        return np.where(mass[:, None] > 0, (near @ sums) / np.where(mass > 0, mass, 1)[:, None], self.codebook)

    def transform(self, df: DataFrame, features: str, prediction: str = "prediction", similarity: str = "similarity") -> DataFrame:
        """df with the cell and similarity of an array column."""
        this = SOM(self.xdim, self.ydim, self.codebook)

        @F.pandas_udf("cell int, sim double")
        def score(rows: pd.Series) -> pd.DataFrame:
            cell, sim = this.closest(np.stack(rows.to_list()).astype(float))
            return pd.DataFrame({"cell": cell, "sim": sim})

        return df.withColumn("_s", score(F.col(features))).withColumn(prediction, F.col("_s.cell")).withColumn(similarity, F.col("_s.sim")).drop("_s")

    def pixels(self, spark: SparkSession) -> DataFrame:
        """(x, y, rgb) of a map of three features."""
        from ..sources.io import rgb

        rows = [(i // self.ydim, i % self.ydim, *map(float, w[:3])) for i, w in enumerate(self.codebook)]
        return spark.createDataFrame(rows, "x int, y int, r double, g double, b double").select("x", "y", rgb(F.col("r"), F.col("g"), F.col("b")).alias("rgb"))

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(i, self.xdim, self.ydim, w.tolist()) for i, w in enumerate(self.codebook)]
        spark.createDataFrame(rows, "cell int, xdim int, ydim int, w array<double>").write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> SOM:
        rows = sorted(spark.read.parquet(path).collect())
        return cls(rows[0]["xdim"], rows[0]["ydim"], np.array([r["w"] for r in rows]))


def train(df: DataFrame, features: str, xdim: int, ydim: int, epochs: int, seed: int = 0, sigma_scale: float = 0.95, min_sigma: float = 1.0, hook: Callable[[int, SOM], None] = lambda t, som: None) -> SOM:
    """Batch training: per epoch one pass that sums the rows of each cell; sums of cells, not rows, reach the driver."""
    rows = df.select(features).persist()
    first = rows.first()
    if first is None:
        raise ValueError("no rows to train on")
    som = SOM.random(xdim, ydim, len(first[0]), seed)
    hook(0, som)
    for t in range(epochs):
        sigma_x, sigma_y = (d * sigma_scale - t * ((d * sigma_scale - min_sigma) / epochs) for d in (xdim, ydim))
        now = SOM(xdim, ydim, som.codebook)

        def sums(batches, now=now):
            n, total, sims = np.zeros(xdim * ydim), np.zeros_like(now.codebook), []
            for pdf in batches:
                if len(pdf):
                    x = np.stack(pdf[features].to_list()).astype(float)
                    cell, sim = now.closest(x)
                    np.add.at(n, cell, 1)
                    np.add.at(total, cell, x)
                    sims.append(sim)
            sims = np.concatenate(sims) if sims else np.zeros(0)
            used = np.flatnonzero(n)
            if len(used):  # a partition may be empty, and Arrow takes no empty frame for arrays
                yield pd.DataFrame({"cell": used, "n": n[used], "total": list(total[used]), "s": 0.0, "q": 0.0})
            yield pd.DataFrame({"cell": [-1], "n": [float(len(sims))], "total": [[sims.min() if len(sims) else np.inf, sims.max() if len(sims) else -np.inf]], "s": [sims.sum()], "q": [(sims**2).sum()]})

        got = rows.mapInPandas(sums, "cell int, n double, total array<double>, s double, q double").collect()  # at most cells + 1 rows from each partition
        counts, total, stat = np.zeros(xdim * ydim), np.zeros_like(som.codebook), [r for r in got if r["cell"] < 0]
        for r in got:
            if r["cell"] >= 0:
                counts[r["cell"]] += r["n"]
                total[r["cell"]] += np.array(r["total"])
        n = sum(r["n"] for r in stat)
        mean = sum(r["s"] for r in stat) / n
        quality = {"n": int(n), "mean": mean, "least": min(r["total"][0] for r in stat), "most": max(r["total"][1] for r in stat), "variance": max(0.0, sum(r["q"] for r in stat) / n - mean**2)}
        som = SOM(xdim, ydim, som.step(counts, total, max(sigma_x, 1e-9), max(sigma_y, 1e-9)), quality)
        hook(t + 1, som)
    rows.unpersist()
    return som


class _SOMParams(HasFeaturesCol, HasPredictionCol, HasSeed):
    x = Param(Params._dummy(), "x", "cells across, at least 1", TypeConverters.toInt)
    y = Param(Params._dummy(), "y", "cells down, at least 1", TypeConverters.toInt)
    epochs = Param(Params._dummy(), "epochs", "passes over the rows", TypeConverters.toInt)
    similarityCol = Param(Params._dummy(), "similarityCol", "name of the similarity", TypeConverters.toString)

    def check(self, schema: T.StructType) -> None:
        """The features must be vectors, and the columns to add mustn't be there."""
        column = self.getOrDefault("featuresCol")
        if column not in schema.names or not isinstance(schema[column].dataType, VectorUDT):
            raise ValueError(f"{column} isn't a vector column")
        for c in ("predictionCol", "similarityCol"):
            if self.getOrDefault(c) in schema.names:
                raise ValueError(f"{self.getOrDefault(c)} is there already")


class SOMEstimator(Estimator, _SOMParams):
    @keyword_only
    def __init__(self, *, x=8, y=8, epochs=10, featuresCol="features", predictionCol="prediction", similarityCol="similarity", seed=0):
        super().__init__()
        given = dict(x=x, y=y, epochs=epochs, featuresCol=featuresCol, predictionCol=predictionCol, similarityCol=similarityCol, seed=seed)
        if x < 1 or y < 1 or epochs < 0:
            raise ValueError("a parameter is out of range")
        self._set(**given)

    def _fit(self, df: DataFrame) -> SOMModel:
        self.check(df.schema)
        get = self.getOrDefault
        rows = df.select(vector_to_array(get("featuresCol")).alias("f"))
        som = train(rows, "f", get("x"), get("y"), get("epochs"), get("seed"))
        return self._copyValues(SOMModel(som))


class SOMModel(Model, _SOMParams):
    def __init__(self, som: SOM):
        super().__init__()
        self.som = som

    def _transform(self, df: DataFrame) -> DataFrame:
        self.check(df.schema)
        get = self.getOrDefault
        rows = df.withColumn("_f", vector_to_array(get("featuresCol")))
        return self.som.transform(rows, "_f", get("predictionCol"), get("similarityCol")).drop("_f")
