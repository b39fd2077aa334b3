"""Association of two columns, and the fit of distances to a distribution."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cramers_v(df: DataFrame, x: Column, y: Column, compat: bool = False) -> DataFrame:
    """One row v: Cramer's V from the contingency table.

    1 if both have one level, 0 if empty or only one has one level. compat takes
    the levels of x alone for the degrees of freedom.
    """
    pairs = df.groupBy(x.alias("x"), y.alias("y")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    rows = pairs.groupBy("x").agg(F.sum("n").alias("nx"))
    columns = pairs.groupBy("y").agg(F.sum("n").alias("ny"))
    both = pairs.join(rows, pairs["x"].eqNullSafe(rows["x"])).join(columns, pairs["y"].eqNullSafe(columns["y"]))
    # absent pairs have chi2 of their expectation: the sum over all pairs is n * (sum n^2 / (nx * ny) - 1)
    stat = both.agg(F.sum(F.col("n") * F.col("n") / (F.col("nx") * F.col("ny"))).alias("s"))
    levels = rows.agg(F.count(F.lit(1)).alias("kx"), F.sum("nx").alias("total")).crossJoin(columns.agg(F.count(F.lit(1)).alias("ky"))).crossJoin(stat)  # one row each
    degrees = F.col("kx") - 1 if compat else F.least("kx", "ky") - 1
    v = F.when(F.coalesce(F.col("total"), F.lit(0.0)) == 0, 0.0).when((F.col("kx") == 1) & (F.col("ky") == 1), 1.0).when((F.col("kx") == 1) | (F.col("ky") == 1), 0.0)
    return levels.select(v.otherwise(F.sqrt(F.greatest(F.col("s") - 1, F.lit(0.0)) / degrees)).alias("v"))


def permutation_p(df: DataFrame, x: str, y: str, rounds: int = 1000, seed: int = 0) -> float:
    """1 - share of the rounds in which V of shuffled pairs is less than V.

    The contingency table, as many rows as pairs of levels, is all that leaves the
    executors; a shuffled table is drawn from its marginals, level by level of x,
    as so many draws without replacement from the levels of y.
    """
    cells = df.groupBy(F.col(x).alias("x"), F.col(y).alias("y")).count().collect()
    if not cells:
        return 0.0
    xs, ys = ({v: i for i, v in enumerate(sorted({r[c] for r in cells}, key=str))} for c in (0, 1))
    table = np.zeros((len(xs), len(ys)), dtype=np.int64)
    for r in cells:
        table[xs[r[0]], ys[r[1]]] = r[2]
    rng = np.random.default_rng(seed)

    def shuffled():
        left, out = table.sum(0), np.zeros_like(table)
        for i, n in enumerate(table.sum(1)):
            out[i] = rng.multivariate_hypergeometric(left, n, method="marginals")
            left = left - out[i]
        return out

    def v(t):
        if 1 in t.shape:
            return 1.0 if t.shape == (1, 1) else 0.0
        expected = np.outer(t.sum(1), t.sum(0)) / t.sum()
        return math.sqrt(((t - expected) ** 2 / expected).sum() / t.sum() / (min(t.shape) - 1))

    observed, less = v(table), 0
    for _ in range(rounds):
        less += v(shuffled()) < observed - 1e-12
    return 1 - less / rounds


def ks_two_sample(a: DataFrame, b: DataFrame, value: str) -> DataFrame:
    """One row d: the greatest distance of the distributions of a column in two frames, nulls left out; null if one is empty."""
    from ..operators.ordered import scan

    side = lambda df, mine: df.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("x"), F.lit(int(mine)).alias("na"), F.lit(int(not mine)).alias("nb"))
    counts = side(a, True).unionByName(side(b, False)).groupBy("x").agg(F.sum("na").alias("na"), F.sum("nb").alias("nb"))
    both = scan(scan(counts, "na", "x", name="upto_a"), "nb", "x", name="upto_b")
    totals = counts.agg(F.sum("na").alias("all_a"), F.sum("nb").alias("all_b"))
    far = F.max(F.abs(F.col("upto_a") / F.nullif(F.col("all_a"), F.lit(0)) - F.col("upto_b") / F.nullif(F.col("all_b"), F.lit(0))))
    return both.crossJoin(F.broadcast(totals)).agg(far.alias("d"))  # totals are one row


def gamma_cdf(shape: float, x: np.ndarray) -> np.ndarray:
    """Regularised lower incomplete gamma function: a series below shape + 1, a continued fraction above."""
    out = np.zeros(len(x))
    for i, v in enumerate(np.asarray(x, dtype=float)):
        if v <= 0:
            continue
        front = math.exp(shape * math.log(v) - v - math.lgamma(shape))
        if v < shape + 1:
            term = total = 1 / shape
            for k in range(1, 1000):
                term *= v / (shape + k)
                total += term
                if term < total * 1e-14:
                    break
            out[i] = front * total
        else:
            b, c = v + 1 - shape, 1e300
            d = h = 1 / b
            for k in range(1, 1000):
                a = -k * (k - shape)
                b += 2
                d = 1 / (a * d + b)
                c = b + a / c
                h *= d * c
                if abs(d * c - 1) < 1e-14:
                    break
            out[i] = 1 - front * h
    return out


def _gamma(mean_positive: float, mean_log: float) -> tuple[float, float]:
    """Shape, 1 at least, and scale, both of the distances over 0."""
    s = max(1e-12, math.log(mean_positive) - mean_log)
    shape = max(1.0, (3 - s + math.sqrt((s - 3) ** 2 + 24 * s)) / (12 * s))
    return shape, mean_positive / shape


def _density(shape: float, scale: float, mean: float, gamma: bool):
    if gamma:
        return (lambda x: math.exp((shape - 1) * math.log(x) - x / scale - math.lgamma(shape) - shape * math.log(scale)) if x > 0 else (1 / scale if shape == 1 else 0.0)), 2
    return (lambda x: math.exp(-x / mean) / mean), 2


def fit_pdf(data: np.ndarray):
    """(density, number of parameters) of the better of gamma (shape at least 1) and exponential by the KS distance."""
    data = np.sort(np.asarray(data, dtype=float))
    positive = data[data > 0]
    if not len(positive):
        return (lambda x: 1e10), 0
    mean = data.mean()
    shape, scale = _gamma(positive.mean(), np.log(positive).mean())
    steps = np.arange(1, len(data) + 1) / len(data)
    ks = lambda cdf: max(np.abs(cdf - steps).max(), np.abs(cdf - steps + 1 / len(data)).max())
    return _density(shape, scale, mean, ks(gamma_cdf(shape, data / scale)) <= ks(1 - np.exp(-data / mean)))


def fit_pdf_of(df: DataFrame, x: Column):
    """fit_pdf of a column, nulls left out: moments by aggregation, KS distances by the running count of its values."""
    from ..operators.ordered import scan

    counts = df.select(x.cast("double").alias("x")).where("x is not null").groupBy("x").agg(F.count(F.lit(1)).alias("n"))
    ranked = scan(counts, "n", "x", name="upto")
    positive = F.col("x") > 0
    sums = [F.sum("n"), F.sum(F.col("x") * F.col("n")), F.sum(F.when(positive, F.col("n"))), F.sum(F.when(positive, F.col("x") * F.col("n"))), F.sum(F.when(positive, F.log("x") * F.col("n")))]
    n, total, n_positive, total_positive, logs = ranked.agg(*sums).first()
    if not n_positive:
        return (lambda x: 1e10), 0
    mean = total / n
    shape, scale = _gamma(total_positive / n_positive, logs / n_positive)

    def distances(batches):
        import pandas as pd

        for pdf in batches:
            v, upto, count = (pdf[c].to_numpy() for c in ("x", "upto", "n"))
            far = [np.maximum(np.abs(cdf - upto / n), np.abs(cdf - (upto - count) / n)).max(initial=0.0) for cdf in (gamma_cdf(shape, v / scale), 1 - np.exp(-v / mean))]
            yield pd.DataFrame([far], columns=["g", "e"])

    far = ranked.select("x", "n", "upto").mapInPandas(distances, "g double, e double").agg(F.max("g"), F.max("e")).first()
    return _density(shape, scale, mean, far[0] <= far[1])
