"""Statistics of scans: entropy, neighbours' correlation, and the least-squares cost model."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def character_histogram(chars: DataFrame) -> DataFrame:
    return chars.groupBy("ch").agg(F.count("*").alias("n"))


def entropy(chars: DataFrame) -> DataFrame:
    """Shannon entropy in bits of the characters of all rows."""
    n = character_histogram(chars)
    total = n.agg(F.sum("n").alias("total"))
    p = F.col("n") / F.col("total")
    return n.join(F.broadcast(total)).agg((-F.sum(p * F.log2(p))).alias("entropy"))  # total: one row


def lag_correlation(values: DataFrame, value: str, keys: list[str], order: str) -> DataFrame:
    """Correlation of each value with the one before it within the keys."""
    w = Window.partitionBy(*keys).orderBy(order)
    return values.withColumn("__before", F.lag(value).over(w)).agg(F.corr("__before", value).alias("lag1"))


def linear_fit(df: DataFrame, y: str, x: str) -> DataFrame:
    """Least squares of y on x: slope, intercept, r2."""
    return df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))


def fit_plane(df: DataFrame, y: str, xs: list[str]) -> dict[str, float]:
    """Least squares of y on 1 and xs, from sums alone (one row to the driver): coefficients by name, and r2."""
    import numpy as np

    names = ["1", *xs, y]
    cols = [F.lit(1.0), *[F.col(c).cast("double") for c in xs], F.col(y).cast("double")]
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    row = df.agg(*[F.sum(cols[i] * cols[j]).alias(f"s{i}_{j}") for i, j in pairs]).first()
    m = np.zeros((len(cols), len(cols)))
    for i, j in pairs:
        m[i, j] = m[j, i] = row[f"s{i}_{j}"] or 0.0
    k = len(cols) - 1
    beta = np.linalg.lstsq(m[:k, :k], m[:k, k], rcond=None)[0]
    n, sy, syy = m[0, 0], m[0, k], m[k, k]
    rest = syy - 2 * beta @ m[:k, k] + beta @ m[:k, :k] @ beta
    whole = syy - sy * sy / max(n, 1)
    return dict(zip(["intercept", *xs], map(float, beta), strict=True)) | {"r2": float(1 - rest / whole) if whole else 1.0}


def plane(df: DataFrame, y: str, xs: list[str]) -> DataFrame:
    """fit_plane() as one row: intercept, a column b_<x> per variable, r2."""
    fit = fit_plane(df, y, xs)
    names = ["intercept", *[f"b_{x}" for x in xs], "r2"]
    return df.sparkSession.createDataFrame([tuple(fit.values())], ", ".join(f"`{n}` double" for n in names))


def quadratic(df: DataFrame, y: str, x: str) -> DataFrame:
    """Least squares of y on 1, x and x squared: one row with intercept, b_x1, b_x2, r2."""
    squares = df.select(F.col(y).cast("double").alias("y"), F.col(x).cast("double").alias("x1"), (F.col(x).cast("double") * F.col(x)).alias("x2"))
    return plane(squares, "y", ["x1", "x2"])
