"""Trainers on feature vectors with Spark's own learners, in place of the deep networks that have no library here."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimento.operators.splits import stratified

CELL, BINS = 64, 8


class InsufficientData(ValueError):
    code = "INSUFFICIENT_DATA"


def image_features(x: np.ndarray, size: int = 256) -> list[float]:
    """Gradient directions in 64-pixel cells and colour histograms of an image resized to 256 x 256."""
    ys, xs = [np.minimum((np.arange(size) * n / size).astype(int), n - 1) for n in x.shape[:2]]
    s = x[ys][:, xs].astype(float)
    g = s.mean(2)
    gy, gx = np.gradient(g)
    m, d = np.hypot(gx, gy), ((np.arctan2(gy, gx) + np.pi) / (2 * np.pi) * BINS).astype(int) % BINS
    out: list[float] = []
    for a in range(0, size, CELL):
        for b in range(0, size, CELL):
            h = np.bincount(d[a : a + CELL, b : b + CELL].ravel(), m[a : a + CELL, b : b + CELL].ravel(), BINS)
            out += list(h / (h.sum() + 1e-9))
    for c in range(3):
        h = np.bincount((s[..., min(c, s.shape[2] - 1)] / 32).astype(int).clip(0, 7).ravel(), minlength=8)
        out += list(h / h.sum())
    return out


def _vectors(df: DataFrame) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return df.withColumn("features", array_to_vector(F.transform("embedding", lambda v: v.cast("double"))))


def forest(vectors: DataFrame, trees: int = 50, depth: int = 8, seed: int = 0) -> tuple[object, float]:
    """(model, train accuracy) of a random forest over (label, embedding).

    If any label is missing, all are replaced by at most three clusters. Fewer than two rows raise InsufficientData.
    """
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.clustering import KMeans

    n, missing = vectors.agg(F.count("*"), F.count_if(F.col("label").isNull())).first()
    if n < 2:
        raise InsufficientData(f"{n} samples")
    x = _vectors(vectors)
    if missing:
        x = KMeans(k=min(3, n), seed=seed, predictionCol="cluster").fit(x).transform(x).withColumn("label", F.col("cluster")).drop("cluster")
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed).fit(x.withColumn("label", F.col("label").cast("double")))
    right = model.transform(x).agg(F.avg((F.col("prediction") == F.col("label").cast("double")).cast("double"))).first()[0]
    return model, right


def classifier(vectors: DataFrame, key: str, epochs: int = 10, seed: int = 0) -> dict[str, float]:
    """Train, validation and test accuracy of a logistic regression on a stratified 6 : 2 : 2 split; needs ten labelled rows."""
    from pyspark.ml.classification import LogisticRegression

    x = vectors.where("label is not null")
    if x.count() < 10:
        raise InsufficientData("fewer than ten labelled samples")
    parts = _vectors(stratified(x, ["label"], key, {"train": 0.6, "validation": 0.2, "test": 0.2}, seed)).withColumn("label", F.col("label").cast("double"))
    model = LogisticRegression(maxIter=epochs).fit(parts.where("split = 'train'"))
    scored = model.transform(parts).groupBy("split").agg(F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("accuracy"))
    return {r["split"]: r["accuracy"] for r in scored.collect()}
