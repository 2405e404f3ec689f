"""Evaluation: comparisons of two datasets, open-set metrics, extreme-value recalibration."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimento.operators.ranking import looked_up, numbered
from sedimento.session import cut

TAIL, ALPHA, UNKNOWN_BELOW = 20, 2, 0.5


def sample_ratio(baseline: int, target: int) -> dict[str, float]:
    return {"baseline_count": baseline, "target_count": target, "ratio": round(target / max(baseline, 1), 2)}


def agent_scores(baseline: int, target: int, agents: int = 4) -> dict[str, float]:
    """Scores of a simulated team from the two dataset sizes."""
    coverage = min(100.0, 100.0 * target / max(baseline, target, 1))
    coordination = min(100.0, 62.0 + 4.5 * max(1, agents))
    response = min(100.0, 70.0 + 1.2 * min(target, 20))
    return {"coverage": coverage, "coordination": coordination, "response": response, "overall": round(0.35 * coverage + 0.35 * coordination + 0.3 * response, 2)}


def confusion(pairs: DataFrame) -> DataFrame:
    """truth, pred, n of rows (truth, pred); rows where either is null are left out."""
    return pairs.where("truth is not null and pred is not null").groupBy("truth", "pred").agg(F.count("*").alias("n"))


def openset_metrics(counts: DataFrame) -> DataFrame:
    """One row: accuracy, osfm, macro_f1, gmean, nma from a confusion matrix (truth, pred, n).

    The last label in order is the unknown class. osfm is the F measure of the mean precision and recall over the other
    labels (0 if both are 0, null without known labels); macro_f1 is over all labels, 0 where undefined; gmean is the
    geometric mean of the recalls, null if a label never occurs as truth, 0 if one is never hit; nma is the mean recall
    over the labels that occur. The matrix has as many rows as label pairs, never as data rows.
    """
    row = counts.groupBy(F.col("truth").alias("label")).agg(F.sum("n").alias("t"), F.sum(F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(0)).alias("tp"))
    col = counts.groupBy(F.col("pred").alias("label")).agg(F.sum("n").alias("p"))
    x = row.join(col, "label", "full").select("label", *[F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in ("t", "tp", "p")])
    rec, pre = F.when(F.col("t") > 0, F.col("tp") / F.col("t")), F.when(F.col("p") > 0, F.col("tp") / F.col("p"))
    last = x.agg(F.max("label")).first()[0]
    x = x.withColumns({"rec": rec, "pre": pre, "known": F.col("label") < F.lit(last)})
    kr = lambda c: F.sum(F.when(F.col("known"), F.coalesce(c, F.lit(0.0)))) / F.nullif(F.count_if("known"), F.lit(0))
    f1 = F.when(F.coalesce("rec", F.lit(0.0)) + F.coalesce("pre", F.lit(0.0)) > 0, 2 * F.col("rec") * F.col("pre") / (F.col("rec") + F.col("pre"))).otherwise(0.0)
    return x.agg(
        (F.sum("tp") / F.nullif(F.sum("t"), F.lit(0.0))).alias("accuracy"), kr(F.col("pre")).alias("kp"), kr(F.col("rec")).alias("kr"), F.avg(f1).alias("macro_f1"),
        F.when(F.min("t") > 0, F.when(F.min("rec") > 0, F.exp(F.avg(F.log(F.when(F.col("rec") > 0, F.col("rec")))))).otherwise(0.0)).alias("gmean"), F.avg("rec").alias("nma"),
    ).select("accuracy", F.when(F.col("kp") + F.col("kr") == 0, 0.0).otherwise(2 * F.col("kp") * F.col("kr") / F.nullif(F.col("kp") + F.col("kr"), F.lit(0.0))).alias("osfm"), "macro_f1", "gmean", "nma")


def openset_labels(labels: DataFrame, baseline: DataFrame, known: int) -> DataFrame:
    """id, class_id: the `known` first classes of the baseline are numbered, its others get the number `known` (unknown).

    Labels that the baseline does not have are dropped. Classes may be many: they are numbered over range partitions.
    """
    classes = numbered(baseline.where("label is not null").select("label").distinct(), [], [F.col("label")]).select("label", (F.col("rn") - 1).alias("k"))
    return looked_up(labels.select("id", "label"), cut(classes), "label", "id").where("k is not null").select("id", F.least("k", F.lit(known)).cast("int").alias("class_id"))


def metric_compare(baseline: DataFrame, enhanced: DataFrame) -> DataFrame:
    """metric, baseline, enhanced, improvement (per cent, 0 if the baseline is not above 0); missing metrics count as 0."""
    x = baseline.select("metric", F.col("value").alias("baseline")).join(enhanced.select("metric", F.col("value").alias("enhanced")), "metric", "left").withColumn("enhanced", F.coalesce("enhanced", F.lit(0.0)))
    return x.withColumn("improvement", F.when(F.col("baseline") > 0, (F.col("enhanced") - F.col("baseline")) / F.col("baseline") * 100).otherwise(0.0))


def comparison_report(compared: DataFrame) -> str:
    """Lines for each metric and a verdict: clearly better above 5 per cent on average, better above 0, else not better."""
    rows = compared.orderBy("metric").toLocalIterator()  # metrics are few, and a report lists them all
    lines, total = [], 0.0
    for r in rows:
        lines.append(f"{r['metric']}: {r['baseline']:.4f} -> {r['enhanced']:.4f} ({r['improvement']:+.2f} %)")
        total += r["improvement"]
    mean = total / len(lines) if lines else 0.0
    verdict = "clearly better" if mean > 5 else "better" if mean > 0 else "not better"
    return "\n".join([*lines, f"mean improvement {mean:+.2f} %: {verdict}"])


def class_centroids(vectors: DataFrame) -> DataFrame:
    """label, pos, mean of vectors (label, embedding), one row for each component; combined before the shuffle."""
    x = vectors.where("label is not null and embedding is not null").select("label", F.posexplode("embedding").alias("pos", "v"))
    return x.groupBy("label", "pos").agg(F.avg(F.col("v").cast("double")).alias("mean"))


def centroid_vectors(vectors: DataFrame) -> DataFrame:
    """label, centroid (array<double>)."""
    c = class_centroids(vectors).groupBy("label").agg(F.array_sort(F.collect_list(F.struct("pos", "mean"))).alias("c"))
    return c.select("label", F.transform("c", lambda x: x["mean"]).alias("centroid"))


def distances(vectors: DataFrame, centroids: DataFrame, metric: str = "euclidean", cosine_and: float = 0.5, classes_a_part: int = 1000) -> DataFrame:
    """id, label, distances: to each centroid, as array<struct<d, label>> in ascending order.

    metric: `euclidean`, `cosine` (one minus the cosine; one for vectors without length) or `eucos`, the cosine distance
    plus cosine_and times the Euclidean one. Centroids (label, centroid) are read one row a class, classes_a_part at a
    time; more classes only make more such parts.
    """
    if metric not in ("euclidean", "cosine", "eucos"):
        raise ValueError(metric)
    rows = centroids.orderBy("label").collect()
    if not rows:
        return vectors.select("id", "label", F.array().cast("array<struct<d:double,label:int>>").alias("distances"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, y: s + y)
    euclid = lambda a, b: F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x - y, F.lit(2.0))), F.lit(0.0), lambda s, y: s + y))
    cosine = lambda a, b: 1 - F.coalesce(dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0)), F.lit(0.0))
    measure = {"euclidean": euclid, "cosine": cosine, "eucos": lambda a, b: euclid(a, b) * cosine_and + cosine(a, b)}[metric]
    kind = centroids.schema["label"].dataType

    def part(some: list) -> Column:
        table = F.array(*[F.struct(F.array(*[F.lit(float(v)) for v in r["centroid"]]).alias("c"), F.lit(r["label"]).cast(kind).alias("label")) for r in some])
        return F.transform(table, lambda x: F.struct(measure(F.col("embedding"), x["c"]).alias("d"), x["label"].alias("label")))

    parts = [part(rows[i : i + classes_a_part]) for i in range(0, len(rows), classes_a_part)]
    return vectors.select("id", "label", F.array_sort(F.concat(*parts)).alias("distances"))


def weibull(tail: np.ndarray, rounds: int = 100) -> tuple[float, float]:
    """Shape and scale of a Weibull distribution by maximum likelihood (Newton on the shape)."""
    x = np.maximum(np.asarray(tail, float), 1e-12)
    if len(x) < 2 or np.allclose(x, x[0]):
        return 1e3, float(x.mean()) if len(x) else 1.0
    logs, k = np.log(x), 1.2 / max(np.log(x).std(), 1e-6)
    for _ in range(rounds):
        p = x**k
        a, b, c = p.sum(), (p * logs).sum(), (p * logs**2).sum()
        f, g = b / a - 1 / k - logs.mean(), (c * a - b * b) / a**2 + 1 / k**2
        step = f / g
        k = max(k - step, k / 2)
        if abs(step) < 1e-9 * k:
            break
    return float(k), float((x**k).mean() ** (1 / k))


def tail_models(correct: DataFrame, tail: int = TAIL) -> DataFrame:
    """label, shape, scale from the `tail` largest distances of correctly classified rows (label, d).

    The largest are kept by a bounded aggregate: no group reaches a task whole.
    """
    top = correct.groupBy("label", F.pmod(F.hash("d"), F.lit(64)).alias("s")).agg(F.slice(F.reverse(F.array_sort(F.collect_list("d"))), 1, tail).alias("t"))
    top = top.groupBy("label").agg(F.slice(F.reverse(F.array_sort(F.flatten(F.collect_list("t")))), 1, tail).alias("t"))

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fits = [weibull(np.array(t)) for t in b["t"]]
            yield pd.DataFrame({"label": b["label"], "shape": [f[0] for f in fits], "scale": [f[1] for f in fits]})

    return top.mapInPandas(fit, "label int, shape double, scale double")


def openmax(vectors: DataFrame, tail: int = TAIL, alpha: int = ALPHA, threshold: float = UNKNOWN_BELOW, metric: str = "eucos") -> DataFrame:
    """id, label, pred: nearest-centroid classes; -1 (unknown) where the recalibrated score falls below the threshold.

    Scores are softmax of minus the distances; the `alpha` best classes lose the share that the Weibull model of their
    tail gives to the unknown class.
    """
    d = distances(vectors, centroid_vectors(vectors), metric)
    near = d.select("id", "label", "distances", F.get("distances", F.lit(0))["label"].alias("nearest"), F.get("distances", F.lit(0))["d"].alias("d"))
    models = {r["label"]: (r["shape"], r["scale"]) for r in tail_models(near.where("label = nearest").select("label", "d"), tail).collect()}

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            preds = []
            for ds in b["distances"]:
                e = np.exp(-np.array([x["d"] for x in ds]) + ds[0]["d"])
                p = e / e.sum()
                lost = 0.0
                for i, x in enumerate(list(ds)[:alpha]):
                    shape, scale = models.get(x["label"], (1.0, math.inf))
                    w = (1 - math.exp(-((x["d"] / scale) ** shape))) * (alpha - i) / alpha
                    lost += p[i] * w
                    p[i] *= 1 - w
                best = int(p.argmax())
                preds.append(-1 if lost > p[best] or p[best] < threshold * p.sum() else ds[best]["label"])
            yield pd.DataFrame({"id": b["id"], "label": b["label"], "pred": preds})

    return d.mapInPandas(score, "id long, label int, pred int")


def demo_metrics(epochs: int = 3) -> list[dict[str, float]]:
    """The learning curve of the demonstration trainer."""
    return [{"epoch": e, "accuracy": min(0.99, 0.7 + 0.05 * e), "loss": max(0.01, 0.5 - 0.03 * e)} for e in range(1, epochs + 1)]
