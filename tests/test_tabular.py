import math
import random

import numpy as np
import pytest

from sedimento.operators import evaluate, tabular


def test_exact_quantiles(spark, monkeypatch):
    monkeypatch.setattr(tabular, "BINS", 16)
    monkeypatch.setattr(tabular, "FEW", 5)
    r = random.Random(1)
    for values in ([r.gauss(0, 1) for _ in range(300)], [1.0] * 50, [1.0, 1.0, 1e12, -1e12, float("nan")], [r.choice([1.0, 2.0]) for _ in range(99)], []):
        df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
        clean = [v for v in values if not math.isnan(v)]
        got = tabular.exact_quantiles(df, "v", [0.0, 0.25, 0.5, 1.0])
        assert got == [None] * 4 if not clean else np.allclose(got, np.quantile(clean, [0.0, 0.25, 0.5, 1.0]))


def test_missing_and_outliers(spark):
    df = spark.createDataFrame([(1.0, "b"), (float("nan"), "a"), (None, None), (3.0, "b"), (2.0, "a")], "x double, s string")
    assert {(r.column_name, r.missing, r.total) for r in tabular.missing_counts(df, ["x", "s"]).collect()} == {("x", 2, 5), ("s", 1, 5)}
    filled = tabular.fill_missing(df, ["x", "s"], "median").collect()
    assert sorted(r.x for r in filled) == [1, 2, 2, 2, 3] and sorted(r.s for r in filled) == ["a", "a", "a", "b", "b"]
    assert tabular.fill_missing(df, ["x", "s"], "drop").count() == 3
    assert tabular.normalize(spark.createDataFrame([(5.0,), (5.0,)], "x double"), ["x"]).first().x == 0.0
    assert tabular.normalize(spark.createDataFrame([(5.0,)], "x double"), ["x"], "zscore").first().x is None
    assert [r.x_outlier for r in tabular.clip_outliers(spark.createDataFrame([(float(i),) for i in range(20)] + [(1e6,)], "x double"), ["x"]).orderBy("x").collect()].count(True) == 1
    assert {r.issue for r in tabular.table_quality(df, ["x", "s"]).collect()} == {"missing_values"}


def test_open_set_metrics(spark):
    pairs = [(0, 0)] * 8 + [(0, 1)] * 2 + [(1, 1)] * 5 + [(2, 2)] * 3 + [(2, 0)] + [(None, 1)]
    m = evaluate.openset_metrics(evaluate.confusion(spark.createDataFrame(pairs, "truth int, pred int"))).first()
    rec, pre = [0.8, 1.0, 0.75], [8 / 9, 5 / 7, 1.0]
    assert math.isclose(m.accuracy, 16 / 19) and math.isclose(m.nma, sum(rec) / 3) and math.isclose(m.gmean, math.prod(rec) ** (1 / 3))
    p, r = sum(pre[:2]) / 2, sum(rec[:2]) / 2
    assert math.isclose(m.osfm, 2 * p * r / (p + r))


def test_weibull_recovers_its_parameters():
    x = 2.5 * np.random.default_rng(1).weibull(3.0, 4000)
    k, s = evaluate.weibull(x)
    assert abs(k - 3) < 0.15 and abs(s - 2.5) < 0.05
    assert evaluate.agent_scores(1, 1)["overall"] > 0 and evaluate.sample_ratio(0, 3)["ratio"] == 3.0


@pytest.mark.parametrize("rows,verdict", [([("a", 1.0, 1.2)], "clearly better"), ([("a", 1.0, 0.9)], "not better")])
def test_report(spark, rows, verdict):
    b = spark.createDataFrame([(m, x) for m, x, _ in rows], "metric string, value double")
    e = spark.createDataFrame([(m, y) for m, _, y in rows], "metric string, value double")
    assert evaluate.comparison_report(evaluate.metric_compare(b, e)).endswith(verdict)
