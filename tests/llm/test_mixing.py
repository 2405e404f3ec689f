import re

from pyspark.sql import functions as F

from sedimento.llm import mixing as M

DOCS = "doc_id long, text string, source string, epochs double, tokens long"


def docs(spark, rows):
    return spark.createDataFrame([(*r, 9.0, 9) for r in rows], DOCS)


def targets(spark, rows):
    return spark.createDataFrame(list(rows), "source_name string, target_share double, max_repeats int")


def test_tokens(spark):
    texts = ["", None, "Hello, wörld 数据a_1", "---", "x" * 300_000, "a\nb\r\nc", "１２"]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(M.tokens(F.col("t"))).collect()]
    assert got == [len(re.findall(r"[一-鿿]|[A-Za-z0-9_]+", t or "")) for t in texts]


def test_water_fill():
    s = {x.source: x for x in M.water_fill([("a", 100, 0.5, 1), ("b", 1000, 0.3, 2), ("c", 1000, 0.2, 2)], 1000)}
    assert s["a"].epochs == 1 and s["a"].short and not s["b"].short
    assert abs(s["b"].epochs * 1000 - 540) < 1e-6 and abs(s["c"].epochs * 1000 - 360) < 1e-6
    assert all(x.epochs == x.cap for x in M.water_fill([("a", 1, 0.5, 1), ("b", 1, 0.5, 3)], 1000))
    assert M.water_fill([("a", 0, 1.0, 5)], 10)[0].epochs == 0 and M.water_fill([], 10) == []


def test_mix(spark):
    rows = [(i, "w " * 10, ["Big Src", " big-src", "BIG_SRC"][i % 3]) for i in range(1000)] + [(2000 + i, "w " * 10, "small") for i in range(20)] + [(3000, "w " * 10, None), (3001, None, "small"), (3002, "", " ")]
    t = targets(spark, [("big_src", 0.5, 1), ("small", 0.5, 3), ("none", 0.0, 2), (None, 0.1, 1)])
    rep = {r.source_name: r for r in M.report(docs(spark, rows), t).collect()}
    assert rep["small"].short and rep["small"].epochs == 3.0 and not rep["none"].short
    assert abs(rep["big_src"].epochs - (5105 - 600) / 10000) < 1e-9
    drawn = M.mix(docs(spark, rows), t).groupBy("source_name").agg(F.count("*").alias("n"), F.max("repeat").alias("r")).collect()
    n = {r.source_name: (r.n, r.r) for r in drawn}
    assert n["small"] == (63, 2) and abs(n["big_src"][0] - 450) < 70 and n["big_src"][1] == 0
    held = {r.source_name: r for r in M.mix_shares(docs(spark, rows), t).collect()}
    assert set(held) == {"small", "big_src", "none"} and held["none"].uses == 0 and held["small"].tokens == 600
    assert abs(held["big_src"].actual_share - held["big_src"].planned_share) < 0.05
    assert {(r.source_name, r.short, r.capped) for r in M.checked(docs(spark, rows), t).collect()} == {("small", True, True), ("big_src", False, True), ("none", False, True)}


def test_empty(spark):
    t = targets(spark, [("a", 0.5, 1)])
    assert [(r.epochs, r.short) for r in M.report(docs(spark, []), t).collect()] == [(0.0, False)]
    assert M.mix(docs(spark, []), t).collect() == [] and M.report(docs(spark, [(1, "x", "a")]), t.where("false")).collect() == []
