from pyspark.sql import functions as F

from sedimento import session
from sedimento.operators import ranking as R


def test_hot_keys_are_cut_into_parts_and_lose_nothing(spark):
    rows = spark.createDataFrame([(i, "hot" if i % 2 else f"k{i % 7}") for i in range(1000)] + [(1001, None), (1002, "none")], "id long, k string")
    groups = spark.createDataFrame([("hot", 1), *((f"k{i}", 2) for i in range(7))], "k string, v int")
    hot = R.hot_keys(rows, ["k"], 100)
    assert {(r.k, r.parts__) for r in hot.collect()} == {("hot", 5)}
    assert {r.salt__ for r in R.salted(rows, hot, ["k"], "id").where("k = 'hot'").collect()} == set(range(5))
    assert R.copied(groups, hot, ["k"]).count() == 12
    for least in (100, 10_000):
        got = R.attach(rows, groups, "k", "id", least).collect()
        assert sorted(r.id for r in got) == list(range(1000)) and {r.v for r in got if r.k == "hot"} == {1}


def test_values_looked_up_with_and_without_broadcast(spark, monkeypatch):
    rows = spark.createDataFrame([(i, "hot" if i % 2 else f"k{i % 7}") for i in range(300)] + [(301, None), (302, "none")], "id long, k string")
    values = spark.createDataFrame([("hot", 1), *((f"k{i}", 2) for i in range(7))], "k string, v int")
    want = sorted((r.id, r.v) for r in R.looked_up(rows, values, "k", "id").collect() if r.v)
    monkeypatch.setattr(R, "MAX_HOT", 3)
    assert sorted((r.id, r.v) for r in R.looked_up(rows, values, "k", "id").collect() if r.v) == want and len(want) == 300


def test_written_tables_are_removed(spark):
    import os

    a = session.cut(spark.range(5))
    b, seen = session.cut_counted(spark.range(7), n=F.count("*"))
    assert a.count() == 5 and seen["n"] == 7 == b.count()
    place = a.written_to.removeprefix("file://")
    assert os.path.isdir(place)
    session.release(a, spark.range(3))
    assert not os.path.isdir(place) and b.count() == 7
    session.clean(spark)
    assert not os.path.isdir(b.written_to.removeprefix("file://")) and session.cut(spark.range(2)).count() == 2
