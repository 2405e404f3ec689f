import random
from datetime import datetime

from sedimento.operators import orphans as O

T = [datetime(2024, m, 1) for m in range(1, 13)]
CHILD, PARENT = "id long, ref long, at timestamp, deleted string, span int", "id long, deleted boolean, created_at timestamp, salt int"


def run(spark, child, parent):
    c = spark.createDataFrame([(*x, "no", 9) for x in child], CHILD)
    p = spark.createDataFrame([(*x, 3) for x in parent], PARENT)
    return O.orphans([O.Reference("c", "ref", c, "p")], {"p": p})


def test_kinds_and_repeats(spark):
    child = [(1, 10, T[3]), (2, 99, T[3]), (3, 11, T[3]), (4, 12, T[0]), (4, 12, T[5]), (5, None, T[0]), (6, 0, T[0]), (7, 12, None), (8, 13, T[0]), (2, 99, T[1]), (None, 99, T[1]), (9, 1 << 40, T[0]), (10, -7, T[0])]
    parent = [(10, False, T[0]), (11, True, None), (12, None, T[2]), (13, False, None), (None, True, T[0])]
    got = {(x.record_id, x.orphan_kind) for x in run(spark, child, parent).collect()}
    assert got == {(2, "missing"), (3, "deleted"), (4, "late"), (9, "missing"), (10, "missing")}
    report = {(x.orphan_kind, x.period): x.n for x in O.orphan_report(run(spark, child, parent)).collect()}
    assert report[("missing", "2024-02")] == 1 and report[("late", "2024-01")] == 1


def test_empty_tables(spark):
    assert {(x.record_id, x.orphan_kind) for x in run(spark, [(1, 5, None)], []).collect()} == {(1, "missing")}
    assert run(spark, [], [(1, False, T[0])]).collect() == []


def test_thousands_of_hot_ranges_are_split(spark):
    """2,000 ranges above the limit, one of them far above it, against brute force."""
    rng = random.Random(5)
    child = [(n, (n % 2000) * O.RANGE_WIDTH + rng.choice((7, 8)), T[1]) for n in range(1, 12001)] + [(n, 3, T[1]) for n in range(20000, 20300)]
    parent = [(k * O.RANGE_WIDTH + 7, False, T[0]) for k in range(0, 2000, 2)]
    there = {x[0] for x in parent}
    c = spark.createDataFrame([(*x, "no", 9) for x in child], CHILD)
    p = spark.createDataFrame([(*x, 3) for x in parent], PARENT)
    got = {x.record_id for x in O.orphans([O.Reference("c", "ref", c, "p")], {"p": p}, refs_a_task=2).collect()}
    assert got == {n for n, ref, _ in child if ref not in there}
