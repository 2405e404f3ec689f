import random

from sedimento.llm import keep_together as K

SCHEMA = "id long, source_sample_id long, labels_json string, metadata_json string, component long, v long, m long"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 1, 1) for r in rows], SCHEMA)


def label(code=None, split=None):
    return '[{"type":"classification","class_path":"c/%s","split":%s}]' % (code or "none", f'"{split}"' if split else "null")


def brute(links):
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        x, y = sorted((top(a), top(b)))
        up[y] = x
    return {x: top(x) for x in up}


def test_components_of_chains_stars_and_random_links(spark):
    r = random.Random(3)
    links = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 560)] + [(r.randrange(1000, 1200), r.randrange(1000, 1200)) for _ in range(120)]
    df = spark.createDataFrame(links + [(None, 3), (4, None), (7, 7)] + links[:5], "a long, b long")
    got = {x.node: x.component for x in K.components(df).collect()}
    assert got == brute([x for x in links if x[0] != x[1]])
    assert K.components(df.where("false")).collect() == []


def test_hot_nodes_are_joined_apart(spark):
    links = [(-5, i) for i in range(1, 80)] + [(90, 91)]
    got = {x.node: x.component for x in K.components(spark.createDataFrame(links, "a long, b long"), hot_rows=10).collect()}
    assert got == brute(links)


def test_torn_groups_and_assignment(spark):
    rows = [
        (10, None, label("AB-00000001", "train"), None), (7, None, label("ab_00000001/", "test"), None), (8, 7, None, None), (9, 777, label("CD-00000002", "dev"), None), (11, 9, label(None, "val"), '{"split":"train"}'),
        (20, 21, label(None, "train"), None), (21, 20, "[{", '{"split":"tst"}'), (30, None, label(), None), (None, 30, None, None), (10, None, label("AB-00000001", "train"), None),
    ]
    s = frame(spark, rows)
    assert {(x.group_id, x.sample_id) for x in K.torn(s).collect()} == {(7, 7), (7, 8), (7, 10), (20, 20), (20, 21)}
    targets = spark.createDataFrame([("train", 0.7), ("test", 0.2), ("validation", 0.1), (None, 0.3), ("none", 0.0)], "split_name string, target_share double")
    split = {x.sample_id: x.split for x in K.assign(s, targets).collect()}
    assert set(split) == {7, 8, 9, 10, 11, 20, 21, 30} and split[7] == split[8] == split[10] and split[9] == split[11] and split[20] == split[21]
    assert K.torn(s.where("false")).collect() == []


def test_shares_are_met(spark):
    s = frame(spark, [(i, None, None, None) for i in range(1, 3001)])
    targets = spark.createDataFrame([("train", 0.7), ("test", 0.2), ("validation", 0.1)], "split_name string, target_share double")
    shares = {x.split_name: x.share for x in K.balance(K.assign(s, targets), targets).collect()}
    assert all(abs(shares[k] - v) < 0.04 for k, v in (("train", 0.7), ("test", 0.2), ("validation", 0.1)))


def test_giant_groups_do_not_upset_the_shares(spark):
    """One group with a third of all samples, one with a tenth; the rest are single."""
    codes = ["AA-00000001"] * 1000 + ["BB-00000002"] * 300 + [None] * 1700
    s = frame(spark, [(i, None, label(c), None) for i, c in enumerate(codes, 1)])
    targets = spark.createDataFrame([("train", 0.7), ("test", 0.2), ("validation", 0.1)], "split_name string, target_share double")
    for seed in (1, 2, 3):
        assigned = K.assign(s, targets, seed)
        shares = {x.split_name: x.share for x in K.balance(assigned, targets).collect()}
        assert all(abs(shares[k] - v) < 0.04 for k, v in (("train", 0.7), ("test", 0.2), ("validation", 0.1)))
    r = K.checked(assigned, targets).first()
    assert (r.samples, r.groups, r.torn_groups, r.balanced) == (3000, 1702, 0, True)
    assert K.checked(assigned.where("false"), targets).first().samples == 0


def test_shares_of_a_small_table_with_uneven_groups(spark):
    """Groups of 1 to 9 of 2,000 samples: hashes alone miss the targets by more than the tolerance."""
    r = random.Random(9)
    rows, code = [], 0
    while len(rows) < 2000:
        code += 1
        rows += [(len(rows) + k, None, label(f"AA-{code:08d}"), None) for k in range(1, r.choice([1, 1, 2, 5, 10]))]
    s = frame(spark, rows)
    targets = spark.createDataFrame([("train", 0.7), ("test", 0.2), ("validation", 0.1)], "split_name string, target_share double")
    for seed in (1, 2, 3, 4):
        c = K.checked(K.assign(s, targets, seed), targets, tolerance=0.008).first()
        assert (c.samples, c.torn_groups, c.balanced) == (len(rows), 0, True)


def test_group_numbers_of_any_size_beside_small_giants(spark):
    """A large group named by a small number, and a code that is no int."""
    codes = [None] * 40 + ["ZZ-99999999"]
    s = frame(spark, [(i, 1 if 1 < i < 21 else None, label(c), None) for i, c in enumerate(codes, 1)])
    targets = spark.createDataFrame([("train", 0.7), ("test", 0.3)], "split_name string, target_share double")
    got = K.assign(s, targets).collect()
    assert len(got) == 41 and len({x.split for x in got if x.group_id == 1}) == 1 and min(x.group_id for x in got) < -(1 << 31)
