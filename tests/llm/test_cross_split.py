import random

from sedimento.llm import cross_split as X
from sedimento.operators import hamming

SCHEMA = "id long, sha256 string, labels_json string, metadata_json string, split string, hash string, train boolean, key long"


def row(i, split, bits=None, h=None, algo="d"):
    f = f'{{"type":"fingerprint","algo":"{algo}","value":"{bits:036x}"}}' if bits is not None else "{}"
    return (i, h, f'[{f},{{"type":"classification","split":"{split}"}}]' if split else f"[{f}]", None, "x", "y", True, 1)


def test_all_pairs_within_ten_bits_against_brute_force(spark):
    r = random.Random(2)
    base = [r.getrandbits(144) for _ in range(12)]
    rows, where = [], []
    for i in range(1, 200):
        b = base[r.randrange(12)]
        for k in r.sample(range(144), r.randrange(0, 9)):
            b ^= 1 << k
        s = r.choice(["train", "Test ", "dev"])
        where.append((i, s == "train", b, algo := r.choice(["d", "d", "c"])))
        rows.append(row(i, s, b, algo=algo))
    want = {(e, t) for e, te, b, a in where for t, tt, c, z in where if tt and not te and a == z and (b ^ c).bit_count() <= 10}
    got = [(x.evaluation_id, x.train_id) for x in X.overlaps(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert set(got) == want and len(got) == len(want) and len(want) > 50


def test_hashes_dirt_and_report(spark):
    h = "ab" * 32
    rows = [row(1, "train", h=h), row(2, "TEST", h=f"SHA256:{h}"), row(3, None, h=h), row(4, "val", h="0" * 64), row(5, "train", h="0" * 64), row(6, "train", h=None), row(7, "test", h=""), row(2, "TEST", h=h), (8, h, '[{"type":"fingerprint","algo":null,"value":"zz"}]', '{"split":"valid","origin":"Lab"}', "", "", None, None), (None, h, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(x.evaluation_id, x.train_id, x.same_hash, x.near) for x in X.overlaps(df).collect()}
    assert got == {(2, 1, True, False), (8, 1, True, False)}
    assert {(x.split, x.origin, x.pairs) for x in X.overlap_report(df).collect()} >= {("validation", "lab", 1)}
    assert X.overlaps(df.where("false")).collect() == []


def test_bands_for_any_number_of_rows_lose_no_pair(spark, monkeypatch):
    """The bands depend on the number of rows, so the choice for many rows is tried on few."""
    r = random.Random(5)
    base = [r.getrandbits(144) for _ in range(6)]
    values = set()
    for _ in range(120):
        b = r.choice(base)
        for k in r.sample(range(144), r.randrange(0, 10)):
            b ^= 1 << k
        values.add(b)
    rows = [("d", b >> 96, b >> 48 & (1 << 48) - 1, b & (1 << 48) - 1) for b in sorted(values)]
    df = spark.createDataFrame(rows, "algo string, f0 long, f1 long, f2 long")
    want = sum((a ^ b).bit_count() <= 10 for a in values for b in values)
    choose = hamming.bands
    for n in (10, 1_000, 100_000, 2_000_000, 100_000_000):
        monkeypatch.setattr(hamming, "bands", lambda width, max_bits, *_, n=n: choose(width, max_bits, n, n))
        got = [tuple(x) for x in hamming.near_pairs(df, df, 10).collect()]
        assert len(got) == len(set(got)) == want > len(values)
