from sedimento.functions import reading as R
from pyspark.sql import functions as F


def col(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, c string")


def test_hashes(spark):
    h = "ab" * 32
    x = col(spark, [h, h.upper(), f" sha256:{h}\n", f"SHA256:{h.upper()}", "0" * 64, " ", None, "xyz", h[:-1], f"sha-256={h}"])
    got = [r[0] for r in x.orderBy("i").select(F.lower(F.hex(R.content_hash(F.col("c"))))).collect()]
    assert got == [h, h, h, h, None, None, None, None, None, h]


def test_filled(spark):
    x = col(spark, [None, "", " ", "N/A", "Unknown ", "-", "[]", "{}", "[ ]", "0", "false", "x", "[1]"])
    assert [r[0] for r in x.orderBy("i").select(R.filled(F.col("c"))).collect()] == [False] * 9 + [True] * 4


def test_labels_and_split(spark):
    x = spark.createDataFrame(
        [(0, '{"type":"classification","split":"dev"}', None), (1, '[{"split":null},{"split":" TEST"}]', '{"split":"train"}'), (2, '[{"split":"n/a"}]', '"{\\"split\\": \\"trn\\"}"'), (3, "[{", '{"split"'), (4, None, "[]"), (5, "null", '{"split":["x"]}')],
        "i int, l string, m string",
    )
    got = [r[0] for r in x.orderBy("i").select(R.recorded_split(R.labels(F.col("l")), R.fields(F.col("m")))).collect()]
    assert got == ["validation", "test", "train", None, None, None]


def test_object_codes(spark):
    paths = ["anchor/AN-00000001", "x\\\\an 00000001\\\\", "/s//an00000001", "a/b/AN_00000001/", "anchor/batch_12", "anchor", "", "AN-0000001", "AN000000012"]
    x = col(spark, [f'[{{"type":"classification","class_path":"{p}"}}]' for p in paths])
    got = [r[0] for r in x.orderBy("i").select(R.object_codes(R.labels(F.col("c")))).collect()]
    assert all(len(g) == 1 and g[0] < 0 for g in got[:4]) and len({g[0] for g in got[:4]}) == 1
    assert all(g == [] for g in got[4:])
