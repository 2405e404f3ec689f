import json
import random

from pyspark.sql import functions as F

from sedimento.operators import flatten as N


def frame(spark, texts, column="labels_json"):
    return spark.createDataFrame([("t", column, i, t, 1, "x") for i, t in enumerate(texts)], "table_name string, column_name string, record_id long, text string, position int, path string")


def test_reading_rules(spark):
    texts = ['[{"a":1}]', '{"a":1}', json.dumps('[{"a": {"b": [{"c": 1}, 2, {"c": 1}]}}]'), None, "", '[{"a"', "null", '["{\\"x\\": [{}]}", "[1", "y"]', '[[{"z": null}], []]', "3", '"text"']
    got = {(x.record_id, x.path) for x in N.bridge(frame(spark, texts)).where("position is not null").collect()}
    assert got == {(0, "$[0]"), (2, "$[0]"), (2, "$[0].a.b[0]"), (2, "$[0].a.b[2]"), (7, "$[0]"), (7, "$[0].x[0]"), (8, "$[0][0]")}


def test_lone_label_objects(spark):
    rows = frame(spark, ['{"a":[{"b":1}]}'])
    assert {x.path for x in N.bridge(rows).collect()} == {"$", "$.a[0]"}
    assert {x.path for x in N.bridge(rows, lone_label_lists=True).collect()} == {"$[0]", "$[0].a[0]"}


def test_what_is_json():
    assert N.parse("\ufeff[1]") == [1] and N.parse("[NaN]") is None and N.parse("[-Infinity]") is None
    for text in ('{"a":[1,{"b":"x,]"},-2.5e3,true,null,{}],"c":[[],{}]}', " [ ] ", "3", '"s"', "{ }"):
        assert N._deep(text) == json.loads(text)
    for text in ("[1,]", "[,1]", "{,}", '{"a":1,}', '{"a" 1}', '{"a":}', "[1 2]", "]", "[1}", "[] []", "", "[", '{"a":[', "nul", "01"):
        try:
            N._deep(text)
        except ValueError:
            continue
        raise AssertionError(text)
    assert N._canonical({"b": [1, "é"], "a": {"#": "x"}}) == '{"a":{"#":"x"},"b":[1,"é"]}'


def test_flat_tables(spark):
    texts = ['[{"regions":[{"region_id":1,"bbox":[1,2],"path":"p","attributes":[{"name":"n"}]},{"region_id":2}]}]', '[{"regions":"[{\\"region_id\\": 1.5}]"}]', "[3]"]
    b = N.bridge(frame(spark, texts))
    t = N.flat_table(b, "t", "labels_json", "$[].regions[]")
    assert t.columns == ["record_id", "path", "parent_path", "position", "node_id", "bbox", "path_", "region_id"]
    assert {(r.record_id, r.path, r.parent_path, r.position, float(r.region_id), tuple(r.bbox or ()), r.path_) for r in t.collect()} == {
        (0, "$[0].regions[0]", "$[0]", 0, 1.0, (1, 2), "p"), (0, "$[0].regions[1]", "$[0]", 1, 2.0, (), None), (1, "$[0].regions[0]", "$[0]", 0, 1.5, (), None)
    }
    assert N.flat_table(b, "t", "labels_json", "$.none").count() == 0


def test_equal_objects_are_stored_once_and_every_place_kept(spark):
    rows = N.bridge(frame(spark, ['[{"k":[{"v":1,"w":2}]},{"k":[{"w":2,"v":1}]}]', '[{"w":2,"v":1}]']))
    assert rows.count() == 5
    kinds = N.objects(rows).collect()
    assert sorted(x.occurrences for x in kinds) == [2, 3]
    ids = {bytes(x.node_id) for x in rows.collect()}
    assert all(x.parent_id is None or bytes(x.parent_id) in ids for x in rows.collect())


def rebuild(rows):
    """The value back from bridge rows: bodies with inner objects put in their place."""
    bodies = {bytes(r.node_id): r.body for r in rows}

    def value(v):
        if isinstance(v, dict) and set(v) == {"#"}:
            return {k: value(x) for k, x in json.loads(bodies[bytes.fromhex(v["#"])]).items()}
        return [value(x) for x in v] if isinstance(v, list) else v

    return {r.record_id: value({"#": bytes(r.node_id).hex()}) for r in rows if r.path == "$"}


def test_round_trip(spark):
    r = random.Random(4)

    def make(d):
        k = r.randrange(6 if d else 3)
        return [{}, [], None][k] if k < 3 and d else {f"k{i}": make(d - 1) for i in range(3)} if k in (0, 3) and d else [make(d - 1) for _ in range(2)] if d else r.choice([1, 2.5, True, "s", "é\n"])

    values = [{"a": make(4), "b": make(3)} for _ in range(60)]
    rows = N.bridge(frame(spark, [json.dumps(v) for v in values], "result_json")).collect()
    assert rebuild(rows) == dict(enumerate(values))


def test_long_and_deep_and_empty(spark):
    deep = '[{"a":' + "[" * 30_000 + "]" * 30_000 + "}]"
    long = json.dumps([{"i": i} for i in range(30_000)])
    out = N.bridge(frame(spark, [deep, long, "[" * 100_000])).groupBy("record_id").agg(F.count("*").alias("n")).collect()
    assert {x.record_id: x.n for x in out} == {0: 1, 1: 30_000}
    assert N.bridge(frame(spark, ["{}"]).where("false")).count() == 0


def test_objects_deeper_than_the_interpreter_recurses(spark):
    depth = 10_000
    deep = '{"a":' * depth + "1" + "}" * depth
    rows = N.bridge(frame(spark, [deep, '{"z":[{"b":2},' + deep + "]}"], "result_json")).select("record_id", "node_id", "parent_id", "depth").collect()
    assert sorted(r.depth for r in rows if r.record_id == 0) == list(range(depth)) and sum(r.record_id for r in rows) == depth + 2
    ids = {bytes(r.node_id) for r in rows}
    assert all(bytes(r.parent_id) in ids if r.depth else r.parent_id is None for r in rows)
