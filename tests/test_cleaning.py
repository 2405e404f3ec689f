import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from sedimento.operators import cleaning, evaluate, generate, hamming, ranking, splits
from sedimento.plans import cleaning_plan
from sedimento.registry import default_registry
from sedimento.sources import files

H = ["ab" * 32, "cd" * 32]


def test_exact_duplicates(spark):
    s = spark.createDataFrame([(3, H[0]), (1, H[0].upper()), (2, H[1]), (4, None), (5, ""), (6, "0" * 64), (7, "0" * 64), (3, H[0])], "id long, sha256 string")
    assert [(r.sample_id, r.related_id, r.confidence) for r in cleaning.exact_duplicates(s).collect()] == [(3, 1, 1.0)]
    assert cleaning.exact_duplicates(s.where("false")).collect() == []


def greedy(prints, most):
    leaders, out = [], {}
    for i, b in sorted(prints):
        near = [((b ^ c).bit_count(), j) for j, c in leaders if (b ^ c).bit_count() <= most]
        if near:
            out[i] = min(near)[::-1]
        else:
            leaders.append((i, b))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_leaders_equal_the_greedy_loop(spark, seed):
    r = random.Random(seed)
    prints, b = [], r.getrandbits(144)
    for i in range(1, 90):
        for k in r.sample(range(144), r.randrange(0, 7)):
            b ^= 1 << k
        if r.random() < 0.1:
            b = r.getrandbits(144)
        prints.append((i, b))
    m = (1 << 48) - 1
    df = spark.createDataFrame([(i, "d", b >> 96, b >> 48 & m, b & m) for i, b in prints], "id long, algo string, f0 long, f1 long, f2 long")
    assert {x.id: (x.leader_id, x.bits) for x in cleaning.leaders(df, 8).collect()} == greedy(prints, 8)


@pytest.mark.parametrize("rows", [300_000, 100_000_000])
def test_leaders_in_the_buckets_of_many_rows(spark, monkeypatch, rows):
    """Up to about 300,000 fingerprints there were bands without turned values only."""
    choose = hamming.bands
    monkeypatch.setattr(hamming, "bands", lambda width, most, *_: choose(width, most, rows, rows))
    test_leaders_equal_the_greedy_loop(spark, 1)


def test_near_values_share_a_bucket():
    r = random.Random(4)
    for width, most, rows in ((144, 10, 10), (144, 10, 10**6), (144, 10, 10**8), (64, 6, 10**6), (28, 3, 10**5), (256, 40, 10**6), (64, 0, 10**6)):
        buckets = [set(x) for x in hamming.bands(width, most, rows, rows)]
        assert len(buckets) <= 64 and all(any(not x & d for x in buckets) for d in (set(r.sample(range(width), most)) for _ in range(500)))


@pytest.mark.parametrize(("width", "most"), [(64, 6), (64, 20), (28, 0), (256, 40)])
def test_leaders_of_any_width_and_threshold(spark, width, most):
    r = random.Random(width + most)
    base = [r.getrandbits(width) for _ in range(4)]
    prints = [(i, base[r.randrange(4)] ^ sum(1 << k for k in r.sample(range(width), r.randrange(min(width, most + 3))))) for i in range(1, 60)]
    prints = [(i, b) for i, b in prints if b not in {c for j, c in prints if j < i}]
    rows = [(i, f'[{{"type":"fingerprint","algo":"d","value":"{b:0{width // 4}x}"}}]') for i, b in prints]
    got = cleaning.near_duplicates(spark.createDataFrame(rows, "id long, labels_json string"), most, 0.0)
    want = {i: (j, round(1 - d / width, 4)) for i, (j, d) in greedy(prints, most).items()}
    assert {x.sample_id: (x.related_id, x.confidence) for x in got.collect()} == want and (want or not most)


def test_images_are_near_duplicates_by_their_hashes(spark):
    r = random.Random(5)
    one, other = (bytes(r.randrange(256) for _ in range(400)) for _ in range(2))
    images = [(i, b"P5 20 20 255\n" + x) for i, x in ((1, one), (2, other), (3, one[:-1] + bytes([one[-1] ^ 64])), (4, other))]
    df = spark.createDataFrame(images, "id long, content binary")
    for size in (5, 8, 16):
        got = default_registry().run("image_near_duplicate_detector", df, hamming_threshold=6, hash_size=size)
        assert {(x.sample_id, x.related_id) for x in got.collect()} == {(3, 1), (4, 2)}


def test_average_hashes(spark, tmp_path, monkeypatch):
    near = [[1.0] * 64, [1.0] * 63 + [-1.0], [1.0] * 64, [1.0] * 62 + [-1.0, 1.0]]
    spark.createDataFrame(list(enumerate(near)), "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    assert {(r.first, r.copies) for r in cleaning_plan.ahash_exact(spark, str(tmp_path)).collect()} == {(0, 1), (1, 0), (3, 0)}
    hashes = [(1, "0" * 16), (2, "00000000000000ff"), (3, "000000000000003f"), (4, "000000000000000f"), (5, "0" * 16)]
    monkeypatch.setattr(cleaning.pixels, "image_hashes", lambda f: spark.createDataFrame(hashes, "id long, ahash string"))
    for most, want in ((0, {(5, 1, 0)}), (6, {(3, 1, 6), (4, 1, 4), (5, 1, 0)}), (16, {(2, 1, 8), (3, 1, 6), (4, 1, 4), (5, 1, 0)})):
        assert {tuple(r) for r in cleaning.average_hash_duplicates(None, most).collect()} == want


def test_store_and_monitor(spark):
    s = spark.createDataFrame([(1, "keep", "raw"), (2, "drop", "raw"), (3, "repair", "raw"), (4, "gone", "deleted"), (9, "fixed", "cleaned")], "id long, name string, status string")
    g = spark.createDataFrame(
        [(1, 2, "duplicate", "delete", "pending", 0.95, None), (2, 3, "text", "repair", "approved", 0.9, 9), (3, 3, "text", "repair", "approved", 0.95, 777), (4, 1, "x", "delete", "rejected", 1.0, None), (5, None, "x", "delete", "applied", None, None)],
        "id long, sample_id long, issue_type string, suggested_action string, status string, confidence double, output_sample_id long",
    )
    assert {(r.sample_id, r.stored_from) for r in cleaning.store_cleaned(s, g).collect()} == {(1, 1), (3, 3), (9, 9)}
    assert {(r.sample_id, r.stored_from) for r in cleaning.store_cleaned(s, g.where("id <> 3")).collect()} == {(1, 1), (3, 9), (9, 9)}
    m = {r.sample_id: (r.suggestion_id, r.operation, r.confidence) for r in cleaning.monitor(s, g).collect()}
    assert m[9] == (-1, "keep", 1.0) and m[2] == (1, "delete", 0.95) and m[3] == (3, "repair", 0.95)
    assert cleaning.monitor(s, g, completed=False).where("sample_id = 9").first().operation == "pending"
    d = spark.createDataFrame([(1, "applied"), (2, "approved"), (4, "applied")], "id long, decision string")
    assert {(r.id, r.status, r.accepted) for r in cleaning.review(g, d).where("accepted is not null").collect()} == {(1, "applied", True), (2, "approved", False), (4, "rejected", False)}
    applied = cleaning.apply_suggestions(s, g.withColumn("status", F.lit("applied")))
    assert {(r.id, r.status) for r in applied.collect()} == {(1, "deleted"), (2, "deleted"), (3, "cleaned"), (4, "deleted"), (9, "cleaned")}


def test_numbered_spans_partitions(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("g"), F.col("id").alias("v"))
    rows = ranking.numbered(df, ["g"], [F.col("v").desc()]).collect()
    for g in range(3):
        part = sorted((r for r in rows if r.g == g), key=lambda r: -r.v)
        assert [r.rn for r in part] == list(range(1, len(part) + 1)) and {r.n for r in part} == {len(part)}


def test_splits(spark):
    df = spark.createDataFrame([(f"{c}/{i}", c) for c in ("alpha", "beta") for i in range(5)], "path string, c string").withColumn("g", F.lit(1))
    got = splits.stable_split(df, ["g"], [F.col("c"), F.col("path")]).groupBy("split").count().collect()
    assert {r.split: r["count"] for r in got} == {"train": 8, "test": 2}
    recs = spark.createDataFrame([("p", 1, "train"), ("p", 2, "test"), ("p", 3, "test"), ("q", 1, "train"), ("q", 2, None)], "path string, ord long, split string")
    assert {(r.path, r.ord) for r in splits.prefer_test(recs).collect()} == {("p", 3), ("q", 1)}
    lines = spark.createDataFrame([("f", 1, " a/tire/x.jpg 7 "), ("f", 2, "x.jpg not-a-number"), ("f", 3, "# c"), ("f", 4, ""), ("f", 5, "y.txt 3"), ("f", 6, "solo.png"), ("f", 7, None), ("f", 8, "z.PNG\t2 x")], "file string, line_number long, value string")
    assert {(r.line_number, r.class_id, r.class_name) for r in splits.label_lines(lines).collect()} == {(1, 7, "tire"), (8, 2, "")}


def test_manifest_split_reads_every_record_and_the_metadata(spark, tmp_path):
    rows = [
        (1, 7, '[{"type":"fingerprint"},{"split":" TST "}]', None), (2, 7, '[{"split":"n/a"},{"split":"testing"}]', '{"split":"train"}'), (3, 7, "[]", '{"split":"test"}'),
        (4, 7, '[{"split":"train"},{"split":"test"}]', '{"split":"test"}'), (5, 7, None, None), (6, 8, None, '{"split":"test"}'),
    ]
    spark.createDataFrame(rows, "id long, dataset_id long, labels_json string, metadata_json string").write.parquet(str(tmp_path / "samples.parquet"))
    got = {r.id: r.role for r in cleaning_plan.manifest_split(spark, str(tmp_path)).collect()}
    assert got == {1: "test", 2: "test", 3: "test", 4: "train", 5: "train", 6: "train"}


def test_generation(spark):
    s = spark.createDataFrame([(5, "a.txt", "x y"), (3, "b.txt", None)], "id long, name string, text string")
    assert [(r.i, r.source_sample_id, r.name) for r in generate.copies(s, 3).orderBy("i").collect()] == [(0, 3, "b_copy_0000.txt"), (1, 5, "a_copy_0001.txt"), (2, 3, "b_copy_0002.txt")]
    with pytest.raises(generate.InsufficientOutputs):
        generate.complete(generate.copies(s, 3), 4)
    lab = spark.createDataFrame([(1, 3, None), (2, 3, "[]"), (4, 3, '[{"a":1}]'), (6, 99, None)], "id long, source_sample_id long, labels_json string")
    src = spark.createDataFrame([(3, '[{"class_id":3}]')], "id long, labels_json string")
    assert {(r.id, r.labels_json, r.labels_inherited) for r in generate.inherit_labels(lab, src).collect()} == {(1, '[{"class_id":3}]', True), (2, '[{"class_id":3}]', True), (4, '[{"a":1}]', False), (6, None, False)}
    for op in generate.TEXT_OPERATORS:
        a, b = (sorted((r.i, r.text) for r in generate.augment_text(s.repartition(n), 4, op, seed=1).collect()) for n in (1, 3))
        assert a == b and len(a) == 4


def test_collisions_and_files(spark, tmp_path):
    f = spark.createDataFrame([("d", 1, "x.txt"), ("d", 2, "x.txt"), ("d", 3, "x_1.txt"), ("d", 4, "x.txt"), ("e", 5, "x.txt")], "folder string, ord long, name string")
    got = {r.ord: r.stored_name for r in files.collision_names(f).collect()}
    assert len({(("e" if k == 5 else "d"), v) for k, v in got.items()}) == 5 and got[1] == "x.txt" and got[3] == "x_1.txt" and got[5] == "x.txt"
    (tmp_path / "part-a").mkdir()
    (tmp_path / "part-a" / "s.txt").write_text("hello")
    (tmp_path / "dataset_manifest.json").write_text("skip")
    (tmp_path / "top.png").write_bytes(b"x")
    rows = {r.relative_path: r for r in files.scan_folder(spark, str(tmp_path)).collect()}
    assert set(rows) == {"part-a/s.txt", "top.png"} and rows["part-a/s.txt"].class_name == "part-a" and rows["top.png"].class_name is None
    assert rows["part-a/s.txt"].sha256 == "2cf24dba5fb0a30e26e83b2ac5b9e29e1b161e5c1fa7425e73043362938b9824"
    assert [r.name for r in files.scan_folder(spark, str(tmp_path), recursive=False).collect()] == ["top.png"]


def test_tables_of_files(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, name string")
    for kind in ("csv", "json"):
        files.write_table(df, str(tmp_path / f"t.{kind}"), kind)
        assert sorted((r.id, r.name) for r in files.read_table(spark, str(tmp_path / f"t.{kind}")).select("id", "name").collect()) == [(1, "a"), (2, None)]
    (tmp_path / "bad.json").write_text("{broken")
    assert files.read_table(spark, str(tmp_path / "bad.json")) is None and files.read_table(spark, str(tmp_path / "t.xlsx")) is None
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        files.read_table(spark, str(tmp_path / "none.csv"))
    raw = spark.createDataFrame([(bytearray("é".encode()),), (bytearray("é".encode("latin-1")),), (None,)], "b binary")
    assert [r[0] for r in raw.select(files.decode_text(F.col("b"))).collect()] == ["é", "é", None]


def test_streams(spark, tmp_path):
    from sedimento.streaming import arrivals

    s = spark.createDataFrame([(1, H[0], "image", datetime(2024, 1, 1)), (2, H[0], "image", datetime(2024, 1, 2))], "id long, sha256 string, modality string, created_at timestamp")
    s.write.parquet(str(tmp_path / "in"))
    stream = arrivals.read_stream(spark, str(tmp_path / "in"), s)
    arrivals.suggest_on_arrival(stream, str(tmp_path / "out"), cleaning.exact_duplicates, f"t{tmp_path.name}").awaitTermination()
    assert [r.sample_id for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [2]


def test_there_are_no_bounds(spark):
    many = spark.range(100_003).select("id", F.col("id").alias("label"))
    assert evaluate.openset_labels(many, many, 5).count() == 100_003
    report = evaluate.comparison_report(spark.range(1001).selectExpr("string(id) as metric", "1d as baseline", "2d as enhanced", "100d as improvement"))
    assert len(report.splitlines()) == 1002 and report.endswith("+100.00 %: clearly better")
