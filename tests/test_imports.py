import hashlib
import json

import pytest

from sedimento.sources import imports as I


def test_scan_and_missing_files(spark, tmp_path):
    (tmp_path / "a.TXT").write_bytes(b"hello")
    (tmp_path / "empty.bin").write_bytes(b"")
    (tmp_path / "large.bin").write_bytes(b"x" * (I.CHUNK + 3))
    found, errors = I.scan_samples(spark, [str(tmp_path / n) for n in ("a.TXT", "empty.bin", "large.bin", "none.txt", "a.TXT")] + [str(tmp_path)])
    rows = {r.name: r for r in found.collect()}
    assert set(rows) == {"a.TXT", "empty.bin", "large.bin"} and rows["a.TXT"].extension == ".txt" and rows["empty.bin"].size_bytes == 0
    assert rows["large.bin"].sha256 == hashlib.sha256(b"x" * (I.CHUNK + 3)).hexdigest() and rows["a.TXT"].status == "raw"
    assert {(r.path, r.reason) for r in errors.collect()} == {(str(tmp_path / "none.txt"), "missing_file"), (str(tmp_path), "missing_file")}
    assert I.read_files(spark.createDataFrame([], "path string, note int")).collect() == []


def test_formats(spark):
    names = lambda *n: spark.createDataFrame([(x,) for x in n], "relative_path string")
    assert I.import_format(names("a/x.png")) == "folder_tree" and I.import_format(names("labels.txt", "a/x.png")) == "path_label_file"
    assert I.import_format(names("dataset_manifest.json", "labels.txt")) == "manifest" and I.import_format(names("sub/labels.txt")) == "folder_tree"
    assert I.import_format(names("a"), is_file=True) == "single_file" and I.import_format(names("a"), label_file=True) == "path_label_file"


def test_folder_labels_and_records(spark):
    x = spark.createDataFrame([("a/b/x.png",), ("top.png",), ("dataset_manifest.json",), ("a/labels.txt",), (None,)], "relative_path string")
    got = {r.relative_path: json.loads(r.labels_json) for r in I.folder_labels(x).collect()}
    assert got == {"a/b/x.png": [{"type": "classification", "class_name": "a", "source": "folder_name"}], "a/labels.txt": [{"type": "classification", "class_name": "a", "source": "folder_name"}], "top.png": []}
    tree = {r.relative_path: (r.class_name, r.class_path) for r in I.folder_tree(x, "root").where("relative_path is not null").collect()}
    assert tree == {"a/b/x.png": ("b", "a/b"), "top.png": ("root", ""), "dataset_manifest.json": ("root", "")}
    one = I.file_record(spark.createDataFrame([("/d/cat/1.png",), ("x.tar.gz",)], "path string")).collect()
    assert [r.class_name for r in one] == ["cat", "x.tar"] and json.loads(one[0].labels_json)[0]["split"] == "train"


def test_manifests(spark):
    entry = {"path": "/a.png", "labels": "one", "split": "test"}
    texts = [("s", json.dumps({"samples": {"0": entry, "1": {"path": "b.png", "labels": ["x", "y"]}, "2": {"path": "gone.png"}}})), ("t", json.dumps({"samples": [entry]})), ("u", "{broken"), ("v", json.dumps({"samples": []})), ("w", None)]
    listed = spark.createDataFrame([("s", "a.png"), ("s", "b.png"), ("t", "a.png"), ("t", "a.png")], "source string, relative_path string")
    got = {(r.source, r.relative_path): (r.class_name, r.split, r.role) for r in I.manifest_import(spark.createDataFrame(texts, "source string, text string"), listed).collect()}
    assert got == {("s", "a.png"): ("one", "test", "test"), ("s", "b.png"): ("x", "train", "train"), ("t", "a.png"): ("one", "test", "train")}


def test_projects(spark):
    rows = [("big", "train", "/p/data/big/train_abs.txt", 1, "img/big/1.jpg 0"), ("big", "train", "/p/data/big/train_abs.txt", 2, "/abs/tire/2.jpg 1"), ("big", "train", "/p/data/big/train_abs.txt", 3, "img/big/1.jpg not-a-number"), ("big", "test", "/p/data/big/kfold_val.txt", 1, "img/big/1.jpg 0"), ("big", "train", "/p/data/big/train_abs.txt", 4, "gone.jpg 0")]
    rows += [("alone", "train", "/p/data/alone/train_abs.txt", k, f"x/{k}.jpg 3") for k in range(1, 6)]
    listed = spark.createDataFrame([("/p/data/big/img/big/1.jpg",), ("/p/img/big/1.jpg",), ("/abs/tire/2.jpg",), *((f"/p/code/x/{k}.jpg",) for k in range(1, 6))], "path string")
    records = I.project_records(spark.createDataFrame(rows, "dataset string, list string, file string, line_number int, value string"), listed)
    assert {(r.dataset, r.path, r.split, r.class_name) for r in records.where("dataset = 'big'").collect()} == {("big", "/p/data/big/img/big/1.jpg", "train", "big"), ("big", "/p/data/big/img/big/1.jpg", "test", "big"), ("big", "/abs/tire/2.jpg", "train", "tire")}
    assert sorted(r.split for r in records.where("dataset = 'alone'").collect()) == ["test"] + ["train"] * 4
    sets = {r.dataset: r for r in I.labeled_datasets(records).collect()}
    assert (sets["big"].samples, sets["big"].class_map, sets["big"].class_distribution) == (2, "0:big,1:tire", "big:1,tire:1") and sets["alone"].class_distribution == "x:5"


def test_training_parameters():
    assert I.training_parameters("p.json", '{"lr": 0.1, "other": 1}') == {"lr": 0.1} and "note" in I.training_parameters("p.yaml", "lr: 1")
    for bad in ("[1]", "{"):
        with pytest.raises(ValueError):
            I.training_parameters("p.json", bad)
