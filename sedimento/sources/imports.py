"""Imports: from files, folders, manifests and label lists to labelled sample records.

Files are read where they are, by the executors, in pieces of CHUNK bytes: sizes, hashes and whether a file exists come
from one distributed pass over paths, and a file of any size is hashed. What an import then makes of paths, labels and
splits are plans over such listings.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimento.functions import reading
from sedimento.operators import splits
from sedimento.sources.files import IMAGE_EXT, extension, mime

CHUNK = 8 << 20
# The files that list samples, in the order in which they are looked for, and files that are no samples.
LISTS = ("train_abs.txt", "kfold_train.txt", "labels.txt", "annotations.txt")
NO_SAMPLES = ("train_abs.txt", "kfold_train.txt", "kfold_val.txt", "labels.txt", "annotations.txt", "annotations.json", "params.json")
MANIFEST = "dataset_manifest.json"
TRAINING_PARAMETERS = ("dataset", "backbone", "bs", "lr", "es", "train_class_num", "test_class_num", "p_value", "k_value", "resume", "method_name", "alpha", "gamma")


def read_files(paths: DataFrame) -> DataFrame:
    """paths (path, ...) with size_bytes and sha256, both null where there is no such file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for b in batches:
            sizes, hashes = [], []
            for path in b.column(b.schema.get_field_index("path")).to_pylist():
                size = digest = None
                try:
                    store, place = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
                    with store.open_input_stream(place) as f:
                        h, size = sha256(), 0
                        while part := f.read(CHUNK):
                            h.update(part)
                            size += len(part)
                    digest = h.hexdigest()
                except (OSError, pa.ArrowInvalid):
                    size = None
                sizes.append(size)
                hashes.append(digest)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sizes, pa.int64()), pa.array(hashes, pa.string())], [*b.schema.names, "size_bytes", "sha256"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in paths.schema.fields)
    return paths.where("path is not null").mapInArrow(run, f"{schema}, size_bytes bigint, sha256 string")


def as_samples(listed: DataFrame) -> DataFrame:
    """name, relative_path, file_path, extension, mime_type, size_bytes, sha256, status of files (path, relative_path, size_bytes, sha256)."""
    name = F.element_at(F.split("relative_path", "/"), -1)
    return listed.select(name.alias("name"), "relative_path", F.col("path").alias("file_path"), extension(name).alias("extension"), mime(name).alias("mime_type"), "size_bytes", "sha256", F.lit("raw").alias("status"))


def scan_samples(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """(samples, errors (path, reason)) of a list of files, each path once; a file's relative path is its name."""
    x = spark.createDataFrame([(p,) for p in dict.fromkeys(paths)], "path string").withColumn("relative_path", F.element_at(F.split("path", "/"), -1))
    x = read_files(x.repartition(max(1, min(len(paths), 10_000))))
    return as_samples(x.where("sha256 is not null")), x.where("sha256 is null").select("path", F.lit("missing_file").alias("reason"))


def import_format(names: DataFrame, is_file: bool = False, label_file: bool = False) -> str:
    """How a place is imported: `single_file`, `manifest`, `path_label_file` or `folder_tree`. names: relative_path of what is there."""
    if is_file:
        return "single_file"
    if label_file:
        return "path_label_file"
    there = {r[0] for r in names.where(F.col("relative_path").isin(MANIFEST, *LISTS)).select("relative_path").distinct().collect()}
    return "manifest" if MANIFEST in there else "path_label_file" if there else "folder_tree"


def label_records(class_name: Column, source: Column | str, split: Column | None = None) -> Column:
    """The label list of one class: empty without a class."""
    parts = [F.lit("classification").alias("type"), class_name.alias("class_name"), (F.lit(source) if isinstance(source, str) else source).alias("source")]
    if split is not None:
        parts.insert(2, class_name.alias("class_path"))
        parts.append(split.alias("split"))
    return F.when(class_name.isNull(), F.lit("[]")).otherwise(F.to_json(F.array(F.struct(*parts))))


def file_record(files: DataFrame, split: str = "train") -> DataFrame:
    """files (path) with the one label of a single file: the folder it is in, else its name without extension."""
    p = F.split("path", "/")
    folder = F.when(F.size(p) > 1, F.get(p, F.size(p) - 2))
    name = F.coalesce(F.nullif(folder, F.lit("")), F.regexp_replace(F.element_at(p, -1), r"(?<=.)\.[^.]*$", ""))
    return files.withColumn("class_name", name).withColumn("labels_json", label_records(name, "file", F.lit(split)))


def folder_labels(listed: DataFrame, stated: DataFrame | None = None) -> DataFrame:
    """listed (relative_path, ...) but the manifest, with labels_json: stated by path (relative_path, labels_json), else the first folder's name."""
    x = listed.where(F.element_at(F.split("relative_path", "/"), -1) != MANIFEST)
    inferred = label_records(splits.folder_label(F.col("relative_path")), "folder_name")
    if stated is None:
        return x.withColumn("labels_json", inferred)
    s = stated.groupBy("relative_path").agg(F.max("labels_json").alias("stated__"))
    return x.join(s, "relative_path", "left").withColumn("labels_json", F.coalesce("stated__", inferred)).drop("stated__")


def folder_tree(listed: DataFrame, root_name: str, split: str = "train", by: list[str] | None = None) -> DataFrame:
    """listed (relative_path, ...) with class_name, class_path, split: classes are the folders that files stand in.

    Files that list or describe samples are none. A train tree is split 8 : 2 by class and path, `by` column or as a whole.
    """
    x = listed.where(~F.element_at(F.split("relative_path", "/"), -1).isin(*NO_SAMPLES))
    folder = F.regexp_extract("relative_path", r"^(.*)/[^/]*$", 1)
    x = x.withColumn("class_path", folder).withColumn("class_name", F.when(folder == "", root_name).otherwise(F.element_at(F.split(folder, "/"), -1)))
    if split != "train":
        return x.withColumn("split", F.lit(split))
    return splits.stable_split(x, by or [], [F.col("class_name"), F.col("relative_path")])


def manifest_entries(manifests: DataFrame) -> DataFrame:
    """source, relative_path, class_name, labels_json, split of every entry of manifests (source, text).

    `samples` is an object of entries or a list of them; an entry's `labels` is a list or one label; split defaults to train.
    """
    entry = "struct<path:string,labels:string,split:string>"
    j = F.get_json_object("text", "$.samples")
    x = manifests.select("source", F.explode(F.when(j.rlike(r"^\s*\["), F.from_json(j, f"array<{entry}>")).otherwise(F.map_values(F.from_json(j, f"map<string,{entry}>")))).alias("e"))
    said = F.col("e.labels")
    labels = F.when(said.rlike(r"^\s*\["), F.from_json(said, "array<string>")).when(said != "", F.array(said))
    labels = F.coalesce(labels, F.array().cast("array<string>"))
    made = F.to_json(F.transform(labels, lambda c: F.struct(F.lit("classification").alias("type"), c.alias("class_name"), F.lit("manifest").alias("source"))))
    return x.select("source", F.regexp_replace("e.path", r"^[/\\]+", "").alias("relative_path"), F.coalesce(F.get(labels, F.lit(0)), F.lit("")).alias("class_name"), made.alias("labels_json"), F.coalesce("e.split", F.lit("train")).alias("split"))


def manifest_import(manifests: DataFrame, listed: DataFrame) -> DataFrame:
    """manifest_entries whose file is among listed (source, relative_path), with role train or test.

    Entries without a file are left out; a source that has only test entries is a train set.
    """
    x = manifest_entries(manifests).join(listed.select("source", "relative_path").distinct(), ["source", "relative_path"], "left_semi")
    return splits.manifest_roles(x.withColumnRenamed("source", "dataset_id")).withColumnRenamed("dataset_id", "source")


def labeled_datasets(records: DataFrame) -> DataFrame:
    """dataset, samples, class_map, class_distribution of labelled records (dataset, path, ord, split, class_id, class_name).

    Every dataset of a project at once. A path counts once, its last test record before its first other one. class_map
    names the class of each id (the greatest name of equals), class_distribution counts records by class name; both are
    strings `key:value` joined by commas in order of the key.
    """
    once = splits.prefer_test(records.withColumn("path", F.to_json(F.struct("dataset", "path"))).select("path", "dataset", "ord", "split", "class_id", "class_name"))
    joined = lambda k, v: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(k, v))), lambda x: F.concat_ws(":", x[k].cast("string"), x[v].cast("string"))), ",")
    ids = once.groupBy("dataset", "class_id").agg(F.max("class_name").alias("name")).groupBy("dataset").agg(joined("class_id", "name").alias("class_map"))
    names = once.groupBy("dataset", "class_name").agg(F.count("*").alias("n")).groupBy("dataset").agg(joined("class_name", "n").alias("class_distribution"), F.sum("n").alias("samples"))
    return names.join(ids, "dataset").select("dataset", "samples", "class_map", "class_distribution")


def project_records(lines: DataFrame, listed: DataFrame) -> DataFrame:
    """dataset, path, ord, split, class_id, class_name of a project: label lines (dataset, list, file, line_number, value).

    list is `train` or `test`. Paths are looked for among listed (path) beside the label file, in the project, its `code`
    and its `data` folder, in this order (a file is root/data/<dataset>/<name>). Lines that name no image there are left
    out. Datasets without a test list are split 8 : 2 by class and path.
    """
    parsed = splits.label_lines(lines.select(F.to_json(F.struct("dataset", "list", "file")).alias("file"), "line_number", "value"))
    about = F.from_json("file", "dataset string, list string, file string")
    x = parsed.select(about.alias("a"), "line_number", "path", "class_id").select("a.dataset", "a.list", "a.file", "line_number", "path", "class_id")
    folder = F.regexp_extract("file", r"^(.*)/[^/]*$", 1)
    root = F.regexp_extract("file", r"^(.*)/data/[^/]*/[^/]*$", 1)
    places = F.when(F.col("path").startswith("/"), F.array("path")).otherwise(F.array(*[F.concat_ws("/", p, F.col("path")) for p in (folder, root, F.concat(root, F.lit("/code")), F.concat(root, F.lit("/data")))]))
    x = x.withColumn("ord", F.struct((F.col("list") == "test").alias("late"), F.col("line_number"))).select("*", F.posexplode(places).alias("place", "found"))
    there = listed.select(F.col("path").alias("found")).distinct()
    x = x.join(there, "found", "left_semi").groupBy("dataset", "list", "file", "line_number", "path", "class_id").agg(F.min_by("found", "place").alias("found"))
    x = x.select("dataset", F.col("found").alias("path"), (F.col("line_number") + F.when(F.col("list") == "test", 1 << 40).otherwise(0)).alias("ord"), F.col("list").alias("split"), "class_id", F.element_at(F.split("found", "/"), -2).alias("class_name"))
    tested = x.where("split = 'test'").select("dataset").distinct()
    alone = x.join(tested, "dataset", "left_anti").drop("split")
    return x.join(tested, "dataset", "left_semi").unionByName(splits.stable_split(alone, ["dataset"], [F.col("class_name"), F.col("path"), F.col("ord")]).select(*x.columns))


def training_parameters(name: str, text: str) -> dict:
    """The known parameters of a JSON object; other files than JSON are only named."""
    if not name.lower().endswith(".json"):
        return {"parameter_file": name, "note": "Only JSON parameters are parsed automatically."}
    try:
        data = json.loads(text)
    except ValueError as e:
        raise ValueError(f"training parameters are not valid JSON: {e}") from e
    if not isinstance(data, dict):
        raise ValueError("training parameters must be a JSON object")
    return {k: data[k] for k in TRAINING_PARAMETERS if k in data}


def labelled_images(samples: DataFrame) -> DataFrame:
    """path, label of samples (file_path, labels_json) that are images with a label: what a trainer reads.

    The label is the first label's class_name, else name, else label.
    """
    first = F.get(reading.labels(F.col("labels_json")), F.lit(0))
    pick = F.coalesce(*[F.nullif(first[k], F.lit("")) for k in ("class_name", "name", "label")])
    return samples.where(F.coalesce(F.col("file_path"), F.lit("")) != "").where(extension(F.col("file_path")).isin(*IMAGE_EXT)).select(F.col("file_path").alias("path"), pick.alias("label")).where("label is not null")
