"""File sources: folders of files as sample rows, names, types, tables and texts.

Contents stay in the executors: hashes and sizes are computed where a file is read, and listings read no contents.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Mime types by extension.
MIME = {
    ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".png": "image/png", ".bmp": "image/bmp", ".gif": "image/gif", ".webp": "image/webp", ".tif": "image/tiff", ".tiff": "image/tiff",
    ".wav": "audio/x-wav", ".mp3": "audio/mpeg", ".aac": "audio/aac", ".flac": "audio/flac", ".ogg": "audio/ogg", ".m4a": "audio/mp4",
    ".txt": "text/plain", ".csv": "text/csv", ".json": "application/json", ".md": "text/markdown", ".log": "text/plain", ".yaml": "application/yaml", ".yml": "application/yaml", ".xml": "text/xml", ".html": "text/html", ".css": "text/css", ".py": "text/x-python", ".js": "text/javascript",
    ".mp4": "video/mp4", ".avi": "video/x-msvideo", ".mov": "video/quicktime", ".zip": "application/zip",
}
IMAGE_EXT = (".jpg", ".jpeg", ".png", ".bmp", ".gif", ".webp", ".tif", ".tiff")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def mime(path: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in MIME.items() for x in kv])
    return F.coalesce(known[extension(path)], F.lit("application/octet-stream"))


def _plain(path: Column) -> Column:
    return F.regexp_replace(path, "^file:/*", "/")


def scan_folder(spark: SparkSession, root: str, recursive: bool = True, skip: tuple[str, ...] = ("dataset_manifest.json",)) -> DataFrame:
    """One row for each file below root but those to skip; class_name is the first folder, null in the root itself.

    Files are listed without being read, then read in pieces for their hash, so they may be of any size.
    """
    from sedimento.sources.imports import as_samples, read_files

    base = os.path.abspath(root).rstrip("/")
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(base)
    x = listed.select(_plain(F.col("path")).alias("path")).withColumn("relative_path", F.substring("path", len(base) + 2, 1 << 20))
    x = as_samples(read_files(x.where(~F.element_at(F.split("relative_path", "/"), -1).isin(*skip))))
    return x.drop("status").withColumn("class_name", F.when(F.instr("relative_path", "/") > 0, F.split("relative_path", "/")[0]))


def collision_names(files: DataFrame) -> DataFrame:
    """folder, ord, name, stored_name: names made unique in their folder by _1, _2 and so on, in order of ord.

    The numbers count the earlier files of the same name; a numbered name that another file has by itself is numbered
    on once more, by the same rule, until nothing clashes.
    """
    x = files.select("folder", "ord", "name", F.col("name").alias("stored_name"), F.lit(0).alias("tries"))
    while True:
        w = Window.partitionBy("folder", "stored_name").orderBy((F.col("tries") > 0).cast("int"), "ord")
        x = x.withColumn("k", F.row_number().over(w) - 1)
        if not x.where("k > 0").limit(1).count():
            return x.drop("k", "tries")
        stem, ext = F.regexp_replace("name", r"(\.[^./]+)$", ""), F.regexp_extract("name", r"(\.[^./]+)$", 1)
        moved = F.col("k") > 0
        tries = F.when(moved, F.col("tries") + F.col("k")).otherwise(F.col("tries"))
        x = x.withColumn("tries", tries).withColumn("stored_name", F.when(F.col("tries") > 0, F.concat(stem, F.lit("_"), F.col("tries").cast("string"), ext)).otherwise(F.col("name"))).drop("k")


def read_table(spark: SparkSession, path: str) -> DataFrame | None:
    """A csv or json table; None for other kinds (no reader for spreadsheets is at hand) and for files that do not read as one."""
    from pyspark.errors import AnalysisException

    try:
        if path.lower().endswith(".csv"):
            return spark.read.csv(path, header=True, inferSchema=True)
        if path.lower().endswith(".json"):
            x = spark.read.json(path, multiLine=True)
            return None if x.columns == ["_corrupt_record"] else x
    except AnalysisException as e:  # a path that isn't there is an error, a content that has no table isn't
        if "PATH_NOT_FOUND" in str(e):
            raise
    return None


def write_table(df: DataFrame, path: str, kind: str = "csv") -> None:
    """A folder of csv (with header) or json files, written in parallel."""
    w = df.write.mode("overwrite")
    w.csv(path, header=True) if kind == "csv" else w.json(path)


def decode_text(content: Column) -> Column:
    """UTF-8 where the bytes are valid, else Latin-1."""
    s = content.cast("string")
    return F.when(F.is_valid_utf8(s), s).otherwise(F.decode(content, "ISO-8859-1"))
