"""Imports and splits: label lines, folders and manifests to labelled records, stable and stratified splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimento.functions.reading import strip
from sedimento.operators.ranking import numbered
from sedimento.sources.files import IMAGE_EXT, extension


def label_lines(lines: DataFrame) -> DataFrame:
    """file, line_number, path, class_id, class_name from lines (file, line_number, value).

    Blank lines and comments, lines of one token, other files than images and class ids that are no numbers are skipped.
    """
    x = lines.select("file", "line_number", strip(F.col("value")).alias("v")).where("v <> '' and not startswith(v, '#')")
    x = x.select("file", "line_number", F.split("v", r"(?U)\s+").alias("t")).where(F.size("t") >= 2)
    x = x.select("file", "line_number", F.regexp_replace(F.get("t", F.lit(0)), r"\\", "/").alias("path"), F.get("t", F.lit(1)).try_cast("int").alias("class_id"))
    return x.where("class_id is not null").where(extension(F.col("path")).isin(*IMAGE_EXT)).withColumn("class_name", F.coalesce(F.get(F.split("path", "/"), F.size(F.split("path", "/")) - 2), F.lit("")))


def resolve_first(wanted: DataFrame, listing: DataFrame, roots: list[str]) -> DataFrame:
    """id, path, resolved: the first of the candidate places root/path that is in listing (path); absolute paths are taken as they are."""
    tries = F.when(F.col("path").startswith("/"), F.array(F.struct(F.lit(0).alias("k"), F.col("path").alias("c")))).otherwise(F.array(*[F.struct(F.lit(k).alias("k"), F.concat(F.lit(r.rstrip("/") + "/"), "path").alias("c")) for k, r in enumerate(roots)]))
    x = wanted.select("id", "path", F.explode(tries).alias("t")).select("id", "path", "t.k", "t.c")
    return x.join(listing.select(F.col("path").alias("c")).distinct(), "c", "left_semi").groupBy("id", "path").agg(F.min(F.struct("k", "c"))["c"].alias("resolved"))


def folder_label(path: Column, stated: Column | None = None) -> Column:
    """The stated class, else the first folder of the path, else null."""
    p = F.regexp_replace(path, r"\\", "/")
    first = F.when(F.instr(p, "/") > 0, F.split(p, "/")[0])
    return first if stated is None else F.coalesce(stated, first)


def prefer_test(records: DataFrame) -> DataFrame:
    """One record (path, ord, split, ...) a path: the last test record if there is one, else the first record."""
    rank = F.struct((F.coalesce(F.col("split") == "test", F.lit(False)).cast("int")).alias("t"), F.when(F.col("split") == "test", F.col("ord")).otherwise(-F.col("ord")).alias("o"))
    row = F.struct(*[c for c in records.columns if c != "path"])
    return records.groupBy("path").agg(F.max_by(row, rank).alias("r")).select("path", "r.*")


def stable_split(records: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """records with split: per group the first rows in order train, the last fifth (rounded, at least one) test.

    Groups of one row are all train.
    """
    x = numbered(records, by, order)
    test = F.greatest(F.lit(1), F.round(F.col("n") * 0.2))
    train = F.when(F.col("n") <= 1, F.col("n")).otherwise(F.greatest(F.lit(1), F.col("n") - test))
    return x.withColumn("split", F.when(F.col("rn") <= train, "train").otherwise("test")).drop("rn", "n")


def stratified(records: DataFrame, by: list[str], key: str, shares: dict[str, float], seed: int = 0) -> DataFrame:
    """records with split: per class, in seeded hash order, max(1, floor(share n)) rows for each part but the last, which gets the rest."""
    x = numbered(records.withColumn("h__", F.xxhash64(F.lit(seed), key)), by, [F.col("h__"), F.col(key)])
    names = list(shares)
    out, upto = F.lit(names[-1]), F.lit(0)
    bounds = []
    for name in names[:-1]:
        upto = upto + F.greatest(F.lit(1), F.floor(F.col("n") * F.lit(shares[name])))
        bounds.append((name, upto))
    for name, bound in reversed(bounds):
        out = F.when(F.col("rn") <= bound, name).otherwise(out)
    return x.withColumn("split", out).drop("rn", "n", "h__")


def manifest_roles(records: DataFrame) -> DataFrame:
    """records (dataset_id, split, ...) with role: test or train by the manifest's split; datasets of only test rows become train."""
    trains = records.where("split is null or split <> 'test'").select("dataset_id").distinct().withColumn("has__", F.lit(True))
    x = records.join(trains, "dataset_id", "left")
    return x.withColumn("role", F.when((F.col("split") == "test") & F.col("has__"), "test").otherwise("train")).drop("has__")


def bundle(train: DataFrame, test: DataFrame, shared_tags: list[str]) -> DataFrame:
    """Both parts with a role, the test part pointing at its train dataset, tags without repeats in first order."""
    tags = lambda role: F.array_distinct(F.concat(F.coalesce("tags", F.array().cast("array<string>")), F.array(*[F.lit(t) for t in [*shared_tags, role]])))
    side = lambda df, role: df.withColumn("role", F.lit(role)).withColumn("tags", tags(role))
    return side(train, "train").unionByName(side(test, "test"))
