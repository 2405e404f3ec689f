"""Catalog queries: pages, previews, searches, payloads, statistics.

Tables are those of the catalog (datasets, samples, tasks, task_logs, cleaning_suggestions, algorithms). Null columns are
kept as null unless said otherwise; pages have a total order (id breaks ties); empty tables give empty pages and zero
counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedimento.functions import reading
from sedimento.operators.ranking import numbered

# Extensions by kind of preview, order of modalities, labels.
IMAGE_EXT = (".jpg", ".jpeg", ".png", ".bmp", ".gif", ".webp", ".tif", ".tiff")
AUDIO_EXT = (".wav", ".mp3", ".aac", ".flac", ".ogg", ".m4a")
TEXT_EXT = (".txt", ".csv", ".json", ".md", ".log", ".yaml", ".yml", ".xml", ".py", ".js", ".html", ".css", ".cfg", ".ini", ".toml")
MODALITY_ORDER = ("image", "audio", "text", "tabular", "video", "multimodal", "other")
OPERATIONS = {"delete": ("delete", "exclude"), "repair": ("repair", "replace", "fix", "clean"), "review": ("review", "manual_review"), "keep": ("keep", "none")}


def active_datasets(datasets: DataFrame) -> DataFrame:
    return datasets.where("not coalesce(is_deleted, false)")


def active_samples(samples: DataFrame) -> DataFrame:
    return samples.where("status is null or status <> 'deleted'")


def page(df: DataFrame, number: int, size: int, *order: Column) -> DataFrame:
    """Page `number` (from 1) of `size` rows; a number below 1 is the first page, a size below 0 is empty."""
    return df.orderBy(*order).offset(max(number - 1, 0) * max(size, 0)).limit(max(size, 0))


def newest(at: str = "created_at") -> tuple[Column, Column]:
    return F.col(at).desc_nulls_last(), F.col("id").desc()


def stage(status: Column, tags: Column, deleted: Column, name: Column | None = None) -> Column:
    """deleted > cleaned > generated > raw by status or tag, else the status; with a name also test by status or word."""
    has = lambda w: (F.lower(status) == w) | F.exists(F.coalesce(tags, F.array().cast("array<string>")), lambda t: F.lower(t) == w)
    out = F.when(F.coalesce(deleted, F.lit(False)) | F.coalesce(F.lower(status) == "deleted", F.lit(False)), "deleted").when(has("cleaned"), "cleaned").when(has("generated"), "generated")
    if name is not None:
        out = out.when(has("test") | F.lower(name).contains("test"), "test")
    return out.when(has("raw"), "raw").otherwise(F.coalesce(F.lower(status), F.lit("raw")))


def preview_kind(extension: Column, mime: Column, modality: Column) -> Column:
    """Extension or mime type, image before audio before text; else the modality; else file."""
    e, m = F.lower(F.coalesce(extension, F.lit(""))), F.lower(F.coalesce(mime, F.lit("")))
    return (
        F.when(e.isin(*IMAGE_EXT) | m.startswith("image/"), "image").when(e.isin(*AUDIO_EXT) | m.startswith("audio/"), "audio").when(e.isin(*TEXT_EXT) | m.startswith("text/"), "text")
        .when(modality.isin("image", "audio", "text"), modality).otherwise("file")
    )


def operation(action: Column) -> Column:
    """The bucket of a suggested action; unknown actions are their own, blank ones need a review."""
    a = F.lower(reading.strip(F.coalesce(action, F.lit(""))))
    out = F.when(a == "", "review")
    for bucket, words in OPERATIONS.items():
        out = out.when(a.isin(*words), bucket)
    return out.otherwise(a)


def directory(samples: DataFrame, dataset_id: int | None = None, prefix: str = "") -> DataFrame:
    """dataset_id, kind, name: folders and files directly below prefix; samples without a relative path use their name."""
    x = samples if dataset_id is None else samples.where(F.col("dataset_id") == dataset_id)
    path = F.regexp_replace(F.coalesce("relative_path", "name"), r"\\", "/")
    x = x.select("dataset_id", path.alias("p")).where(F.col("p").startswith(prefix)).select("dataset_id", F.substring("p", F.lit(len(prefix) + 1), F.length("p")).alias("p"))
    folder = F.instr("p", "/") > 0
    return x.select("dataset_id", F.when(folder, "folder").otherwise("file").alias("kind"), F.when(folder, F.substring_index("p", "/", 1)).otherwise(F.col("p")).alias("name")).distinct()


def search(datasets: DataFrame, words: str = "", modality: str | None = None, at_stage: str | None = None) -> DataFrame:
    x = active_datasets(datasets).withColumn("stage", stage(F.col("status"), F.col("tags"), F.col("is_deleted")))
    x = x.where(F.lower("name").contains(words.lower()))
    x = x if modality is None else x.where(reading.canonical_modality(F.col("modality")) == modality)
    return x if at_stage is None else x.where(F.col("stage") == at_stage)


def count_by_modality(samples: DataFrame, datasets: DataFrame) -> DataFrame:
    """modality, n over active samples of active datasets. Pairs are counted by dataset first, so no row is shuffled."""
    per = active_samples(samples).groupBy("dataset_id", reading.canonical_modality(F.col("modality")).alias("modality")).agg(F.count("*").alias("n"))
    return per.join(active_datasets(datasets).select(F.col("id").alias("dataset_id")), "dataset_id", "left_semi").groupBy("modality").agg(F.sum("n").alias("n"))


def dataset_stats(samples: DataFrame) -> DataFrame:
    """dataset_id, total, valid, size_bytes, processed, breakdown: the materialised statistics, recomputed."""
    per = active_samples(samples).groupBy("dataset_id", reading.canonical_modality(F.col("modality")).alias("m")).agg(
        F.count("*").alias("n"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("b"), F.count_if(F.col("status").isin("processed", "cleaned", "enhanced")).alias("p")
    )
    parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("m", "n"))), lambda x: F.concat_ws("=", x["m"], x["n"].cast("string"))), ",")
    return per.groupBy("dataset_id").agg(F.sum("n").alias("total"), F.sum("n").alias("valid"), F.sum("b").alias("size_bytes"), F.sum("p").alias("processed"), parts.alias("breakdown"))


def system_stats(samples: DataFrame, datasets: DataFrame) -> DataFrame:
    """One row: active datasets, active samples in them, their bytes, and the processed ones."""
    known = active_datasets(datasets).select(F.col("id").alias("dataset_id"))
    per = dataset_stats(samples).join(known, "dataset_id", "left_semi").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("total", "size_bytes", "processed")])
    return per.withColumn("datasets", F.lit(known.count())).select("datasets", F.col("total").alias("samples"), "size_bytes", "processed")


def class_distribution(samples: DataFrame) -> DataFrame:
    """class_name, n over all classification labels of active samples; spellings of a class are one."""
    x = active_samples(samples).select(F.explode(reading.labels(F.col("labels_json"))).alias("r")).where("r.type = 'classification'")
    pick = F.coalesce(*[F.when(reading.filled(F.col(f"r.{k}")), reading.canonical_word(F.col(f"r.{k}"))) for k in ("class_name", "name", "label")])
    return x.groupBy(F.coalesce(pick, F.lit("unknown")).alias("class_name")).agg(F.count("*").alias("n"))


def class_map(samples: DataFrame) -> DataFrame:
    """class_id, class_name: the last name in order for each id."""
    x = samples.select(F.explode(reading.labels(F.col("labels_json"))).alias("r")).where("r.type = 'classification'")
    x = x.select(F.col("r.class_id").try_cast("int").alias("class_id"), F.when(reading.filled(F.col("r.class_name")), reading.canonical_word(F.col("r.class_name"))).alias("class_name"))
    return x.where("class_id is not null and class_name is not null").groupBy("class_id").agg(F.max("class_name").alias("class_name"))


def class_ids(names: DataFrame) -> DataFrame:
    """class_name, class_id: positions of the distinct names in order, numbered over range partitions."""
    x = numbered(names.select("class_name").where("class_name is not null").distinct(), [], [F.col("class_name")])
    return x.select("class_name", (F.col("rn") - 1).cast("int").alias("class_id"))


def growth_trend(samples: DataFrame, now, span_days: int, step: str, label: str) -> DataFrame:
    """bucket, at, n: cumulative count of samples created since the start, at each step up to now.

    Rows fall into the first bucket whose end they reach and only bucket counts are accumulated: the data is read once
    and never joined with the buckets.
    """
    spark = samples.sparkSession
    end = F.lit(now).cast("timestamp")
    start = end - F.expr(f"interval {span_days} days")
    ends = spark.range(1).select(F.posexplode(F.sequence(start, end, F.expr(f"interval {step}"))).alias("bucket", "at"))
    last = ends.orderBy(F.col("at").desc()).first()
    width = {"1 hour": 3600, "1 day": 86400, "30 days": 30 * 86400}[step] * 1_000_000
    offset = F.unix_micros("created_at") - F.unix_micros(start)
    counted = samples.where((F.col("created_at") >= start) & (F.col("created_at") <= F.lit(last["at"]))).groupBy(F.ceil(offset / F.lit(width)).cast("int").alias("bucket")).agg(F.count("*").alias("c"))
    x = ends.join(counted, "bucket", "left")
    total = F.sum(F.coalesce("c", F.lit(0))).over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    return x.select(F.col("bucket").cast("int").alias("bucket"), F.date_format("at", label).alias("label"), total.cast("bigint").alias("n"))


def with_names(tasks: DataFrame, datasets: DataFrame) -> DataFrame:
    """Tasks with the names of their source and target datasets, null where there is none."""
    named = lambda side: datasets.select(F.col("id").alias(f"{side}_dataset_id"), F.col("name").alias(f"{side}_dataset_name"))
    return tasks.join(named("source"), "source_dataset_id", "left").join(named("target"), "target_dataset_id", "left")


def suggestion_payload(suggestions: DataFrame, samples: DataFrame) -> DataFrame:
    """Suggestions with the sample they are about and the one they produced.

    Only the columns shown are joined; a suggestion whose sample is gone keeps its row.
    """
    about = samples.select(F.col("id").alias("sample_id"), F.col("name").alias("sample_name"), F.col("modality").alias("sample_type"))
    made = samples.select(F.col("id").alias("output_sample_id"), F.col("name").alias("output_sample_name"))
    x = suggestions.select("id", "task_id", "sample_id", "issue_type", "suggested_action", "status", "confidence", "output_sample_id")
    return x.join(about, "sample_id", "left").join(made, "output_sample_id", "left").withColumn("operation", operation(F.col("suggested_action")))
