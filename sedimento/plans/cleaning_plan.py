"""Cleaning, split, evaluation and generation queries and their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimento.functions import reading
from sedimento.operators import cleaning, evaluate, generate, splits
from sedimento.plans import text_plan
from sedimento.plans.catalog_plan import _OP, LABELS_SQL
from sedimento.session import table
from sedimento.sources.files import IMAGE_EXT, collision_names

# ---- cleaning --------------------------------------------------------------------------------------------------------


def exact_dup(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.exact_duplicates(table(spark, d, "samples")).select("sample_id", "issue_type", "confidence", F.col("related_id").alias("duplicate_of"))


def near_dup_leaders(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.near_duplicates(table(spark, d, "samples")).select("sample_id", "confidence", F.col("related_id").alias("duplicate_of"))


def _signs(spark: SparkSession, d: str) -> DataFrame:
    """The sign bits of all components: a stand-in for an 8 x 8 average hash; those of the first 62 as one long, bits."""
    head = F.aggregate(F.sequence(F.lit(1), F.lit(62)), F.lit(0).cast("long"), lambda a, i: a * 2 + (F.element_at("embedding", i) > 0).cast("long"))
    rest = F.transform(F.slice("embedding", F.lit(63), F.greatest(F.size("embedding") - 62, F.lit(0))), lambda v: v > 0)
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), head.alias("bits"), rest.alias("rest"))


def ahash_exact(spark: SparkSession, d: str) -> DataFrame:
    """Copies agree in the signs of all components; bits shows those of the first 62."""
    x = _signs(spark, d)
    return x.groupBy("bits", "rest").agg(F.min("id").alias("first"), F.count("*").alias("n")).select("first", "bits", (F.col("n") - 1).alias("copies"))


def text_suggestions(spark: SparkSession, d: str) -> DataFrame:
    x = cleaning.text_suggestions(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"))
    return x.groupBy("issue_type", "suggested_action").agg(F.count("*").alias("n"), F.count_if(F.col("confidence") >= 0.5).alias("confident"))


def review_transitions(spark: SparkSession, d: str) -> DataFrame:
    """Every suggestion is decided by the rest of its id; what the state machine accepts is counted."""
    s = table(spark, d, "cleaning_suggestions").groupBy("id").agg(F.min("status").alias("status"))
    decisions = s.select("id", F.element_at(F.array(F.lit("approved"), F.lit("rejected"), F.lit("applied")), (F.pmod("id", F.lit(3)) + 1).cast("int")).alias("decision"))
    return cleaning.review(s, decisions).groupBy("status", "accepted").agg(F.count("*").alias("n"))


def monitor_items(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.monitor(table(spark, d, "samples"), table(spark, d, "cleaning_suggestions"))


def store_cleaned(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.store_cleaned(table(spark, d, "samples"), table(spark, d, "cleaning_suggestions"))


def apply_suggestions(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.apply_suggestions(table(spark, d, "samples").select("id", "name", "status"), table(spark, d, "cleaning_suggestions"))


def seed_diff(spark: SparkSession, d: str) -> DataFrame:
    """Algorithm ids of the registry and of the tasks, set against each other: used, unused, or unknown to the registry."""
    has, uses = table(spark, d, "algorithms").select("id"), table(spark, d, "tasks").where("algorithm_id is not null and algorithm_id % 3 <> 0").select(F.col("algorithm_id").alias("id"))
    uses = uses.unionByName(table(spark, d, "algorithms").where("id % 11 = 0").select((F.col("id") + 1_000_000).alias("id")))  # some that nobody has
    sets = ((has.intersect(uses), "used"), (has.exceptAll(uses.distinct()), "unused"), (uses.subtract(has), "unknown"))
    return reduce(DataFrame.unionByName, [x.withColumn("state", F.lit(name)) for x, name in sets])


def scenario_merge(spark: SparkSession, d: str) -> DataFrame:
    """Upsert of modalities with evaluation algorithms over those with training ones; what is only stored is retired."""
    a = table(spark, d, "algorithms")
    new = a.where("category = 'evaluation'").groupBy("modality").agg(F.max("version").alias("new_version"))
    old = a.where("category = 'training'").groupBy("modality").agg(F.max("version").alias("old_version"))
    state = F.when(F.col("new_version").isNull(), "retired").when(F.col("old_version").isNull(), "inserted").otherwise("updated")
    return old.join(new, "modality", "full").select("modality", F.coalesce("new_version", "old_version").alias("version"), state.alias("state"))


# ---- imports and splits ----------------------------------------------------------------------------------------------


def _lines(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "samples")
    value = F.when(F.col("id") % 13 == 0, F.concat(F.lit("# "), "name")).when(F.col("id") % 17 == 0, F.concat(F.col("relative_path"), F.lit(" not-a-number"))).otherwise(F.concat(F.lit("  "), F.col("relative_path"), F.lit("\t"), (F.col("id") % 23).cast("string")))
    return s.select(F.col("dataset_id").alias("file"), F.col("id").alias("line_number"), value.alias("value")).where("value is not null")


def label_lines(spark: SparkSession, d: str) -> DataFrame:
    return splits.label_lines(_lines(spark, d))


def resolve_first(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "samples").where("relative_path is not null")
    place = F.concat(F.element_at(F.array(F.lit("/a/"), F.lit("/b/"), F.lit("/c/")), (F.col("id") % 3 + 1).cast("int")), "relative_path")
    return splits.resolve_first(s.select("id", F.col("relative_path").alias("path")), s.select(place.alias("path")), ["/b", "/a"])


def folder_labels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "samples").select("id", splits.folder_label(F.col("relative_path")).alias("class_name"))


def _splits(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "samples")
    return s.select("id", "dataset_id", reading.recorded_split(reading.labels(F.col("labels_json")), reading.fields(F.col("metadata_json"))).alias("split"))


def manifest_split(spark: SparkSession, d: str) -> DataFrame:
    return splits.manifest_roles(_splits(spark, d)).select("id", "dataset_id", "role")


def dedup_prefer_test(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "samples").where("sha256 is not null").select(F.lower(F.trim("sha256")).alias("path"), F.col("id").alias("ord"), (F.when(F.col("status") == "generated", "test").otherwise("train")).alias("split"))
    return splits.prefer_test(s)


def stable_split(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "samples").select("id", "dataset_id", F.coalesce(splits.folder_label(F.col("relative_path")), F.lit("")).alias("c"))
    return splits.stable_split(s, ["dataset_id"], [F.col("c"), F.col("id")]).select("id", "dataset_id", "split")


def stratified_split(spark: SparkSession, d: str) -> DataFrame:
    x = splits.stratified(table(spark, d, "embeddings").select("vec_id", "label"), ["label"], "vec_id", {"train": 0.6, "test": 0.4})
    return x.groupBy("label", "split").agg(F.count("*").alias("n"))


def stratified_split_3way(spark: SparkSession, d: str) -> DataFrame:
    x = splits.stratified(table(spark, d, "embeddings").select("vec_id", "label"), ["label"], "vec_id", {"train": 0.6, "validation": 0.2, "test": 0.2})
    return x.groupBy("label", "split").agg(F.count("*").alias("n"))


def bundle_union(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "datasets").select("id", "name", "tags", "parent_dataset_id")
    out = splits.bundle(x.where("parent_dataset_id is null"), x.where("parent_dataset_id is not null"), ["imported", "underwater"])
    return out.select("id", "role", F.array_join("tags", ",").alias("tags"))


def collision(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "samples").select(F.col("dataset_id").alias("folder"), F.col("id").alias("ord"), F.concat(F.lit("scan"), F.pmod(F.col("id"), F.lit(7)).cast("string"), F.regexp_extract("name", r"(\.[^./]+)$", 1)).alias("name"))
    return collision_names(s).select("folder", "ord", "name", "stored_name")


# ---- evaluation ------------------------------------------------------------------------------------------------------


def _sizes(spark: SparkSession, d: str) -> tuple[int, int]:
    s = table(spark, d, "samples")
    return s.where("status = 'raw'").count(), s.where("status = 'generated'").count()


def sample_ratio(spark: SparkSession, d: str) -> DataFrame:
    r = evaluate.sample_ratio(*_sizes(spark, d))
    return spark.createDataFrame([(r["baseline_count"], r["target_count"], r["ratio"])], "baseline_count long, target_count long, ratio double")


def agent_scores(spark: SparkSession, d: str) -> DataFrame:
    r = evaluate.agent_scores(*_sizes(spark, d))
    return spark.createDataFrame([(r["coverage"], r["coordination"], r["response"])], "coverage double, coordination double, response double")


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    """Truth and a prediction that errs on every seventh vector; labels from 5 on are unknown (5)."""
    e = table(spark, d, "embeddings")
    truth = F.least("label", F.lit(5))
    return e.select(truth.alias("truth"), F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 6).otherwise(truth).cast("int").alias("pred"))


def confusion(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.confusion(_pairs(spark, d))


def openset_metrics(spark: SparkSession, d: str) -> DataFrame:
    x = evaluate.openset_metrics(evaluate.confusion(_pairs(spark, d)))
    return x.select(*[F.round(c, 8).alias(c) for c in x.columns])


def openset_labels(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label")
    return evaluate.openset_labels(e, e.where("label <> 3"), 5)


def class_centroids(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.class_centroids(table(spark, d, "embeddings")).select("label", F.col("pos").cast("bigint").alias("pos"), (F.round("mean", 6) + F.lit(0.0)).alias("mean"))


def centroid_dist(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
    x = evaluate.distances(v, evaluate.centroid_vectors(v))
    return x.select("id", F.round(F.get("distances", F.lit(0))["d"], 6).alias("d"))


def openmax(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
    return evaluate.openmax(v).groupBy("label", "pred").agg(F.count("*").alias("n"))


_RESULT = "struct<report:struct<models:array<struct<model_name:string,metrics:array<struct<metric:string,value:double>>>>>>"


def _metrics(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "tasks").select(F.explode(F.from_json(reading.once(F.col("result_json")), _RESULT)["report"]["models"]).alias("m"))
    x = t.select(F.col("m.model_name").alias("model"), F.explode("m.metrics").alias("x")).where("x.value is not null and model is not null")
    return x.groupBy("model", F.col("x.metric").alias("metric")).agg(F.sum(F.col("x.value").cast("decimal(20,6)")).alias("s"), F.count("*").alias("n")).select("model", "metric", (F.col("s").cast("double") / F.col("n")).alias("value"))


def metric_compare(spark: SparkSession, d: str) -> DataFrame:
    m = _metrics(spark, d)
    x = evaluate.metric_compare(m.where("model = 'base_cnn'"), m.where("model = 'tern_l'"))
    return x.select("metric", *[F.round(c, 6).alias(c) for c in ("baseline", "enhanced", "improvement")])


def comparison_report(spark: SparkSession, d: str) -> DataFrame:
    m = _metrics(spark, d)
    return spark.createDataFrame([(evaluate.comparison_report(evaluate.metric_compare(m.where("model = 'base_cnn'"), m.where("model = 'tern_l'"))),)], "report string")


def demo_metrics(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(r["epoch"], round(r["accuracy"], 6), round(r["loss"], 6)) for r in evaluate.demo_metrics()], "epoch int, accuracy double, loss double")


# ---- generation ------------------------------------------------------------------------------------------------------


def _grow(spark: SparkSession, d: str) -> tuple[DataFrame, int]:
    x = table(spark, d, "samples").where("status = 'raw'").select("id", "name", "labels_json")
    return x, x.count() * 3 // 2


def round_robin(spark: SparkSession, d: str) -> DataFrame:
    x, target = _grow(spark, d)
    return generate.round_robin(x.select("id"), target).select("i", "id")


def copy_augment(spark: SparkSession, d: str) -> DataFrame:
    x, target = _grow(spark, d)
    return generate.complete(generate.copies(x.select("id", "name"), target), target)


def label_inherit(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "samples").select("id", "source_sample_id", "labels_json")
    made = s.where("source_sample_id is not null")
    return generate.inherit_labels(made, s).select("id", "labels_inherited", F.md5(F.coalesce("labels_json", F.lit(""))).alias("labels_md5"))


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")


def text_reverse(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("id", F.reverse("text").alias("text"))


def synonym_en_det(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("id", generate.replace_words(F.col("text"), generate.SYNONYMS_EN).alias("text")).select("id", F.md5("text").alias("md5"), F.length("text").cast("bigint").alias("n"))


def phrase_det(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("id", generate.phrases(F.col("text")).alias("text"))


def style_concise_det(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("id", generate.concise(F.col("text")).alias("text"))


def style_formal_det(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("id", generate.formal(F.col("text")).alias("text"))


def style_casual_det(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("id", generate.casual(F.col("text")).alias("text"))


def _grown_text(operator: str, **params: object):
    def run(spark: SparkSession, d: str) -> DataFrame:
        """i, source_sample_id, md5, n of seeded outputs."""
        made = generate.augment_text(_docs(spark, d), table(spark, d, "documents").count(), operator, seed=7, **params)
        return made.select("i", "source_sample_id", F.md5("text").alias("md5"), F.length("text").alias("n"))

    return run


def phrase_all_or_none(spark: SparkSession, d: str) -> DataFrame:
    """The seeded phrase operator at ratio 0 gives its sources back, whatever the seed."""
    return generate.augment_text(_docs(spark, d), table(spark, d, "documents").count(), "vocabulary_phrase", seed=7, ratio=0.0).select("i", "source_sample_id", "text")


def augment_structure_noise(spark: SparkSession, d: str) -> DataFrame:
    return generate.augment_text(_docs(spark, d), table(spark, d, "documents").count(), "structure_noise", seed=7)


def augment_reordering(spark: SparkSession, d: str) -> DataFrame:
    return generate.augment_text(_docs(spark, d), table(spark, d, "documents").count(), "sentence_reordering", seed=7)


QUERIES = {
    f.__name__: f
    for f in (
        exact_dup, near_dup_leaders, ahash_exact, text_suggestions, review_transitions, monitor_items, store_cleaned, apply_suggestions, seed_diff, scenario_merge,
        label_lines, resolve_first, folder_labels, manifest_split, dedup_prefer_test, stable_split, stratified_split, stratified_split_3way, bundle_union,
        sample_ratio, agent_scores, confusion, openset_metrics, openset_labels, class_centroids, centroid_dist, openmax, metric_compare, comparison_report, demo_metrics,
        round_robin, copy_augment, label_inherit, text_reverse, synonym_en_det, phrase_det, style_concise_det, style_formal_det, style_casual_det, phrase_all_or_none, augment_structure_noise, augment_reordering,
    )
} | {
    "collision_names": collision, "augment_context": _grown_text("context_embedding", mask_ratio=0.5), "augment_back_translation": _grown_text("back_translation"), "augment_phrases": _grown_text("vocabulary_phrase"), "augment_casual": _grown_text("style_controlled", style="casual"),
}

_HASH = "h as (select id, regexp_replace(regexp_replace(lower(trim(sha256, e' \\t\\n\\r')), '\\s', '', 'g'), '^[a-z]+-?[0-9]*[:=]', '') as h from samples), v as (select id, h from h where regexp_full_match(h, '[0-9a-f]{64}') and h <> repeat('0', 64))"
_BEST = "b as (select sample_id, id as suggestion_id, coalesce(confidence, 0) as confidence, issue_type, suggested_action, row_number() over (partition by sample_id order by coalesce(confidence, 0) desc, id, issue_type, suggested_action, status) as k from cleaning_suggestions)"
_PAIRS = "p as (select least(label, 5) as truth, (case when vec_id % 7 = 0 then (label + 1) % 6 else least(label, 5) end)::int as pred from embeddings)"
_CENT = "c as (select label, i as pos, avg(v::double) as mean from (select label, unnest(embedding) as v, generate_subscripts(embedding, 1) as i from embeddings) group by 1, 2)"
_METRICS = """t as (select case when json_valid(result_json) then case when json_type(result_json) = 'VARCHAR' then case when json_valid(json_extract_string(result_json, '$')) then json_extract_string(result_json, '$')::json end else result_json::json end end as j from tasks),
    m as (select unnest(from_json(j->'$.report.models', '["JSON"]')) as m from t), x as (select m->>'$.model_name' as model, unnest(from_json(m->'$.metrics', '["JSON"]')) as x from m),
    a as (select model, x->>'$.metric' as metric, sum((x->>'$.value')::double::decimal(20, 6))::double / count(*) as value from x where x->>'$.value' is not null and model is not null group by 1, 2)"""
_told = lambda c, words: reduce(lambda x, ab: f"replace({x}, '{ab[0]}', '{ab[1]}')", zip(words.split()[::2], words.split()[1::2], strict=True), c)
_strat = lambda cases: f"""with r as (select label, count(*) as n from embeddings group by 1) {cases}"""
_GROW = "s as (select id, name, row_number() over (order by id) - 1 as r from samples where status = 'raw'), g as (select unnest(range((select count(*) from s) * 3 // 2)) as i), o as (select i, id, name from g join s on s.r = i % (select count(*) from s))"

_share = lambda issue, found: f"select '{issue}' as issue_type, 'repair' as suggested_action, count(*)::bigint as n, count(*) filter (round_even(least(1.0, changed / greatest(total, 1)::double), 4) >= 0.5)::bigint as confident from ({found}) group by 1, 2"

SQL = {
    "text_suggestions": " union all ".join(_share(i, text_plan.SQL[k]) for i, k in (("text_duplicate", "text_dedup_line"), ("text_stopwords", "stopwords"), ("text_unstemmed", "stemming"))),
    "exact_dup": f"with {_HASH}, f as (select h, min(id) as f from v group by 1) select id as sample_id, 'duplicate' as issue_type, 1.0::double as confidence, f as duplicate_of from v join f using (h) where id > f",
    "ahash_exact": """with x as (select vec_id as id, list_reduce(list_transform(embedding[1:62], lambda v: (v > 0)::bigint), lambda a, b: a * 2 + b) as bits from embeddings)
        select min(id) as "first", bits, count(*)::bigint - 1 as copies from x group by bits""",
    "review_transitions": """with s as (select id, min(status) as status from cleaning_suggestions group by 1), x as (select status, ['approved', 'rejected', 'applied'][id % 3 + 1] as d from s),
        y as (select *, (status = 'pending' and d in ('approved', 'rejected', 'applied')) or (status = 'approved' and d in ('rejected', 'applied')) as accepted from x)
        select case when accepted then d else status end as status, accepted, count(*)::bigint as n from y group by 1, 2""",
    "monitor_items": f"""with {_BEST} select s.id as sample_id, s.name as sample_name, coalesce(suggestion_id, -1)::bigint as suggestion_id, case when suggestion_id is null then 'none' else issue_type end as issue_type,
        case when suggestion_id is null then 'keep' else {_OP} end as operation, case when suggestion_id is null then 1.0 else confidence end::double as confidence from samples s left join b on b.sample_id = s.id and k = 1""",
    "store_cleaned": f"""with c as (select *, {_OP} as op from cleaning_suggestions where status is null or status <> 'rejected'), dr as (select distinct sample_id from c where op = 'delete'),
        m as (select sample_id, output_sample_id, row_number() over (partition by sample_id order by coalesce(confidence, 0) desc, id, output_sample_id) as k from c where op = 'repair' and output_sample_id is not null)
        select s.id as sample_id, coalesce(o.id, s.id) as stored_from, s.name from samples s left join m on m.sample_id = s.id and k = 1 left join samples o on o.id = m.output_sample_id where (s.status is null or s.status <> 'deleted') and s.id not in (select sample_id from dr where sample_id is not null)""",
    "apply_suggestions": f"""with p as (select sample_id, max(({_OP} = 'delete')::int) as d, max(({_OP} = 'repair')::int) as r from cleaning_suggestions where status = 'applied' group by 1)
        select id, name, case when d = 1 then 'deleted' when r = 1 and status <> 'deleted' then 'cleaned' else status end as status from samples left join p on sample_id = id""",
    "seed_diff": """with a as (select id from algorithms), u as (select distinct algorithm_id as id from tasks where algorithm_id is not null and algorithm_id % 3 <> 0 union select id + 1000000 from algorithms where id % 11 = 0)
        select coalesce(a.id, u.id) as id, case when a.id is null then 'unknown' when u.id is null then 'unused' else 'used' end as state from a full join u on a.id = u.id""",
    "scenario_merge": """with n as (select modality, max(version) as v from algorithms where category = 'evaluation' group by 1), o as (select modality, max(version) as v from algorithms where category = 'training' group by 1)
        select coalesce(n.modality, o.modality) as modality, coalesce(n.v, o.v) as version, case when n.v is null then 'retired' when o.v is null then 'inserted' else 'updated' end as state from n full join o on n.modality = o.modality""",
    "label_lines": rf"""with x as (select dataset_id as file, id as line_number, replace(relative_path, '\', '/') as path, (id % 23)::int as class_id from samples where relative_path is not null and not regexp_matches(relative_path, '\s') and id % 13 <> 0 and id % 17 <> 0)
        select file, line_number, path, class_id, coalesce(string_split(path, '/')[-2], '') as class_name from x where lower(regexp_extract(path, '(\.[^./]+)$', 1)) in ({", ".join(f"'{e}'" for e in IMAGE_EXT)})""",
    "resolve_first": """with s as (select id, relative_path as path from samples where relative_path is not null), l as (select distinct ['/a/', '/b/', '/c/'][id % 3 + 1] || path as p from s)
        select id, path, case when starts_with(path, '/') then path when '/b/' || path in (select p from l) then '/b/' || path else '/a/' || path end as resolved from s
        where '/b/' || path in (select p from l) or '/a/' || path in (select p from l) or (starts_with(path, '/') and path in (select p from l))""",
    "folder_labels": r"select id, case when contains(replace(relative_path, '\', '/'), '/') then split_part(replace(relative_path, '\', '/'), '/', 1) end as class_name from samples",
    "manifest_split": f"""with {LABELS_SQL}, f as (select id, lower(trim(r->>'$.split')) in ('test', 'tst', 'testing') as t from lr where i = 1), s as (select s.id, dataset_id, coalesce(t, false) as t from samples s left join f on f.id = s.id), h as (select distinct dataset_id from s where not t)
        select id, dataset_id, case when t and dataset_id in (select dataset_id from h) then 'test' else 'train' end as role from s""",
    "dedup_prefer_test": """with s as (select lower(trim(sha256)) as path, id, status = 'generated' as t from samples where sha256 is not null)
        select path, coalesce(max(id) filter (where t), min(id)) as ord, case when bool_or(t) then 'test' else 'train' end as split from s group by 1""",
    "stable_split": r"""with s as (select id, dataset_id, coalesce(case when contains(replace(relative_path, '\', '/'), '/') then split_part(replace(relative_path, '\', '/'), '/', 1) end, '') as c from samples),
        r as (select id, dataset_id, row_number() over (partition by dataset_id order by c, id) as k, count(*) over (partition by dataset_id) as n from s)
        select id, dataset_id, case when k <= (case when n <= 1 then n else greatest(1, n - greatest(1, round(n * 0.2))) end) then 'train' else 'test' end as split from r""",
    "stratified_split": _strat("select label, 'train' as split, least(n, greatest(1, floor(n * 0.6::double)))::bigint as n from r union all select label, 'test', n - greatest(1, floor(n * 0.6::double))::bigint from r where n > greatest(1, floor(n * 0.6::double))"),
    "stratified_split_3way": _strat("""select label, 'train' as split, greatest(1, floor(n * 0.6::double))::bigint as n from r union all select label, 'validation', greatest(1, floor(n * 0.2::double))::bigint from r
        union all select label, 'test', n - greatest(1, floor(n * 0.6::double))::bigint - greatest(1, floor(n * 0.2::double))::bigint from r"""),
    "bundle_union": """with e as (select id, case when parent_dataset_id is null then 'train' else 'test' end as role, list_concat(coalesce(tags, []), ['imported', 'underwater', case when parent_dataset_id is null then 'train' else 'test' end]) as t from datasets),
        u as (select id, role, unnest(t) as t, generate_subscripts(t, 1) as i from e), f as (select id, role, t, min(i) as i from u group by 1, 2, 3) select id, role, string_agg(t, ',' order by i) as tags from f group by 1, 2""",
    "collision_names": r"""with s as (select dataset_id as folder, id as ord, 'scan' || (id % 7) || regexp_extract(name, '(\.[^./]+)$', 1) as name from samples), k as (select *, row_number() over (partition by folder, name order by ord) - 1 as k from s)
        select folder, ord, name, case when k = 0 then name else regexp_replace(name, '(\.[^./]+)$', '') || '_' || k || regexp_extract(name, '(\.[^./]+)$', 1) end as stored_name from k""",
    "sample_ratio": "with c as (select count(*) filter (where status = 'raw') as b, count(*) filter (where status = 'generated') as t from samples) select b::bigint as baseline_count, t::bigint as target_count, round_even(t / greatest(b, 1)::double, 2) as ratio from c",
    "agent_scores": "with c as (select count(*) filter (where status = 'raw') as b, count(*) filter (where status = 'generated') as t from samples) select least(100.0::double, 100.0::double * t / greatest(b, t, 1)) as coverage, 80.0::double as coordination, least(100.0::double, 70.0::double + 1.2::double * least(t, 20)) as response from c",
    "confusion": f"with {_PAIRS} select truth, pred, count(*)::bigint as n from p group by 1, 2",
    "openset_metrics": f"""with {_PAIRS}, l as (select truth as label from p union select pred from p), s as (select label, (select count(*) from p where truth = label)::double as t, (select count(*) from p where pred = label)::double as p, (select count(*) from p where truth = label and pred = label)::double as tp from l),
        m as (select label, t, tp, case when t > 0 then tp / t end as rec, case when p > 0 then tp / p end as pre from s), k as (select avg(coalesce(pre, 0)) as kp, avg(coalesce(rec, 0)) as kr from m where label < (select max(label) from m))
        select round((select sum(tp) / sum(t) from m), 8) as accuracy, round(case when kp + kr = 0 then 0 else 2 * kp * kr / (kp + kr) end, 8) as osfm, round((select avg(case when coalesce(rec, 0) + coalesce(pre, 0) > 0 then 2 * rec * pre / (rec + pre) else 0 end) from m), 8) as macro_f1,
        round((select case when min(t) > 0 then case when min(rec) > 0 then exp(avg(ln(case when rec > 0 then rec end))) else 0 end end from m), 8) as gmean, round((select avg(rec) from m), 8) as nma from k""",
    "openset_labels": "with b as (select label, row_number() over (order by label) - 1 as k from (select distinct label from embeddings where label <> 3)) select vec_id as id, least(k, 5)::int as class_id from embeddings join b using (label)",
    "class_centroids": f"with {_CENT} select label, (pos - 1)::bigint as pos, round(mean, 6) + 0.0::double as mean from c",
    "centroid_dist": f"""with {_CENT}, v as (select vec_id as id, unnest(embedding)::double as v, generate_subscripts(embedding, 1) as pos from embeddings), d as (select id, c.label, sqrt(sum((v - mean) * (v - mean))) as d from v join c using (pos) group by 1, 2) select id, round(min(d), 6) as d from d group by 1""",
    "metric_compare": f"""with {_METRICS}, y as (select b.metric, b.value as baseline, coalesce(e.value, 0) as enhanced from a b left join a e on e.metric = b.metric and e.model = 'tern_l' where b.model = 'base_cnn')
        select metric, round(baseline, 6) as baseline, round(enhanced, 6) as enhanced, round(case when baseline > 0 then (enhanced - baseline) / baseline * 100 else 0 end, 6) as improvement from y""",
    "demo_metrics": "select e::int as epoch, round(0.7 + 0.05 * e, 6)::double as accuracy, round(0.5 - 0.03 * e, 6)::double as loss from range(1, 4) t(e)",
    "round_robin": f"with {_GROW} select i, id from o",
    "copy_augment": rf"with {_GROW} select i, id as source_sample_id, regexp_replace(name, '(\.[^./]+)$', '') || '_copy_' || case when i < 10000 then lpad(i::varchar, 4, '0') else i::varchar end || regexp_extract(name, '(\.[^./]+)$', 1) as name from o",
    "label_inherit": """with x as (select m.id, m.labels_json as o, s.labels_json as f, coalesce(trim(m.labels_json) not in ('', '[]', 'null'), false) as own from samples m left join samples s on s.id = m.source_sample_id where m.source_sample_id is not null)
        select id, not own and f is not null as labels_inherited, md5(coalesce(case when own then o else f end, '')) as labels_md5 from x""",
    "text_reverse": "select doc_id as id, (select string_agg(c, '' order by i desc) from (select unnest(string_split(text, '')) as c, generate_subscripts(string_split(text, ''), 1) as i)) as text from documents",
    # Written out, not built from the operators' own lists.
    "synonym_en_det": r"""with t as (select doc_id as id, array_to_string(list_transform(regexp_extract_all(text, '[\pL\pM\pN_]+'), lambda w: case lower(w) when 'fast' then 'quick' when 'small' then 'compact' when 'large' then 'big' when 'sample' then 'example' else w end), ' ') as t from documents)
        select id, md5(t) as md5, length(t)::bigint as n from t""",
    "phrase_det": f"select doc_id as id, {_told('text', '鲁棒性 可靠性 提升 增强 增强 提升 泛化 泛化能力 保持 维持 好 优秀 坏 糟糕 大 巨大 小 微小 快 迅速 慢 缓慢')} as text from documents",
    "style_formal_det": f"select doc_id as id, {_told('text', '搞 进行 挺 相当 很 较为 非常 十分 特别 尤其 可能 或许 感觉 认为')} as text from documents",
    "style_casual_det": f"select doc_id as id, {_told('text', '进行 搞 相当 挺 较为 挺 十分 很 尤其 特别 或许 可能 认为 觉得')} as text from documents",
    "style_concise_det": "select doc_id as id, replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(text, '其实', ''), '可能', ''), '感觉', ''), '大概', ''), '大致', ''), '非常', ''), '真的', ''), '挺', ''), '并且', '且'), '同时', '且') as text from documents",
    "phrase_all_or_none": "select row_number() over (order by doc_id) - 1 as i, doc_id as source_sample_id, text from documents where text is not null",
}
